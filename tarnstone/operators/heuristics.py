"""Small judgements on questions and passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnstone.functions import text as T

# Words without weight in a question; signs of a question that leans on what was said before.
STOP_WORDS = [
    "about", "after", "also", "and", "are", "does", "from", "how", "into", "that", "the", "their", "these", "this", "what", "when",
    "which", "with", "would", "data", "document", "standard", "actuarial", "services",
]
CONTEXT = ["这个", "那个", "这", "那", "它", "上面", "上述"]
DOMAIN = ["数据", "模型", "赔款", "压力", "资本", "流动性", "精算", "标准", "文件", "文档", "报告", "测试", "风险", "利率", "准备金"]


def _content_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def supports(question: Column, passage: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Whether a passage shares enough terms with a question: two of up to three, else three; a
    question of one term is supported by nothing."""
    asked = F.array_except(_content_terms(question), F.array(*map(F.lit, stop_words)))
    shared = F.size(F.array_intersect(asked, _content_terms(passage)))
    return (F.size(asked) >= 2) & (shared >= F.when(F.size(asked) <= 3, 2).otherwise(3))


def needs_context(question: Column, context: list[str] = CONTEXT, domain: list[str] = DOMAIN) -> Column:
    """Whether a question can't be searched for by itself: empty, or short and pointing back."""
    clean = T.collapse(T.casefold(question))
    han = F.length(F.regexp_replace(clean, r"[^\x{4e00}-\x{9fff}]", ""))

    def has(signs: list[str]) -> Column:
        return F.exists(F.array(*map(F.lit, signs)), lambda s: F.contains(clean, s))

    pointing = (han <= 8) & has(context)
    bare = clean.rlike(r"^(?:what|which)\s+(?:are|about)\s+(?:the\s+)?(?:four|three|two)\??$")
    return F.coalesce((clean == "") | F.when(pointing, ~has(domain)).otherwise(bare), F.lit(True))
