"""The passage of a text that answers a query best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.functions import text as T

LINES = 12

# Words that say nothing about a query.
STOP_WORDS = [
    "a", "about", "after", "all", "an", "and", "are", "as", "at", "be", "been", "before", "being", "between", "by", "can", "could",
    "did", "do", "does", "for", "from", "have", "how", "in", "include", "includes", "into", "is", "it", "its", "kind", "kinds",
    "may", "might", "no", "of", "on", "or", "should", "that", "the", "their", "them", "there", "these", "this", "those", "to",
    "type", "types", "use", "used", "uses", "using", "was", "were", "what", "when", "where", "which", "who", "whom", "why",
    "will", "with", "would", "work", "actuary", "actuaries", "asop", "eiopa",
]
# Stems that name a series of documents.
NAMES = ["asop", "eiopa"]
# Words that a query means as another.
SYNONYMS = {"cover": "scope", "covered": "scope", "covers": "scope"}


def query_stems(query: Column, stop_words: list[str] = STOP_WORDS, synonyms: dict[str, str] = SYNONYMS, names: list[str] = NAMES) -> Column:
    """The different stems of a query's words, without stop words and numbers, in order."""
    kept = F.filter(T.words(query), lambda w: ~w.isin(stop_words) & ~w.rlike(r"^\p{Nd}+$"))

    def meant(w: Column) -> Column:
        for word, other in synonyms.items():
            w = F.when(w == word, F.lit(other)).otherwise(w)
        return T.stem(w)

    return F.array_distinct(F.filter(F.transform(kept, meant), lambda w: ~w.isin(names)))


def best_passages(rows: DataFrame, key: str, text: str, query: str, stop_words: list[str] = STOP_WORDS, synonyms: dict[str, str] = SYNONYMS) -> DataFrame:
    """(key, first_line, last_line, score): for each row the passage of at most LINES lines of text
    that holds the most telling terms of query, with one line more at each side.

    A line that holds the whole query comes first and alone (score null). Else a term weighs
    1 + ln((lines + 1) / (its lines + 1)), and each pair of terms that follow each other in query
    and passage 2; the highest score, then the shortest, then the first passage is taken. Without
    terms or hits the first line is taken, or the line with the most terms. A passage that neither
    begins nor ends in a line with a term is never the shortest, so only such lines are paired: the
    pairs of a text are bounded by LINES for each of its lines."""
    stems = query_stems(F.col(query), stop_words, synonyms)
    folded = T.collapse(T.casefold(F.col(query)))
    lines = T.lines(F.col(text))
    base = rows.where(F.size(lines) > 0).select(key, lines.alias("lines"), stems.alias("terms"), folded.alias("whole"))
    exact = F.array_position(F.transform("lines", lambda x: (F.col("whole") != "") & F.contains(T.collapse(T.casefold(x)), F.col("whole"))), F.lit(True)).cast("int")
    base = base.withColumn("exact", exact).withColumn("n", F.size("lines"))
    each = base.where((F.col("exact") == 0) & (F.size("terms") > 0)).select(key, "terms", "n", F.posexplode("lines").alias("at", "line"))
    tokens = F.transform(T.words(F.col("line")), T.stem)
    order = Window.partitionBy(key).orderBy("at")
    each = each.select(key, "terms", "n", "at", tokens.alias("tokens")).withColumn("before", F.lag(F.try_element_at("tokens", F.lit(-1))).over(order))
    pairs = F.when(F.size("terms") > 1, F.transform(F.sequence(F.lit(1), F.size("terms") - 1), lambda i: F.concat_ws("\u0001", F.element_at("terms", i.cast("int")), F.element_at("terms", (i + 1).cast("int"))))).otherwise(F.array().cast("array<string>"))
    inner = F.when(F.size("tokens") > 1, F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.concat_ws("\u0001", F.element_at("tokens", i.cast("int")), F.element_at("tokens", (i + 1).cast("int"))))).otherwise(F.array().cast("array<string>"))
    each = each.select(
        key, "terms", "n", "at",
        F.array_intersect("terms", "tokens").alias("met"),
        F.array_intersect(pairs, inner).alias("inside"),
        F.when(F.col("before").isNotNull() & (F.size("tokens") > 0), F.array_intersect(pairs, F.array(F.concat_ws("\u0001", "before", F.get("tokens", F.lit(0)))))).otherwise(F.array().cast("array<string>")).alias("across"),
    )
    telling = each.where(F.size("met") > 0)
    frequency = telling.select(key, "n", F.explode("met").alias("term")).groupBy(key, "term").agg((1 + F.log((F.first("n") + 1) / (F.count("*") + 1))).alias("weight"))
    weights = frequency.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))  # the terms of one query
    starts = telling.select(key, F.col("at").alias("first"))
    rest = each.select(key, "at", "met", "inside", "across")
    ends = telling.select(F.col(key).alias("k2"), F.col("at").alias("last"))
    window = starts.join(ends, (F.col(key) == F.col("k2")) & F.col("last").between(F.col("first"), F.col("first") + LINES - 1)).drop("k2")
    inside = window.join(rest, key).where(F.col("at").between(F.col("first"), F.col("last")))
    scored = inside.groupBy(key, "first", "last").agg(
        F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.concat("inside", F.when(F.col("at") > F.col("first"), F.col("across")).otherwise(F.array().cast("array<string>"))))))).alias("pairs"),
    )
    value = F.aggregate("met", F.lit(0.0), lambda s, t: s + F.element_at("weights", t)) + 2.0 * F.col("pairs")
    best = scored.join(weights, key).select(key, "first", "last", F.round(value, 6).alias("score")).groupBy(key).agg(F.max_by(F.struct("first", "last", "score"), F.struct("score", F.col("first") - F.col("last"), -F.col("first"))).alias("b"))
    found = base.select(key, "exact", "n").join(best, key, "left")
    first = F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.greatest(F.lit(1), F.coalesce(F.col("b.first"), F.lit(0))))
    last = F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.when(F.col("b").isNull(), F.lit(1)).otherwise(F.least(F.col("n"), F.col("b.last") + 2)))
    return found.select(key, first.cast("int").alias("first_line"), last.cast("int").alias("last_line"), F.col("b.score").alias("score"))
