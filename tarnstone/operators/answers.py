"""Checks of written answers: sentences, citations of evidence, required phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.functions import text as T
from tarnstone.runtime import broadcast_if_small

#: Where a sentence ends (a citation that follows belongs to it), and what a citation looks like.
SENTENCE_END = r"(?<=[.!?。！？])\s+(?!\[ev-)|\n+"
CITATION = r"\[ev-[^\]]+\]"


def sentences(answer: Column) -> Column:
    return F.filter(F.split(answer, SENTENCE_END), lambda s: s != "")


def citations(text: Column) -> Column:
    """The different citations in a text, in order, without brackets."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)), lambda c: F.substring(c, F.lit(2), F.length(c) - 2)))


def cited_phrases(answers: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """(key, no, in_answer, cited): whether an answer holds a phrase, whatever the letters' case, and
    whether the first sentence that does has a citation of its own.

    answers: key, answer; phrases: key, no, phrase. A phrase without an answer is in none, and a
    null answer holds nothing."""
    met = phrases.join(broadcast_if_small(answers), key, "left")
    phrase = T.casefold(F.col("phrase"))
    first = F.get(F.filter(sentences(F.coalesce("answer", F.lit(""))), lambda s: F.contains(T.casefold(s), phrase)), F.lit(0))
    inside = F.coalesce(F.contains(T.casefold("answer"), phrase), F.lit(False))
    return met.select(key, "no", inside.alias("in_answer"), F.coalesce(first.rlike(CITATION), F.lit(False)).alias("cited"))
