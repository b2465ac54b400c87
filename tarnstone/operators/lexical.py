"""Lexical search: BM25 with a weight for each field, over postings of the query's terms only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.functions import text as T
from tarnstone.runtime import broadcast_if_small, materialize

K1, B = 1.2, 0.75
#: Weights of the fields of a chunk, and of an asset.
CHUNK_WEIGHTS = {"source_name": 5.0, "heading": 3.0, "text": 1.0}
ASSET_WEIGHTS = {"source_name": 5.0, "markdown": 1.0}


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, term): the different words of each query and their index terms."""
    word = queries.select(key, F.explode(F.array_distinct(T.words(F.col(text)))).alias("word"))
    return word.select(key, "word", F.explode(T.terms(F.col("word"))).alias("term"))


def postings(rows: DataFrame, key: str, fields: dict[str, Column], wanted: DataFrame | None = None) -> DataFrame:
    """(key, field, term, tf, length): the terms of each field with their number, and the number of
    terms of the row over all fields. wanted (term) keeps the rest out before anything is shuffled."""
    counted = rows.select(key, *(T.terms(F.coalesce(c, F.lit(""))).alias(f) for f, c in fields.items()))
    length = sum((F.size(f) for f in fields), F.lit(0))

    def tagged(field: str) -> Column:
        return F.transform(F.col(field), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))

    if wanted is None:
        return _counted(counted, key, list(fields))
    pairs = F.flatten(F.array(*map(tagged, fields)))
    each = counted.select(key, length.alias("length"), F.inline(pairs)).join(broadcast_if_small(wanted.select("term").distinct()), "term", "left_semi")
    return each.groupBy(key, "field", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def _counted(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """postings of rows (key, an array of terms for each field), each key once: a row's terms are counted
    where it is read, in slices of rows."""
    size = 2048

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                lists = part.columns[1:]
                length = sum(x.value_lengths().to_numpy() for x in lists)
                for field, terms in zip(fields, lists):
                    row = np.repeat(np.arange(part.num_rows), terms.value_lengths().to_numpy())
                    coded = terms.flatten().dictionary_encode()
                    n = max(len(coded.dictionary), 1)
                    pair, tf = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
                    row, code = pair // n, pair % n
                    named = pa.array([field]).take(pa.array(np.zeros(len(pair), np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), named, coded.dictionary.take(pa.array(code)), pa.array(tf.astype(np.int64)), pa.array(length[row].astype(np.int32))], names=[key, "field", "term", "tf", "length"])

    return rows.select(key, *fields).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, field string, term string, tf bigint, length int")


def corpus_statistics(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """One row: n, the number of rows, and average, their mean number of terms."""
    length = sum((F.size(T.terms(F.coalesce(c, F.lit("")))) for c in fields.values()), F.lit(0))
    return rows.agg(F.count("*").alias("n"), F.avg(length).alias("average"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """(field, term, df)."""
    return posted.groupBy("field", "term").agg(F.count("*").alias("df"))


def scores(posted: DataFrame, key: str, frequency: DataFrame, statistics: DataFrame, weights: dict[str, float], terms: DataFrame, query: str) -> DataFrame:
    """(query, key, score): each row with a term of the query, by BM25 with a frequency and a weight
    for each field; a term in more than half of the rows counts a millionth. Scores have six decimals.

    posted: see postings; frequency: field, term, df; statistics: n, average. The weight of a term
    in a field is worked out once for each query, not for each posting."""
    met = _met(posted, frequency, statistics, weights, terms.select(query, "term"))
    return met.groupBy(query, key).agg(F.round(F.sum("part"), 6).alias("score"))


def values(posted: DataFrame, key: str, frequency: DataFrame, statistics: DataFrame, weights: dict[str, float], numbered: DataFrame) -> DataFrame:
    """(key, term_no, value) of the terms numbered (term, term_no), one for each field: what scores adds up."""
    return _met(posted, frequency, statistics, weights, numbered).select(key, "term_no", F.col("part").alias("value"))


def _met(posted: DataFrame, frequency: DataFrame, statistics: DataFrame, weights: dict[str, float], asked: DataFrame) -> DataFrame:
    """posted with what is asked of each term (asked: term and other columns) and part, its share of a score."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.lit(0.0)
    for field, w in weights.items():
        weight = F.when(F.col("field") == field, F.lit(w)).otherwise(weight)
    rest = [c for c in asked.columns if c != "term"]
    gains = asked.join(frequency, "term").crossJoin(F.broadcast(statistics))  # one row
    gains = gains.select(*rest, "field", "term", (F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * (K1 + 1)).alias("gain"), weight.alias("weight"), "average")
    tf = F.col("tf") * F.col("weight")
    part = F.col("gain") * tf / (tf + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return posted.join(broadcast_if_small(materialize(gains, "asked-terms")), ["field", "term"]).withColumn("part", part)


def bm25(rows: DataFrame, key: str, fields: dict[str, Column], weights: dict[str, float], terms: DataFrame, query: str) -> DataFrame:
    """scores of rows that no index holds: the postings of the queries' terms are made here."""
    posted = materialize(postings(rows, key, fields, terms), "postings")
    return scores(posted, key, document_frequency(posted), corpus_statistics(rows, fields), weights, terms, query)


def top(scores: DataFrame, query: str, key: str, limit: int, score: str = "score") -> DataFrame:
    """scores with rank, the best limit rows of each query; equal scores by key. The limit goes
    below the shuffle, so a query with many hits costs limit rows a task."""
    order = Window.partitionBy(query).orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def chunk_fields() -> dict[str, Column]:
    return {"source_name": F.col("source_name"), "heading": F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " "), "text": F.col("text")}
