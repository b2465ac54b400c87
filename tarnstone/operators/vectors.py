"""Character n-gram vectors and dense vectors, cosine similarity and nearest rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.functions import text as T
from tarnstone.runtime import broadcast_if_small, materialize

#: Coordinates of a vector, weights of a word and of one of its n-grams, least similarity of a hit.
DIMENSIONS, WORD_WEIGHT, GRAM_WEIGHT, FLOOR = 2048, 2.0, 0.5, 0.12
GRAMS = (2, 3, 4)


def sha_bucket(feature: Column, dimensions: int = DIMENSIONS) -> Column:
    """A coordinate from the digest of a feature."""
    return F.pmod(F.conv(F.substring(F.sha2(feature, 256), 1, 12), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int")


def word_features(word: Column) -> Column:
    """An array of (feature, weight) of a word: the word itself, and its n-grams between ^ and $."""
    edged = F.concat(F.lit("^"), word, F.lit("$"))
    own = F.array(F.struct(F.concat(F.lit("w:"), word).alias("feature"), F.lit(WORD_WEIGHT).alias("weight")))

    def grams(n: int) -> Column:
        starts = F.when(F.length(edged) >= n, F.sequence(F.lit(1), F.length(edged) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.concat(F.lit(f"c{n}:"), F.substring(edged, i, F.lit(n))).alias("feature"), F.lit(GRAM_WEIGHT).alias("weight")))

    return F.concat(own, *map(grams, GRAMS))


def ngram_vectors(rows: DataFrame, key: str, text: Column, bucket: Callable[[Column], Column] = sha_bucket) -> DataFrame:
    """(key, idx, val): sparse vectors of length 1. Features are made and hashed once for each
    different word of all rows; texts without words have none."""
    counted = rows.select(key, F.explode(T.words(text)).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    features = counted.select("word").distinct().select("word", F.inline(word_features(F.col("word")))).select("word", bucket(F.col("feature")).alias("idx"), "weight").groupBy("word", "idx").agg(F.sum("weight").alias("weight"))
    raw = counted.join(features, "word").groupBy(key, "idx").agg(F.sum(F.col("n") * F.col("weight")).alias("val"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    return raw.join(norm, key).select(key, "idx", (F.col("val") / F.col("norm")).alias("val"))


def sparse_cosine(queries: DataFrame, query: str, rows: DataFrame, key: str, floor: float = FLOOR) -> DataFrame:
    """(query, key, score) of vectors of length 1 by joining on their coordinates; scores from floor
    on, with six decimals."""
    wanted = queries.select(F.col(query), "idx", F.col("val").alias("of_query"))
    met = rows.join(broadcast_if_small(wanted), "idx")
    return met.groupBy(query, key).agg(F.round(F.sum(F.col("val") * F.col("of_query")), 6).alias("score")).where(F.col("score") >= floor)


class Encoder:
    """Texts as dense vectors of length 1 (zero without words); keeps the coordinates of words it has met."""

    def __init__(self, digest: str = "sha", dimensions: int = DIMENSIONS) -> None:
        self.digest, self.dimensions, self.known, self.grams = digest, dimensions, {}, {}

    def bucket(self, feature: str) -> int:
        data = feature.encode()
        if self.digest == "sha":
            return int(hashlib.sha256(data).hexdigest()[:12], 16) % self.dimensions
        return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little") % self.dimensions

    @staticmethod
    def words(text: str | None) -> list[str]:
        return re.findall(r"\w+", (text or "").lower().replace("ß", "ss"))

    def of_word(self, word: str) -> np.ndarray:
        """The coordinates of a word and of its n-grams, the word's own first."""
        found = self.known.get(word)
        if found is None:
            edged = f"^{word}$"
            if len(self.known) > 50_000:
                self.known.clear()
            if len(self.grams) > 200_000:
                self.grams.clear()
            at = [self.bucket(f"w:{word}")]
            for n in GRAMS:
                for i in range(len(edged) - n + 1):
                    gram = edged[i : i + n]
                    if (place := self.grams.get(gram)) is None:
                        place = self.grams[gram] = self.bucket(f"c{n}:{gram}")
                    at.append(place)
            found = self.known[word] = np.array(at, np.int32)
        return found

    def sums(self, texts: list[str | None], across: bool = False) -> np.ndarray:
        """A line of summed weights for each text; across: a column."""
        words = [self.words(t) for t in texts]
        parts = [self.of_word(w) for line in words for w in line]
        shape = (self.dimensions, len(texts)) if across else (len(texts), self.dimensions)
        if not parts:
            return np.zeros(shape)
        size = np.array([len(x) for x in parts])
        line = np.repeat(np.arange(len(texts)), [len(x) for x in words])
        weight = np.full(size.sum(), GRAM_WEIGHT)
        weight[np.cumsum(size) - size] = WORD_WEIGHT
        at = np.concatenate(parts)
        at = at * len(texts) + np.repeat(line, size) if across else at + np.repeat(line * self.dimensions, size)
        return np.bincount(at, weight, shape[0] * shape[1]).reshape(shape)

    def norms(self, texts: list[str | None]) -> np.ndarray:
        return np.sqrt((self.sums(texts) ** 2).sum(axis=1))

    def encode(self, texts: list[str | None]) -> np.ndarray:
        v = self.sums(texts)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return v / np.where(norm > 0, norm, 1.0)


def sparse_vectors(rows: DataFrame, key: str, text: Column, digest: str = "sha", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, idx, val): the vectors of ngram_vectors as one row each, idx ascending, to be stored.
    A worker hashes each word once; texts without words have empty arrays. digest: sha, or blake2b
    for the features under a 64-bit BLAKE2b digest, which Spark has no function for. Dense vectors are
    held for 256 texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(digest, dimensions)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                v = encoder.encode(part.column(1).to_pylist())
                line, idx = np.nonzero(v)
                ends = pa.array(np.searchsorted(line, np.arange(len(v) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (idx.astype(np.int32), v[line, idx])]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=[key, "idx", "val"])

    return rows.select(key, text.alias("text")).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, idx array<int>, val array<double>")


def sparse_blocks(rows: DataFrame, key: str, size: int = 256, dimensions: int = DIMENSIONS) -> DataFrame:
    """Stored vectors (key, idx, val) as blocks (keys, vectors) of at most size, filled in for the
    product only; vectors without coordinates are left out."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                idx, val = part.column(1), part.column(2)
                starts = idx.offsets.to_numpy()
                x = np.zeros((part.num_rows, dimensions))
                x[np.repeat(np.arange(part.num_rows), np.diff(starts)), idx.flatten().to_numpy()] = val.flatten().to_numpy()
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([keys, pa.array([x.tobytes()], pa.binary())], names=["keys", "vectors"])

    return rows.where(F.size("idx") > 0).select(key, "idx", "val").mapInArrow(run, f"keys array<{kind}>, vectors binary")


def ngram_blocks(rows: DataFrame, digest: str = "sha", size: int = 256, dimensions: int = DIMENSIONS) -> DataFrame:
    """rows (key, text) as blocks (keys, vectors) of at most size vectors of length 1, whose
    coordinates are those of sparse_vectors."""
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(digest, dimensions)
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                x = encoder.encode(part.text.tolist())
                yield pd.DataFrame({"keys": [part.key.to_numpy()], "vectors": [x.tobytes()]})

    return rows.select("key", "text").mapInPandas(run, f"keys array<{kind}>, vectors binary")


def dense_blocks(rows: DataFrame, size: int = 1024) -> DataFrame:
    """rows (key, vector) as blocks (keys, vectors) of at most size vectors of length 1; null vectors
    are left out."""
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                x = np.array(part.vector.tolist(), np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                yield pd.DataFrame({"keys": [part.key.to_numpy()], "vectors": [x.tobytes()]})

    return rows.where(F.col("vector").isNotNull()).select("key", "vector").mapInPandas(run, f"keys array<{kind}>, vectors binary")


def search_blocks(rows: DataFrame, queries: DataFrame, limit: int, floor: float | None = -1.0, same: bool = True) -> DataFrame:
    """(query, key, score, rank): for each query the limit nearest rows by cosine from floor on; with
    floor None all above 0.

    The blocks of a stated query set meet the blocks of the rows, one matrix product a pair, and of
    each product only limit rows a query go on. Up to 32 blocks of queries are broadcast; of more,
    the pairs of blocks are spread over the cluster. same: whether a row may answer its own key."""
    from tarnstone.operators.lexical import top

    kind, of_query = (dict(x.dtypes)["keys"].removeprefix("array<").removesuffix(">") for x in (rows, queries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, vectors, names, asked in zip(b["keys"], b.vectors, b.names, b.asked):
                x, q = np.frombuffer(vectors).reshape(len(keys), -1), np.frombuffer(asked).reshape(len(names), -1)
                score, keys = np.round(q @ x.T, 6), np.asarray(keys)
                kept = score > 0 if floor is None else score >= floor
                for name, line, near in zip(names, score, kept):
                    at = np.flatnonzero(near) if same else np.flatnonzero(near & (keys != name))
                    at = at[np.lexsort((keys[at], -line[at]))][:limit]
                    yield pd.DataFrame({"query": name, "key": keys[at], "score": line[at]})

    asked = queries.select(F.col("keys").alias("names"), F.col("vectors").alias("asked"))
    met = rows.crossJoin(broadcast_if_small(materialize(asked, "query-blocks"), 32))  # a stated query set, in blocks
    return top(met.mapInPandas(run, f"query {of_query}, key {kind}, score double"), "query", "key", limit)


def dense_cosine(a: Column, b: Column, strict: bool = False) -> Column:
    """The cosine of two arrays of equal length; 0 if one has no length; where the sizes differ null,
    or an error if strict."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    other = F.raise_error(F.lit("vectors of different sizes")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)).otherwise(other)


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, limit: int) -> DataFrame:
    """(query, key, score, rank): for each row of queries the limit nearest other rows by cosine."""
    pair = [F.col(key).alias("key"), F.col(vector).alias("vector")]
    found = search_blocks(dense_blocks(rows.select(*pair)), dense_blocks(queries.select(*pair)), limit, same=False)
    return found.withColumnRenamed("key", key)
