"""A search index that is written once and read by all searches: chunks with numbers, postings, vectors.

All tables are bucketed by the number of the chunk, so the terms of a chunk, its postings and its
vector lie together: building them from the chunks moves no rows, and the sum over the terms of a
query and chunk is made where the postings lie. Only the best rows of each query leave a task.

Vectors take many times the room of the texts that they are made of. They are stored when they are
first asked for; a search by the own encoder makes them from the chunks' texts as it goes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.operators import lexical, ranking, vectors
from tarnstone.runtime import broadcast_if_small, materialize, shared_dir

#: Chunks of a bucket, about.
BUCKET_CHUNKS = 50_000


@dataclass(frozen=True)
class Index:
    """chunks: chunk_no, length (number of terms), and the columns of the chunks; numbers rise in the
    order of chunk_id. postings: chunk_no, field, term, tf, length. frequency: field, term, df.
    statistics: one row n, average. vectors: chunk_no, idx, val (of length 1), made by encode of text."""

    chunks: DataFrame
    postings: DataFrame
    frequency: DataFrame
    statistics: DataFrame
    text: Column
    encode: Callable[[DataFrame, str, Column], DataFrame]
    buckets: int

    @cached_property
    def vectors(self) -> DataFrame:
        return _bucketed(self.encode(self.chunks, "chunk_no", self.text), "vectors", self.buckets)


def _bucketed(df: DataFrame, label: str, buckets: int) -> DataFrame:
    spark, name = df.sparkSession, f"tarnstone_{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "chunk_no").option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def _written(df: DataFrame, label: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/tarnstone_{label}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build(chunks: DataFrame, fields: dict[str, Column] | None = None, text: Column | None = None, encode: Callable[[DataFrame, str, Column], DataFrame] = vectors.sparse_vectors) -> Index:
    """The index of chunks (chunk_id and any columns), each chunk_id once.

    fields are those of the lexical index, text what the vectors are made of, encode what makes them
    (rows, key, text to key, idx, val, of length 1). Rows with chunk_id null are left out, null
    texts have no terms. Texts are shuffled once, here."""
    fields = fields or lexical.chunk_fields()
    text = text if text is not None else F.concat_ws("\n", F.array_join("heading_path", "\n"), F.coalesce("text", F.lit("")))
    known = chunks.where(F.col("chunk_id").isNotNull())
    numbers = materialize(known.select("chunk_id").distinct().orderBy("chunk_id").withColumn("chunk_no", F.monotonically_increasing_id()), "index-numbers")
    buckets = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-numbers.count() // BUCKET_CHUNKS))
    length = sum((F.size(lexical.T.terms(F.coalesce(c, F.lit("")))) for c in fields.values()), F.lit(0))
    once = known.join(broadcast_if_small(numbers), "chunk_id").withColumn("length", length).repartition(buckets, "chunk_no").dropDuplicates(["chunk_no"])
    stored = _bucketed(once, "chunks", buckets)
    postings = _bucketed(lexical.postings(stored, "chunk_no", fields), "postings", buckets)
    frequency = _written(lexical.document_frequency(postings), "frequency")
    statistics = _written(stored.agg(F.count("*").alias("n"), F.avg("length").alias("average")), "statistics")
    return Index(stored, postings, frequency, statistics, text, encode, buckets)


def of_table(spark: SparkSession, key: str, chunks: DataFrame, made: Callable[[], DataFrame] | None = None) -> Index:
    """The index of chunks that this session has under key; it is built at the first call, and again
    when the files of chunks have changed. made gives the same rows where making their plan runs jobs."""
    kept = spark.__dict__.setdefault("_tarnstone_indexes", {})
    files = chunks._jdf.queryExecution().optimizedPlan().toString() if not chunks.inputFiles() else "|".join(sorted(_version(spark, f) for f in chunks.inputFiles()))
    if key not in kept or kept[key][0] != files:
        kept[key] = files, build(made() if made else chunks)
    return kept[key][1]


def _version(spark: SparkSession, file: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return f"{file}:{status.getLen()}:{status.getModificationTime()}"


def lexical_scores(index: Index, terms: DataFrame, query: str, weights: dict[str, float] = lexical.CHUNK_WEIGHTS, within: DataFrame | None = None) -> DataFrame:
    """(query, chunk_no, score) by BM25 for terms (query, term). within (chunk_no) narrows what is
    scored, not the statistics."""
    posted = index.postings if within is None else index.postings.join(broadcast_if_small(within), "chunk_no", "left_semi")
    return lexical.scores(posted, "chunk_no", index.frequency, index.statistics, weights, terms, query)


def lexical_hits(index: Index, terms: DataFrame, query: str, limit: int, weights: dict[str, float] = lexical.CHUNK_WEIGHTS) -> DataFrame:
    """(query, chunk_no, score, rank): the best of lexical_scores, for many queries at once: no pair of
    a posting and a query becomes a row."""
    numbered = materialize(terms.select("term").distinct().coalesce(1).withColumn("term_no", F.monotonically_increasing_id().cast("int")), "term-numbers")
    values = lexical.values(index.postings, "chunk_no", index.frequency, index.statistics, weights, numbered)
    return ranking.term_hits(values, "chunk_no", terms.join(broadcast_if_small(numbered), "term").select(query, "term_no"), query, limit)


def semantic_hits(index: Index, queries: DataFrame, limit: int, floor: float | None = vectors.FLOOR, encode: Callable[[DataFrame], DataFrame] = vectors.ngram_blocks) -> DataFrame:
    """(query, key, score, rank): the chunks nearest to each of queries (key, text) by cosine; key is
    the number of the chunk. encode makes blocks of the queries as the index was made; a score must
    reach floor, or be above 0 where floor is None, as for encoders whose noise isn't known."""
    if encode is vectors.ngram_blocks and index.encode is vectors.sparse_vectors:
        return ranking.text_hits(index.chunks.select(F.col("chunk_no").alias("key"), index.text.alias("text")), queries, limit, floor)
    return vectors.search_blocks(vectors.sparse_blocks(index.vectors, "chunk_no"), encode(queries), limit, floor)


def lacking(index: Index, table: str) -> DataFrame:
    """(chunk_no, chunk_id) of the chunks without a row in postings or vectors: what is to be filled in.
    Chunks without terms have no postings and aren't lacking."""
    rows = {"postings": index.postings, "vectors": index.vectors}[table].select("chunk_no").distinct()
    return index.chunks.where(F.col("length") > 0).select("chunk_no", "chunk_id").join(rows, "chunk_no", "left_anti")


def outdated(index: Index, pointers: DataFrame) -> DataFrame:
    """(chunk_no, chunk_id) of the chunks in the index whose revision is no longer current.
    pointers: asset_id, revision_id."""
    return index.chunks.select("chunk_no", "chunk_id", "asset_id", "revision_id").join(pointers, ["asset_id", "revision_id"], "left_anti").select("chunk_no", "chunk_id")


def by_substrings(rows: DataFrame, key: str, fields: dict[str, Column], words: DataFrame, query: str, order: list[str], limit: int) -> DataFrame:
    """(query, key, score, rank): for queries without lexical hits the first limit rows, by order,
    that hold a word anywhere, also inside words; score is the number of words that they hold.

    words (query, word) are those of a stated query set; they meet the rows in at most 64
    arrays, and only rows that hold a word of a query come out of it."""
    asked = words.groupBy(query).agg(F.collect_set("word").alias("words")).groupBy(F.pmod(F.xxhash64(query), F.lit(64)).alias("block")).agg(F.collect_list(F.struct(query, "words")).alias("asked"))
    whole = F.concat_ws("\n", *(F.lower(F.coalesce(c, F.lit(""))) for c in fields.values()))
    met = rows.select(key, *order, whole.alias("whole")).crossJoin(broadcast_if_small(asked.select("asked")))  # a stated query set, in at most 64 blocks
    counted = F.transform("asked", lambda q: F.struct(q[query].alias(query), F.size(F.filter(q["words"], lambda w: F.contains(F.col("whole"), w))).alias("score")))
    each = met.select(key, *order, F.inline(F.filter(counted, lambda q: q["score"] > 0)))
    place = F.row_number().over(lexical.Window.partitionBy(query).orderBy(*order, key))
    return each.withColumn("rank", place).where(F.col("rank") <= limit).select(query, key, F.col("score").cast("double").alias("score"), "rank")
