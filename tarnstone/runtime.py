"""Session-level helpers: table access, shared intermediate tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of a side that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Most bits of a Bloom filter.
BLOOM_BITS = 1 << 26
#: Bytes of a value in memory by its type; others are measured.
_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Where that is unset, a single machine (tests) gets a temporary folder, and a cluster the
    warehouse, which its executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tarnstone_dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="spark-tarnstone-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_between"
        spark._tarnstone_dir = folder
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and the sizes of the
    files give the planner true statistics. Rows and schema stay as they are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.__dict__.setdefault("_tarnstone_tables", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_between(spark: SparkSession) -> int:
    """Deletes the tables that materialize wrote in this session, once the results are written, and
    returns their number. Stored indexes stay."""
    tables, spark._tarnstone_tables = spark.__dict__.get("_tarnstone_tables", []), []
    for table_ in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table_)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(tables)


def _sized(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, bool]:
    """(df, whether it is within the bounds of a broadcast). What has to be shuffled or computed in
    Python to be counted is written first, so that it is done once. What is only read and filtered
    is small if its files are a 64th of the bound, however well they are compressed; else it is
    counted, up to the bound."""
    rows = BROADCAST_ROWS if rows is None else rows
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(x in plan for x in ("Aggregate", "Join", "Deduplicate", "Window", "Sort", "MapIn", "Generate")):
        df = materialize(df, "side")
    read = df._jdf.queryExecution().optimizedPlan().collectLeaves().mkString().startswith("Relation")
    if read and rows >= BROADCAST_ROWS > 0 and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES >> 6:
        return df, True
    width = F.lit(sum(_WIDTHS.get(kind, 16) for _, kind in df.dtypes))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind not in _WIDTHS:
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    n, size = df.limit(rows + 1).select(width.cast("bigint").alias("width")).agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0))).first()
    return df, n <= rows and size <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and BROADCAST_BYTES, else df as it is.

    Beyond the bound the join shuffles, and adaptive execution splits its skewed partitions."""
    df, small = _sized(df, rows)
    return F.broadcast(df) if small else df


def join_few(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined on the columns on with few, of which most rows find none: an inner or left_semi join.

    If few is small it is broadcast. Else rows with long values, such as texts, aren't shuffled to
    find that most of them have no partner: a Bloom filter of few's keys, of at most BLOOM_BITS, is
    broadcast and drops them where they are read; what it lets through by chance the join drops.
    With more keys than the filter has room for more goes through, but nothing is lost."""
    few, small = _sized(few)
    if small:
        return rows.join(F.broadcast(few), on, how)
    return _may_hold(rows, few, on).join(few, on, how)


def _may_hold(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """rows without those that the Bloom filter of few's keys excludes; null keys go out."""
    spark = rows.sparkSession
    bits = 1 << max(10, min(BLOOM_BITS.bit_length() - 1, (16 * few.count()).bit_length()))

    def places(side: list[Column]) -> list[Column]:
        return [F.pmod(F.xxhash64(*side, F.lit(i)), F.lit(bits)) for i in range(3)]

    known = few.select(F.explode(F.array(*places([F.col(c) for c in on]))).alias("place")).groupBy(F.shiftright("place", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    words = spark.range(bits // 64).join(known, "id", "left").fillna(0, ["bits"])
    filter_ = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("_words"))  # one row of bits / 64 numbers
    held = F.lit(True)
    for place in places([F.col(c) for c in on]):
        word = F.get("_words", F.shiftright(place, 6).cast("int"))
        held = held & (F.call_function("getbit", word, F.pmod(place, F.lit(64)).cast("int")) == 1)
    return rows.join(F.broadcast(materialize(filter_, "bloom")), held, "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if a small file gives it fewer; else as it is.

    For stages that work hard on each row. Data in many files or row groups has the partitions it
    needs already and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
