"""The store as a folder: a text file for each revision under its asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_directory(revisions: DataFrame, folder: str) -> None:
    """Writes revisions (asset_id, revision_id, markdown) to folder; a revision that is there stays.

    Nulls in a key or text are left out. Each text ends with a line feed of the file's own."""
    spark = revisions.sparkSession
    rows = revisions.where(F.col("asset_id").isNotNull() & F.col("revision_id").isNotNull() & F.col("markdown").isNotNull()).select("asset_id", "revision_id", "markdown").dropDuplicates(["asset_id", "revision_id"])
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = rows.join(scan_directory(spark, folder).select("asset_id", "revision_id"), ["asset_id", "revision_id"], "left_anti")
    rows.repartition("asset_id").write.mode("append").partitionBy("asset_id", "revision_id").text(folder)


def scan_directory(spark: SparkSession, folder: str) -> DataFrame:
    """(asset_id, revision_id, markdown) of all revisions in folder."""
    rows = spark.read.schema("value string, asset_id string, revision_id string").text(folder, wholetext=True)
    return rows.select("asset_id", "revision_id", F.regexp_replace("value", r"\n\z", "").alias("markdown"))
