"""Queries that run a stream over a given table until it is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.plans.registry import query
from tarnstone.runtime import shared_dir, table
from tarnstone.streaming import ingest


@query("SELECT DISTINCT asset_id, revision_id FROM asset_revisions WHERE asset_id IS NOT NULL AND revision_id IS NOT NULL")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "asset_revisions").schema
    ingest.ingest(ingest.arriving_revisions(spark, schema, f"{d}/asset_revisions.parquet*"), f"{place}/table", f"{place}/state", "36500 days").awaitTermination()
    return spark.read.parquet(f"{place}/table").select("asset_id", "revision_id")


@query("""SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows of the event stream that the watermark has closed."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    events = events.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"))  # the tables hold UTC without a zone
    counted = ingest.windowed_counts(events, "1 day", "10 minutes")
    counted.writeStream.format("parquet").option("path", f"{place}/table").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/table").withColumn("window_start", F.expr("timestampadd(MICROSECOND, unix_micros(window_start), timestamp_ntz'1970-01-01 00:00:00')"))
