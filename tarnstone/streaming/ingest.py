"""Files and revisions that keep arriving, put into the store as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving_revisions(spark: SparkSession, schema, path: str) -> DataFrame:
    """A stream of the revisions in the Parquet files that appear at path."""
    return spark.readStream.schema(schema).parquet(path)


def ingest(revisions: DataFrame, target: str, checkpoint: str, delay: str = "30 days") -> StreamingQuery:
    """Appends each revision once to the Parquet table at target, until the input is used up.

    A revision delivered again within delay of event time is dropped by the state that the
    watermark bounds; the sink commits each batch once, so a restart repeats and loses nothing."""
    keyed = revisions.where(F.col("asset_id").isNotNull() & F.col("revision_id").isNotNull())
    timed = keyed.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    once = timed.dropDuplicatesWithinWatermark(["asset_id", "revision_id"])
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of a stream of events by time windows; a window comes
    out when the watermark has passed its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
