"""Change events between full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.runtime import spread

#: White space that counts for nothing at the end of a line or of a text; the line feed is apart.
BLANKS = "\t\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normal_text(text: Column) -> Column:
    """text with CRLF as LF, without blanks at line ends and at its end. Only ends are looked at."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.rtrim(x, F.lit(BLANKS)))
    return F.rtrim(F.array_join(lines, "\n"), F.lit(BLANKS + "\n"))


def normal_hash(digest: Column) -> Column:
    """A source hash in lower case, without blanks around it and without the prefix sha256:."""
    return F.regexp_replace(F.lower(F.trim(digest)), r"^sha256:", "")


def row_hash(*columns: Column) -> Column:
    """A digest of the values in which null differs from every string."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.md5(F.concat_ws("\u0000", *parts))


def latest_states(rows: DataFrame, key: str, snapshot: str, delivered: str, digest: Column) -> DataFrame:
    """(key, snapshot, digest): of several deliveries for one key and snapshot the latest.

    A tie in the time of delivery goes to the largest digest, so that the result doesn't depend on
    the order of the rows. The reduction to a digest comes before the shuffle, and the aggregate
    combines on the map side, so a key with many repeats costs one row a task."""
    return (
        rows.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
        .select(key, snapshot, F.struct(F.col(delivered).alias("at"), digest.alias("digest")).alias("state"))
        .groupBy(key, snapshot)
        .agg(F.max("state").alias("state"))
        .select(key, snapshot, F.col("state.digest").alias("digest"))
    )


def validity_intervals(states: DataFrame, numbers: DataFrame, key: str, snapshot: str) -> DataFrame:
    """Gaps and islands: (key, digest, first_at, last_at), positions of snapshots in numbers.

    states holds one row per key and snapshot; numbers (snapshot, at) counts the delivered
    snapshots from 0. A run of consecutive positions with one digest is one interval."""
    order = Window.partitionBy(key).orderBy("at")
    at = states.join(F.broadcast(numbers), snapshot)
    starts = (F.lag("at").over(order) == F.col("at") - 1) & (F.lag("digest").over(order) == F.col("digest"))
    return (
        at.withColumn("start", F.when(starts, 0).otherwise(1))
        .withColumn("island", F.sum("start").over(order))
        .groupBy(key, "island")
        .agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.first("digest").alias("digest"))
    )


def snapshot_numbers(rows: DataFrame, snapshot: str) -> DataFrame:
    """(snapshot, at): the delivered snapshot numbers counted from 0.

    One row per delivery of the whole table, so the single partition of the ranking holds as many
    rows as there are deliveries, whatever their size."""
    distinct = rows.select(snapshot).where(F.col(snapshot).isNotNull()).distinct()
    return distinct.withColumn("at", (F.row_number().over(Window.orderBy(snapshot)) - 1).cast("int"))


def change_events(intervals: DataFrame, numbers: DataFrame, key: str, snapshot: str) -> DataFrame:
    """(key, snapshot, change_kind): added at an interval's start, removed after its end, changed
    where two intervals of a key are adjacent. The first snapshot gives no events."""
    order = Window.partitionBy(key).orderBy("first_at")
    around = intervals.withColumns({"before": F.lag("last_at").over(order), "after": F.lead("first_at").over(order)})
    starts = F.when(F.col("before") == F.col("first_at") - 1, "changed").otherwise("added")
    ends = F.when(F.col("after").isNull() | (F.col("after") != F.col("last_at") + 1), "removed")
    kinds = F.array(F.struct(F.col("first_at").alias("at"), starts.alias("change_kind")), F.struct((F.col("last_at") + 1).alias("at"), ends.alias("change_kind")))
    events = around.select(key, F.inline(kinds)).where(F.col("change_kind").isNotNull() & (F.col("at") > 0))
    return events.join(F.broadcast(numbers), "at").select(key, snapshot, "change_kind")


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """(asset_id, snapshot_no, change_kind) from deliveries of the catalogue.

    rows: snapshot_no, delivered_at, asset_id, current_revision_id, source_hash, markdown; further
    columns don't matter. Repeated rows count once, of several rows for one asset and snapshot the
    latest delivery holds, null equals only null, a row without asset_id or snapshot_no is no
    record, and an empty table gives no events. delivered_at null is earlier than any time."""
    digest = row_hash(F.col("current_revision_id"), normal_hash(F.col("source_hash")), normal_text(F.col("markdown")))
    rows = spread(rows.select("snapshot_no", "delivered_at", "asset_id", "current_revision_id", "source_hash", "markdown"))
    states = latest_states(rows, "asset_id", "snapshot_no", "delivered_at", digest)
    numbers = snapshot_numbers(rows, "snapshot_no")
    return change_events(validity_intervals(states, numbers, "asset_id", "snapshot_no"), numbers, "asset_id", "snapshot_no")
