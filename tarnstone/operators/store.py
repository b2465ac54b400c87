"""The store as tables: current pointers, immutable revisions, upserts and what an index lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.runtime import broadcast_if_small


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """For each key the row that is last by order; the aggregate combines on the map side, so a key
    with many rows costs one row a task. Rows with a null key are dropped."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"row.`{c}`").alias(c) for c in rest))


def current_assets(assets: DataFrame) -> DataFrame:
    """One row for each asset, the one put last; of equal times that with the largest pointer."""
    return latest(assets, ["asset_id"], [F.col("updated_at"), F.col("current_revision_id")])


def revisions_once(revisions: DataFrame) -> DataFrame:
    """Each revision once, the earliest delivery: a revision that exists is never overwritten."""
    first = F.min_by(F.struct(*[c for c in revisions.columns if c not in ("asset_id", "revision_id")]), F.struct("created_at")).alias("row")
    rest = [c for c in revisions.columns if c not in ("asset_id", "revision_id")]
    kept = revisions.where(F.col("asset_id").isNotNull() & F.col("revision_id").isNotNull())
    return kept.groupBy("asset_id", "revision_id").agg(first).select("asset_id", "revision_id", *(F.col(f"row.`{c}`").alias(c) for c in rest))


def pointers(assets: DataFrame) -> DataFrame:
    """(asset_id, revision_id): what is current."""
    return current_assets(assets.select("asset_id", "current_revision_id", "updated_at")).select("asset_id", F.col("current_revision_id").alias("revision_id")).where(F.col("revision_id").isNotNull())


def current_revisions(assets: DataFrame, revisions: DataFrame) -> DataFrame:
    """The revisions to which their assets point; a pointer to no revision gives none."""
    return revisions_once(revisions.join(pointers(assets), ["asset_id", "revision_id"], "left_semi"))


def current_chunks(assets: DataFrame, chunks: DataFrame, sized: bool = False) -> DataFrame:
    """The chunks of current revisions, each once. sized: the pointers are written and, if small,
    broadcast, so that texts aren't shuffled to meet them."""
    held = pointers(assets)
    return chunks.where(F.col("chunk_id").isNotNull()).join(broadcast_if_small(held) if sized else held, ["asset_id", "revision_id"], "left_semi").dropDuplicates(["chunk_id"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key. Keys must be unique in new."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with those rows of new whose key it doesn't have."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def put(assets: DataFrame, revisions: DataFrame, new_assets: DataFrame, new_revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets, revisions) after a batch was put: revisions that exist stay as they are, pointers
    move to what was put last, be it an older revision."""
    return upsert(current_assets(assets), current_assets(new_assets), ["asset_id"]), insert_missing(revisions_once(revisions), revisions_once(new_revisions), ["asset_id", "revision_id"])


def without_chunks(assets: DataFrame, revisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(asset_id, revision_id) of current revisions for which chunks are still to be made."""
    current = revisions.select("asset_id", "revision_id").join(pointers(assets), ["asset_id", "revision_id"], "left_semi").distinct()
    return current.join(chunks.select("asset_id", "revision_id"), ["asset_id", "revision_id"], "left_anti")


def delete(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """tables without the rows of the assets in gone (asset_id): what belongs to an asset goes with it.
    Rows with asset_id null belong to none and stay."""
    return {name: rows.join(gone.select("asset_id"), "asset_id", "left_anti") for name, rows in tables.items()}
