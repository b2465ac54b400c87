"""Queries over deliveries of full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.operators import snapshots
from tarnstone.plans.registry import query
from tarnstone.runtime import table

_BLANK = r"[\t\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


_STATE = rf"""
WITH clean AS (
  SELECT snapshot_no, asset_id, delivered_at, current_revision_id AS r,
         regexp_replace(lower(trim(source_hash)), '^sha256:', '') AS h,
         regexp_replace(regexp_replace(markdown, '{_BLANK}+(\n)', '\1', 'g'), '({_BLANK}|\n)+$', '') AS m
  FROM asset_snapshots WHERE asset_id IS NOT NULL AND snapshot_no IS NOT NULL),
state AS (SELECT snapshot_no, asset_id, r, h, m FROM clean
          QUALIFY row_number() OVER (PARTITION BY snapshot_no, asset_id ORDER BY delivered_at DESC NULLS LAST) = 1)"""


@query(
    _STATE
    + """,
numbers AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS following FROM (SELECT DISTINCT snapshot_no FROM state)),
pairs AS (SELECT coalesce(a.asset_id, b.asset_id) AS asset_id, coalesce(a.following, b.snapshot_no) AS snapshot_no,
                 CASE WHEN b.asset_id IS NULL THEN 'removed' WHEN a.asset_id IS NULL THEN 'added'
                      WHEN a.r IS DISTINCT FROM b.r OR a.h IS DISTINCT FROM b.h OR a.m IS DISTINCT FROM b.m THEN 'changed' END AS change_kind
          FROM (SELECT s.*, n.following FROM state s JOIN numbers n USING (snapshot_no) WHERE n.following IS NOT NULL) a
          FULL JOIN (SELECT * FROM state WHERE snapshot_no > (SELECT min(snapshot_no) FROM state)) b
          ON a.asset_id = b.asset_id AND a.following = b.snapshot_no)
SELECT asset_id, snapshot_no, change_kind FROM pairs WHERE change_kind IS NOT NULL"""
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "asset_snapshots"))


@query(
    _STATE
    + """,
numbers AS (SELECT snapshot_no, row_number() OVER (ORDER BY snapshot_no) - 1 AS pos FROM (SELECT DISTINCT snapshot_no FROM state)),
placed AS (SELECT asset_id, pos, md5(concat_ws(chr(0), coalesce('=' || r, '~'), coalesce('=' || h, '~'), coalesce('=' || m, '~'))) AS digest FROM state JOIN numbers USING (snapshot_no)),
begun AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(digest) OVER w = digest THEN 0 ELSE 1 END AS start FROM placed WINDOW w AS (PARTITION BY asset_id ORDER BY pos)),
island AS (SELECT *, sum(start) OVER (PARTITION BY asset_id ORDER BY pos) AS no FROM begun)
SELECT asset_id, min(pos)::BIGINT AS first_at, max(pos)::BIGINT AS last_at, any_value(digest) AS digest FROM island GROUP BY asset_id, no"""
)
def p3_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "asset_snapshots")
    digest = snapshots.row_hash(F.col("current_revision_id"), snapshots.normal_hash(F.col("source_hash")), snapshots.normal_text(F.col("markdown")))
    states = snapshots.latest_states(rows, "asset_id", "snapshot_no", "delivered_at", digest)
    return snapshots.validity_intervals(states, snapshots.snapshot_numbers(rows, "snapshot_no"), "asset_id", "snapshot_no").select("asset_id", "first_at", "last_at", "digest")
