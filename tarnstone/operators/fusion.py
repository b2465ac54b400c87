"""Ranked lists put together by weighted reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT, SEMANTIC_WEIGHT = 60, 0.35


def reciprocal_rank_fusion(lexical: DataFrame, semantic: DataFrame, query: str, key: str, semantic_weight: float = SEMANTIC_WEIGHT, k: int = RANK_CONSTANT) -> DataFrame:
    """(query, key, score, rank) of two lists (query, key, rank): the sum of weight / (k + rank).

    A list of weight 0 is left out of the plan. Equal scores rank by key; scores have nine decimals."""
    if not 0 <= semantic_weight <= 1:
        raise ValueError("semantic_weight must lie between 0 and 1")
    if k < 1:
        raise ValueError("k must be positive")
    lists = [(lexical, 1 - semantic_weight), (semantic, semantic_weight)]
    parts = [rows.select(query, key, (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("part")) for rows, w in lists if w > 0]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fused = both.groupBy(query, key).agg(F.round(F.sum("part"), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key)))
