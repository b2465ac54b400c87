"""All queries of the library's core."""

from tarnstone.plans import documents, evaluation, retrieval, snapshots, store, streams  # noqa: F401  (each registers its queries)
from tarnstone.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
