"""All queries by name, and DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from .plans import activity_queries, belief_queries, further_queries, ingest_queries, late_queries, more_queries, recall_queries, text_queries  # noqa: F401  registers
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
