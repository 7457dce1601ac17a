"""Registered queries over the given tables, and their DuckDB equivalents."""

from attnmaps.plans import q_filters, q_jobs, q_rasters, q_stats  # noqa: F401  they register their queries
from attnmaps.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
