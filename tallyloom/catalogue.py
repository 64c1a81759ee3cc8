"""All queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from tallyloom.plans import advice, learning, profiling, relations, reports, series, sources, texts, timelines  # noqa: F401  each registers its queries
from tallyloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
