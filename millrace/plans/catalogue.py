"""The engine's own queries by name, with DuckDB SQL that must give the same rows."""

from __future__ import annotations

from millrace.plans import changes, documents, merges, services, streams  # noqa: F401  each registers its queries
from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
