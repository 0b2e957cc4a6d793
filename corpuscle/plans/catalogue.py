"""The named queries over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

from corpuscle.plans import corpus, health, relations, reports  # noqa: F401  they register their queries
from corpuscle.plans.registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
FLAGSHIP = "q25_file_capped_scores"
