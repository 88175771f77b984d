"""Importing this module registers every query."""

from lintlake.plans import (  # noqa: F401
    attempt_queries,
    detect_queries,
    finding_queries,
    needle_queries,
    repair_queries,
    source_queries,
    symbol_queries,
    text_queries,
)
from lintlake.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
