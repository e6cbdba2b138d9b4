"""All queries of the log library by name, with their SQL."""

from __future__ import annotations

from tidelog.plans import receipt_queries, registry, store_queries
from tidelog.plans.registry import ORACLE, QUERIES, flagship

__all__ = ["ORACLE", "QUERIES", "flagship", "receipt_queries", "registry", "store_queries"]
