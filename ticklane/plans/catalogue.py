"""All registered queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import book_queries, evaluation_queries, feature_queries, market_queries, model_queries, source_queries, stream_queries, tree_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "asof_signed_flow"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
