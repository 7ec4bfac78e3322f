"""All queries of the engine by name, and the SQL they are compared with."""

from __future__ import annotations

from . import agent_queries, agreement_queries, answer_queries, book_queries, file_queries, index_queries, ingest_queries, search_queries, supply_queries, text_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
