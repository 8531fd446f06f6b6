"""Registered queries over the generated tables, and the SQL they are held against."""

from __future__ import annotations

from . import answer_queries, discovery_queries, retrieval_queries, state_queries, text_queries

_MODULES = (text_queries, discovery_queries, retrieval_queries, state_queries, answer_queries)

QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
