"""Every registered query of the flow engine, with its DuckDB text."""

from __future__ import annotations

from . import table_queries, window_queries

QUERIES: dict = window_queries.QUERIES | table_queries.QUERIES
ORACLE_SQL: dict[str, str] = window_queries.ORACLE_SQL | table_queries.ORACLE_SQL
