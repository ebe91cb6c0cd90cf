"""The registered queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from graphloom.plans import code_queries, graph_queries, search_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (graph_queries, search_queries, code_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
