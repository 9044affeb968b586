"""Named queries over the test tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from grainline.plans import attribute_queries, graph_queries, source_queries, store_queries

QUERIES = graph_queries.QUERIES | attribute_queries.QUERIES | source_queries.QUERIES | store_queries.QUERIES
ORACLE_SQL = graph_queries.SQL | attribute_queries.SQL | source_queries.SQL | store_queries.SQL
