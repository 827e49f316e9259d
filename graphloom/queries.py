"""All catalogue queries of the engine and their SQL."""

from __future__ import annotations

from .plans import graph_queries, search_queries, temporal_queries, text_queries

assert all((graph_queries, search_queries, temporal_queries, text_queries))
QUERIES = dict(graph_queries.Q)
ORACLES = dict(graph_queries.O)
