"""Queries by name, with their DuckDB SQL: one module for each plane of the engine."""

from __future__ import annotations

from . import agent_queries, dataset_queries, evolution_queries, graph_queries, retrieval_queries, source_queries, text_queries, trajectory_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (graph_queries, retrieval_queries, text_queries, trajectory_queries, dataset_queries, evolution_queries, agent_queries, source_queries):
    QUERIES |= _module.Q.queries
    ORACLE_SQL |= _module.Q.sql
