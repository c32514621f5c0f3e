"""All registered queries of the library and their SQL."""

from __future__ import annotations

from tidebars.plans import aggregate_queries, evaluation_queries, event_queries, feature_queries, label_queries, model_queries, policy_queries, research_queries

_MODULES = (feature_queries, label_queries, aggregate_queries, event_queries, model_queries, research_queries, evaluation_queries, policy_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
