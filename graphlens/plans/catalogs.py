"""All queries of the library but those of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from graphlens.plans import context_queries, extract_queries, link_queries, search_queries, table_queries

_MODULES = [extract_queries, search_queries, table_queries, link_queries, context_queries]


def queries() -> dict[str, Callable]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
