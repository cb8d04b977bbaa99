"""All registered queries (Spark callables) and their DuckDB twins.

A twin is a string, or a function that makes it when the twins are asked for: what one twin
needs then never stands in the way of the queries.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ["q_variance", "q_joins", "q_longfact", "q_text", "q_finance", "q_support", "q_sources", "q_ml"]
_QUERIES: dict[str, Callable] = {}
_TWINS: dict[str, str | Callable[[], str]] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    """Decorator: the function is query ``name``, ``sql`` its twin (None: no SQL expresses it)."""

    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _TWINS[name] = sql
        return fn

    return deco


def queries() -> dict[str, Callable]:
    for m in MODULES:
        importlib.import_module(f"spendgrid.plans.{m}")
    return dict(_QUERIES)


def twin(name: str) -> str:
    """The twin of one query."""
    sql = _TWINS[name]
    return sql() if callable(sql) else sql


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: twin(name) for name in _TWINS}
