"""Registry of the queries over the given tables and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "e14_synthesize_multi"

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def add(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    from brindle.plans import queries_ac, queries_df, queries_gh, queries_il, queries_templates  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
