"""Registry of the text-preparation queries (``opN_<name>``) and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def add(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    from brindle.llm import alignment, bpe, collocations, fingerprints, jaccard, language, minhash, packing, pages, pii, quality, sharding, urls  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(sorted(_QUERIES.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
