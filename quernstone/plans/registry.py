"""All registered queries of the retrieval and curation engine."""

from __future__ import annotations

from collections.abc import Callable

#: name -> callable (spark, sf_dir) -> DataFrame
_QUERIES: dict[str, Callable] = {}
#: name -> DuckDB SQL
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator that files a query under ``name``, with its SQL where there is one."""

    def keep(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return keep


def _load() -> None:
    from quernstone.plans import code_queries, io_queries, model_queries, retrieval_queries, text_queries, upkeep_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
