"""Registered queries and their DuckDB oracle SQL.

Each query is a function of a ``Shop`` (the reference-shaped tables over one
scale-factor folder) returning a DataFrame.  Nested results are compared as
text built the same way in both engines.  Every integer column is BIGINT,
money is rounded to cents and given as DOUBLE, timestamps as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.fixtures import Shop
from .fixture_sql import with_views

QUERIES: dict[str, Callable[[Shop], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RAW_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            RAW_SQL[name] = sql
            ORACLES[name] = with_views(sql)
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from . import (q_accounts, q_audits, q_catalogue, q_changes, q_sources,  # noqa: F401
                   q_streams, q_supply)


def queries() -> dict[str, Callable]:
    _load_all()
    return {n: (lambda spark, sf_dir, _f=f: _f(Shop(spark, sf_dir))) for n, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)
