"""Every registered query against its DuckDB oracle SQL (sf0.001)."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from groovehouse.plans import registry

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "conversations"]


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}" if abs(v) < 1e6 else f"{round(v, 4)}"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def _canon(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


# The shop's queries; those of the training-data operators are tested in tests/llm.
SQL = registry.oracle_sql()
QUERIES = registry.queries()
NAMES = sorted(QUERIES)


def test_every_query_registered_has_callable():
    assert set(SQL) <= set(NAMES)
    assert len(NAMES) >= 100


def _type(t) -> str:
    t = str(t).upper()
    return {"LONG": "BIGINT", "INTEGER": "INT", "STRING": "VARCHAR"}.get(t, t)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rel = duck.execute(SQL[name])
    spark_types = {f.name: _type(f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = {d[0]: _type(d[1]) for d in rel.description}
    assert spark_types == duck_types
    got = df.toPandas()
    want = rel.fetchdf()
    gc, gr = _canon(got)
    wc, wr = _canon(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


@pytest.mark.parametrize("name", sorted(set(NAMES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns[:3] == ["artist_id", "name", "album_id"]


@pytest.mark.parametrize("name", ["dispatch_report", "purchase_order_detail", "patch_rows",
                                  "dispatch_update_orders", "fold_cart", "local_times"])
def test_results_do_not_depend_on_session_zone(spark, duck, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = QUERIES[name](spark, SF_SMALL).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert _canon(got) == _canon(duck.execute(SQL[name]).fetchdf())
