"""Folds cut into segments: a key with most of the events against row-by-row folds."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from groovehouse.operators import folds
from test_properties import _py_admit

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, album_id long, delta long"


def _admission(spark, stocks, data, holds, segment):
    albums = spark.createDataFrame(list(stocks.items()), "album_id long, stock long")
    cart = spark.createDataFrame(holds, "user_id long, album_id long, quantity long")
    events = spark.createDataFrame(data, EVENTS)
    out = folds.admit_cart_events(albums, cart, events, segment_events=segment)
    got = sorted((r.event_id, r.accepted, r.stock_after, r.cart_after) for r in out.collect())
    return got, _py_admit(dict(stocks), {(u, a): q for u, a, q in holds}, data)


def _stream(seed, n):
    rng = random.Random(seed)
    return [(i, T0 + dt.timedelta(minutes=rng.randint(0, n)), rng.randint(0, 12),
             0 if rng.random() < .6 else rng.choice([1, 2, 9]), rng.choice([1, 1, -1])) for i in range(n)]


@pytest.fixture()
def rounds(monkeypatch):
    """How often the segments were folded."""
    seen = []
    real = folds._fold_segments
    monkeypatch.setattr(folds, "_fold_segments", lambda *a: seen.append(1) or real(*a))
    return seen


@pytest.mark.parametrize("seed,stock", [(0, 5), (1, 0)])
def test_hot_album_that_sells_out(spark, seed, stock):
    """Most events on one album in segments of 60, sold out over and over."""
    got, want = _admission(spark, {0: stock, 1: 1000, 2: 3}, _stream(seed, 500),
                           [(u, 0, 1 + u % 2) for u in range(3)], 60)
    assert got == want


def test_album_that_never_runs_out_takes_one_round(spark, rounds):
    got, want = _admission(spark, {0: 1000, 1: 1000, 2: 1000, 9: 1000}, _stream(3, 500), [(1, 0, 2)], 20)
    assert got == want and len(rounds) == 1


def test_one_segment_an_album_takes_one_round(spark, rounds):
    got, want = _admission(spark, {0: 3, 1: 0, 2: 1}, _stream(4, 300), [(1, 0, 2)], 1000)
    assert got == want and len(rounds) == 1


def test_segments_of_a_hot_album_lie_in_several_tasks(spark):
    events = spark.range(1000).select(F.lit(0).cast("long").alias("album_id"), (F.col("id") % 9).alias("user_id"),
                                      F.floor(F.col("id") / 50).alias("_seg"), F.col("id").alias("event_id"),
                                      F.lit(1).cast("long").alias("delta"), F.col("id").alias("_rank"),
                                      F.lit(False).alias("_presumed"))
    stock = events.select("album_id").distinct().withColumn("stock", F.lit(100))
    cart = events.select("album_id", "user_id", F.lit(0).alias("quantity")).limit(0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny partitions are merged
    try:
        out = folds._fold_segments(events, folds._entries(events, stock, cart))
        assert out.select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _clicks(stock, lines, evs):
    state = {a: (q, False, n) for n, a, q in lines}
    for i, _ts, a, d in evs:
        x, by_event, birth = state.get(a, (0, False, None))
        if d > 0:
            if x == 0:
                x, by_event, birth = 1, True, i
            elif x + 1 <= 10 - stock[a]:
                x += 1
        else:
            x = max(0, x - 1)
        state[a] = (x, by_event, birth)
    return {a: v for a, v in state.items() if v[0] > 0}


@pytest.mark.parametrize("segment", [1, 7, 10_000])
def test_draft_clicks_in_segments(spark, segment):
    """Starts above the cap, caps below one, lines dropped and opened again."""
    stock = {1: 3, 2: 10, 3: 0, 4: 25, 5: 9, 6: 5}
    lines = [(1, 1, 4), (2, 3, 12), (3, 4, 40), (4, 5, 3), (5, 6, 30)]
    rng = random.Random(segment)
    evs = [(i, T0 + dt.timedelta(seconds=i), rng.choice([1, 1, 1, 2, 3, 4, 5, 6]), rng.choice([1, 1, -1, -1]))
           for i in range(400)]
    albums = spark.createDataFrame(list(stock.items()), "album_id long, stock long")
    start = spark.createDataFrame([(9, *r) for r in lines],
                                  "purchase_order long, line long, album_id long, quantity long")
    events = spark.createDataFrame([(i, ts, 9, a, d) for i, ts, a, d in evs],
                                   "event_id long, ts timestamp_ntz, purchase_order long, album_id long, delta long")
    out = folds.fold_draft_quantities(start, albums, events, partitions=5, segment_events=segment)
    assert {r.album_id: (r.quantity, r.born_by_event, r.birth) for r in out.collect()} == _clicks(stock, lines, evs)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
