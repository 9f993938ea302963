"""Positions and numbers inside a key by fixed bounds, against plain windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from groovehouse.operators.positions import (SortKey, cut_points, edge_carry, global_positions,
                                             rank_within)


@pytest.fixture(scope="module")
def hot(spark):
    """Four tenths of the rows on one key, null keys, null and tied values."""
    rng = random.Random(1)
    rows = [(None if rng.random() < .1 else 7 if rng.random() < .4 else rng.randint(0, 50),
             rng.choice([None, "a", "b", "ü", "zz"]), i) for i in range(3000)]
    return spark.createDataFrame(rows, "k long, s string, i long").repartition(5)


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


ORDERS = [["s DESC NULLS FIRST", "i ASC"], ["s ASC", "i DESC"], ["s DESC", "i"], ["s ASC NULLS LAST", "i"]]


def _columns(order):
    keys = [SortKey.of(o) for o in order]
    return [k.sorted(F.col(k.text)) for k in keys]


def test_sort_keys_from_columns(spark):
    texts = [F.col("s").desc_nulls_first(), F.col("s").asc(), F.col("s").desc(), F.col("s"),
             F.col("s").asc_nulls_last()]
    assert [SortKey.of(c) for c in texts] == [
        SortKey("s", True, True), SortKey("s", False, True), SortKey("s", True, False),
        SortKey("s", False, True), SortKey("s", False, False)]


@pytest.mark.parametrize("at", range(len(ORDERS)))
def test_rank_within_a_hot_key(spark, hot, at):
    want = hot.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*_columns(ORDERS[at]))).cast("long"))
    assert _rows(rank_within(hot, ["k"], ORDERS[at], "r", partitions=13)) == _rows(want)


@pytest.mark.parametrize("at", range(len(ORDERS)))
def test_global_positions(spark, hot, at):
    order = ["k ASC NULLS LAST", *ORDERS[at]]
    want = hot.withColumn("p", F.row_number().over(Window.orderBy(*_columns(order))).cast("long"))
    assert _rows(global_positions(hot, order, "p", partitions=13)) == _rows(want)


def test_empty_table(spark, hot):
    assert rank_within(hot.limit(0), ["k"], [F.col("i").asc()], "r").count() == 0
    assert global_positions(hot.limit(0), [F.col("i").asc()], "p").count() == 0


def test_buckets_repeat_and_only_split_keys_are_carried(spark, hot):
    keys = [SortKey("k", False, True), SortKey("i", False, True)]
    cuts = cut_points(hot, keys, 13)
    assert 6 <= cuts.count() <= 20
    from groovehouse.operators.positions import _with_bucket
    one, two = (_rows(_with_bucket(df, keys, cuts)) for df in (hot, hot.repartition(3)))
    assert one == two  # the bucket is a function of the row
    carry = edge_carry(_with_bucket(hot, keys, cuts), cuts, ["k"])
    assert carry.count() <= cuts.count()
    sizes = [r["n"] for r in _with_bucket(hot, keys, cuts).groupBy("_gh_pid").agg(
        F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 3 * 3000 / 13  # the hot key is spread


def test_no_checkpoint_and_one_shuffle_of_the_rows(spark, hot):
    plan = rank_within(hot, ["k"], [F.col("i").asc()], "r")._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD[k" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("at", range(len(ORDERS)))
def test_frequent_keys_in_buckets_and_others_by_a_window(spark, hot, at):
    """The frequent key (and the null key) spread over buckets, beside keys numbered at once."""
    from groovehouse.operators.positions import frequent_keys
    found = frequent_keys(hot, ["k"], 13, least=10)
    of = {r["k"]: r["h"] for r in hot.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    assert of[7] in found and len(found) < 10
    want = hot.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*_columns(ORDERS[at]))).cast("long"))
    got = rank_within(hot, ["k"], ORDERS[at], "r", partitions=13, frequent_rows=10)
    assert _rows(got) == _rows(want)


def test_no_bucket_search_without_a_frequent_key(spark):
    """36,000 rows in keys of four: one shuffle by key, no row looks for its bucket."""
    df = spark.range(36_000).select((F.col("id") % 9000).alias("k"), "id")
    plan = rank_within(df, ["k"], [F.col("id").asc()], "r")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("Exchange") == 1


def test_bound_decides_no_number(spark, hot):
    want = _rows(rank_within(hot, ["k"], ["i"], "r"))
    for bound in (hot.select("k"), hot.where("k = 3").select("k"), hot.limit(0).select("k")):
        assert _rows(rank_within(hot, ["k"], ["i"], "r", partitions=13, bound=bound, frequent_rows=1)) == want
