"""What large tables shuffle: each operator on rows built here, judged by its plan."""

from __future__ import annotations

import pytest

from conftest import rows
from groovehouse.operators import accounts as acc
from groovehouse.operators import audits as au
from groovehouse.operators import changes as ch
from groovehouse.operators import supply as sup
from groovehouse.schemas import SCHEMAS
from groovehouse.sources import forms


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def _tables(spark) -> dict:
    return {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}


@pytest.fixture
def merged(spark):
    """Without broadcasts, as for large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_references_are_counted_by_typed_keys(spark):
    t = _tables(spark)
    t["cart"] = spark.createDataFrame([(1, 5, 1), (1, 6, 1), (2, 5, 1), (None, 5, 1)], SCHEMAS["cart"])
    t["users"] = spark.createDataFrame([(2, "user", "u", None), (None, "user", "v", None)], SCHEMAS["users"])
    fk = au.audit_foreign_keys(t)
    assert rows(fk) == [("cart", "album_id", "albums", "5", 3), ("cart", "album_id", "albums", "6", 1),
                        ("cart", "user_id", "users", "1", 2)]
    assert not [x for x in _plan(fk) if "Aggregate(keys=[table" in x or "Aggregate(keys=[key" in x]


def test_primary_keys_are_counted_by_typed_keys(spark):
    t = _tables(spark)
    t["cart"] = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (None, 5, 1), (3, None, 1), (4, 5, 1)], SCHEMAS["cart"])
    pk = au.audit_primary_keys(t)
    assert rows(pk) == [("cart", "1,5", "repeated key", 2), ("cart", "3,NULL", "null key", 1),
                        ("cart", "NULL,5", "null key", 1)]
    assert not [x for x in _plan(pk) if "Aggregate(keys=[table" in x or "Aggregate(keys=[key" in x]


def test_order_marks_need_no_carried_quantities(spark):
    cols = SCHEMAS["purchase_order_lines"]
    lines = spark.createDataFrame([(1, 1, 5, 2, 1, None), (2, 1, 5, 2, 1, None), (3, 1, 5, 2, 1, None)], cols)
    new = spark.createDataFrame([(1, 1, 5, 3, None, None), (2, 1, 5, 2, None, None), (3, 2, 5, 9, None, None)], cols)
    pos = spark.createDataFrame([(1, "pending-buyer", None, None, None), (2, "pending-buyer", None, None, None),
                                 (3, "confirmed", None, None, None)], SCHEMAS["purchase_orders"])
    merged, orders = ch.merge_lines(lines, pos, new, "2024-06-01 00:00:00")
    assert rows(merged.select("purchase_order", "line", "quantity", "confirmed_quantity")) == [
        (1, 1, 3, 1), (2, 1, 2, 1), (3, 1, 2, 1)]
    assert not any("min_by" in x for x in _plan(orders))
    assert rows(orders.select("purchase_order", "status")) == [
        (1, "pending-supplier"), (2, "pending-buyer"), (3, "confirmed")]


def test_lines_of_unclicked_orders_are_read_once(spark):
    lines = spark.createDataFrame([(1, 1, 5, 2, None, None), (1, 2, 6, 1, None, None), (2, 4, 5, 3, None, None),
                                   (None, 1, 5, 1, None, None), (1, 3, None, 1, None, None)],
                                  SCHEMAS["purchase_order_lines"])
    albums = spark.createDataFrame([(5, "t", 2000, 0, None, "p", 1, None), (6, "u", 2000, 0, None, "p", 1, None)],
                                   SCHEMAS["albums"])
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, 5, -1), (2, "2024-01-02 00:00:00", 1, 5, -1)],
                                   "event_id long, ts string, purchase_order long, album_id long, delta long")
    out = ch.fold_draft_lines(lines, albums, events)
    got = rows(out.select("purchase_order", "line", "album_id", "quantity"))
    assert got == [(1, 1, 6, 1), (1, 2, None, 1), (2, 4, 5, 3), (None, 1, 5, 1)]
    assert sum("Scan ExistingRDD[purchase_order" in x for x in _plan(out)) == 1


def test_form_pairs_are_matched_once(spark):
    kv = spark.createDataFrame([("f", "track_1", " 1 "), ("f", "song_1", "a "), ("f", "song_12", None),
                                ("f", "xsong_1", "no"), ("f", "song_", "no"), ("g", "duration_2", "2:01"),
                                ("g", "song_2_3", "no")], "form_id string, key string, value string")
    out = forms.forms_to_rows(kv, forms.SONG_FIELDS)
    plan = _plan(out)
    assert not any("regexp_extract" in x for x in plan) and sum("Exchange" in x for x in plan) == 1
    assert rows(out) == [("f", 1, "1", "a", None), ("f", 12, None, None, None), ("g", 2, None, None, "2:01")]


def test_lines_are_never_shuffled_by_artist(spark, merged):
    t = _tables(spark)
    lines = sup.purchase_order_detail(t["purchase_orders"], t["purchase_order_lines"], t["albums"], t["artists"])
    items = acc.order_item_rows(t["orders_h"], t["orders_bridge"], t["albums"], t["artists"])
    flat = sup.invoice_rows(t["purchase_order_lines"], t["albums"], t["artists"])
    for df in (lines, items, flat):
        plan = _plan(df)
        by_artist = [i for i, x in enumerate(plan) if "hashpartitioning(artist_id" in x]
        assert len(by_artist) == 2
        for i in by_artist:
            # Below the shuffle by artist lie albums or artists, and one scan.
            below = []
            for x in plan[i + 1:]:
                if len(x) - len(x.lstrip(" :+-")) <= len(plan[i]) - len(plan[i].lstrip(" :+-")):
                    break
                below.append(x)
            assert sum("Scan" in x for x in below) == 1 and not any("Join" in x for x in below)
