"""Streams survive a restart from their checkpoint and equal the batch jobs, however the
messages arrive."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import rows
from groovehouse.operators import changes as ch
from groovehouse.sources.fixtures import PATCH_AT
from groovehouse.streaming.streams import (BucketedState, dispatch_tables, scratch_root, stream_cart,
                                           stream_dispatch_updates)


def in_arrivals(spark, parts, schema, inbox, start_query):
    """Write the parts into a file stream one after the other; the query finishes each
    arrival before the next."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(inbox)
    q = start_query(spark.readStream.schema(schema).parquet(inbox))
    try:
        for part in parts:
            part.write.mode("append").parquet(inbox)
            q.processAllAvailable()
    finally:
        q.stop()


def test_cart_stream_restarts_from_checkpoint(spark, shop_small):
    s = shop_small
    ev = s.cart_events
    key = F.unix_micros(F.col("ts").cast("timestamp"))
    mid = ev.agg(((F.min(key) + F.max(key)) / 2).cast("bigint")).first()[0]
    root = scratch_root(spark, "restart")
    inbox, chk = f"{root}/inbox", f"{root}/chk"
    empty = s.cart.filter(F.lit(False))
    spark.createDataFrame([], ev.schema).write.mode("overwrite").parquet(inbox)

    def run_once(part):
        state = BucketedState(spark, f"{root}/state", empty, ["user_id", "album_id"], buckets=8)
        q = stream_cart(spark.readStream.schema(ev.schema).parquet(inbox), state, chk)
        try:
            part.write.mode("append").parquet(inbox)
            q.processAllAvailable()
        finally:
            q.stop()
        return state

    first = run_once(ev.filter(key < mid))
    before = first.last
    assert before >= 0
    second = run_once(ev.filter(key >= mid))      # a new driver: same folders
    assert second.last > before                  # batch ids continue from the checkpoint
    assert rows(second.latest()) == rows(ch.fold_cart(empty, ev))


MSG = ("seq long, kind string, dispatch_id string, purchase_order long, status string, address string, "
       "estimated_delivery timestamp_ntz")


def test_dispatch_messages_in_any_order(spark):
    """An update a batch before its note, a note sent again, an older update after a newer
    one, a rescheduling behind a later status: the state gives the batch result."""
    from datetime import datetime as D
    msgs = [(5, "update", "a", None, "shipped", None, None), (3, "note", "a", 1, "pending-supplier", "x", None),
            (9, "note", "a", 2, "pending-supplier", "y", None), (7, "update", "k", None, "received", None, None),
            (6, "update", "k", None, "rescheduled", None, D(2024, 5, 1)),
            (2, "update", "b", None, "shipped", None, None), (4, "note", "b", 2, "pending-supplier", "z", None),
            (8, "update", "c", None, "rescheduled", None, D(2024, 6, 1)), (1, "note", "c", 3, "shipped", "w", None),
            (10, "update", "nobody", None, "shipped", None, None)]
    dispatches = spark.createDataFrame([("k", 4, "shipped", "v")],
                                       "dispatch_id string, purchase_order long, status string, address string")
    pos = spark.createDataFrame([(k, D(2024, 1, 1), D(2023, 1, 1)) for k in range(1, 5)],
                                "purchase_order long, estimated_receipt timestamp_ntz, modified timestamp_ntz")
    want = [rows(t) for t in ch.apply_dispatch_updates(dispatches, pos, spark.createDataFrame(msgs, MSG), PATCH_AT)]
    for order in (msgs, msgs[::-1], msgs[5:] + msgs[:5] + msgs[:3]):
        root = scratch_root(spark, "order")
        parts = [spark.createDataFrame(order[k:k + 3], MSG).coalesce(1) for k in range(0, len(order), 3)]
        start = parts[0].filter(F.lit(False))
        state = BucketedState(spark, f"{root}/state", start, ["dispatch_id"], buckets=4)
        in_arrivals(spark, parts, start.schema, f"{root}/inbox",
                    lambda src: stream_dispatch_updates(src, state, f"{root}/chk"))
        assert [rows(t) for t in dispatch_tables(state, dispatches, pos, PATCH_AT)] == want


def test_dispatch_stream_equals_batch(spark, shop_small):
    s = shop_small
    root = scratch_root(spark, "avail")
    late = s.dispatch_msgs.filter("seq % 2 = 0"), s.dispatch_msgs.filter("seq % 2 = 1")
    state = BucketedState(spark, f"{root}/state", s.dispatch_msgs.filter(F.lit(False)), ["dispatch_id"])
    in_arrivals(spark, late, s.dispatch_msgs.schema, f"{root}/inbox",
                lambda src: stream_dispatch_updates(src, state, f"{root}/chk"))
    d, p = ch.apply_dispatch_updates(s.dispatches, s.purchase_orders, s.dispatch_msgs, PATCH_AT)
    got = dispatch_tables(state, s.dispatches, s.purchase_orders, PATCH_AT)
    assert rows(got[0]) == rows(d) and rows(got[1]) == rows(p)
