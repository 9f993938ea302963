"""Streaming queries ST-1, ST-2: a stream over the given table, run until it has read what
is there, and the state it leaves; the oracle is the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ts_text
from ..sources.fixtures import PATCH_AT, cart_events_of, dispatch_messages_of
from ..streaming.streams import (BucketedState, dispatch_tables, scratch_root, stream_cart,
                                 stream_dispatch_updates)
from . import q_changes  # noqa: F401  (registers the batch oracles reused below)
from .registry import RAW_SQL, register

NOW = {"availableNow": True}


def _stream_of(s, table: str) -> DataFrame:
    """The raw table as a file stream (the name is a pattern: a file or a folder)."""
    return s.spark.readStream.schema(s.raw(table).schema).parquet(f"{s.sf_dir}/{table}.parquet*")


@register("stream_cart", RAW_SQL.get("fold_cart"))
def stream_cart_q(s):
    root = scratch_root(s.spark, "cart")
    state = BucketedState(s.spark, f"{root}/state", s.cart.filter(F.lit(False)), ["user_id", "album_id"])
    stream_cart(cart_events_of(_stream_of(s, "events")), state, f"{root}/chk", NOW).awaitTermination()
    return state.latest()


def _dispatches_streamed(s):
    root = scratch_root(s.spark, "dispatch")
    start = s.dispatch_msgs.filter(F.lit(False))
    state = BucketedState(s.spark, f"{root}/state", start, ["dispatch_id"])
    msgs = dispatch_messages_of(_stream_of(s, "orders"))
    stream_dispatch_updates(msgs, state, f"{root}/chk", NOW).awaitTermination()
    return dispatch_tables(state, s.dispatches, s.purchase_orders, PATCH_AT)


@register("stream_dispatch_updates", RAW_SQL.get("apply_dispatch_updates"))
def stream_dispatch_updates_q(s):
    return _dispatches_streamed(s)[0]


@register("stream_dispatch_orders", RAW_SQL.get("dispatch_update_orders"))
def stream_dispatch_orders_q(s):
    pos = _dispatches_streamed(s)[1]
    return pos.select("purchase_order", ts_text("estimated_receipt").alias("estimated_receipt"),
                      ts_text("modified").alias("modified"))
