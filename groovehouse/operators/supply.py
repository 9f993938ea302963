"""Supply side: dispatch reports, purchase-order documents, gates, pricing.

IDs: PF-5, PF-10..13, J-1, J-2, J-6, J-8, J-10, A-1, A-3, A-5, A-14, A-15,
W-1, W-2, F-4, F-5, F-9, F-10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (WAREHOUSE_CAP, money, short_status, status_text, to_minutes,
                               ts_text, wholesale_total)
from .nesting import nest_children, number_items
from .positions import rank_within

# Fixed texts of the reference's gates.
PO_DONE = "this purchase order is already completed"
PO_WAITING = "this purchase order is waiting on the supplier to confirm line items"
NOT_SHIPPED = "this dispatch must be in 'shipped' status to confirm receipt"


def dispatch_report(dispatches: DataFrame, pos: DataFrame) -> DataFrame:
    """J-1: dispatches with their order's receipt date and cost, newest
    estimated receipt first (NULL first, as PostgreSQL's ``desc``)."""
    j = dispatches.join(pos.select("purchase_order", "estimated_receipt", "shipping_cost"),
                        "purchase_order")
    return (j.select("purchase_order", "dispatch_id", "status", "address",
                     ts_text("estimated_receipt").alias("estimated_receipt"),
                     money("shipping_cost").alias("shipping_cost"),
                     to_minutes("estimated_receipt").alias("receipt_minutes"),
                     short_status("status").alias("short_status"))
            .orderBy(F.col("estimated_receipt").desc_nulls_first(),
                     F.col("dispatch_id").asc()))


def dispatch_status(dispatches: DataFrame, ids: DataFrame) -> DataFrame:
    """PF-5: status of each requested dispatch id."""
    return dispatches.join(ids.select("dispatch_id"), "dispatch_id").select(
        "dispatch_id", "status")


def pending_orders(pos: DataFrame) -> DataFrame:
    """PF-10: purchase orders not confirmed (NULL status is not counted)."""
    return pos.filter(F.col("status") != "confirmed")


def pending_dispatches(dispatches: DataFrame) -> DataFrame:
    """PF-10: dispatches not received."""
    return dispatches.filter(F.col("status") != "received")


def pending_counts(pos: DataFrame, dispatches: DataFrame) -> DataFrame:
    """J-6/A-1: one row with both pending counts.  Two global aggregates
    (partial per task, one tiny final merge) joined as scalar subqueries."""
    d = dispatches.agg(F.count_if(F.col("status") != "received")).scalar()
    return pos.agg(F.count_if(F.col("status") != "confirmed").cast("bigint")
                   .alias("pending_pos"),
                   d.cast("bigint").alias("pending_dispatches"))


def po_create_gate(pos: DataFrame, dispatches: DataFrame) -> DataFrame:
    """PF-13: a new purchase order only when nothing is pending."""
    c = pending_counts(pos, dispatches)
    return c.withColumn("can_create", (F.col("pending_pos") == 0)
                        & (F.col("pending_dispatches") == 0))


def po_edit_gate(pos: DataFrame) -> DataFrame:
    """PF-11: may the buyer edit the order, and why not."""
    st = F.col("status")
    return pos.select(
        "purchase_order", "status",
        (st == "pending-buyer").alias("allowed"),
        F.when(st == "confirmed", F.lit(PO_DONE))
        .when(st == "pending-supplier", F.lit(PO_WAITING)).alias("reason"))


def receipt_gate(dispatches: DataFrame, requests: DataFrame) -> DataFrame:
    """PF-12: only ``shipped`` dispatches may be received."""
    j = requests.select("dispatch_id").join(dispatches.select("dispatch_id", "status"),
                                            "dispatch_id", "left")
    ok = F.coalesce(F.col("status") == "shipped", F.lit(False))
    return j.select("dispatch_id", "status", ok.alias("allowed"),
                    F.when(~ok, F.lit(NOT_SHIPPED)).alias("reason"))


def purchase_order_list(pos: DataFrame, lines: DataFrame) -> DataFrame:
    """A-3: distinct albums per order, newest first.  Lines are reduced to
    distinct (order, album) pairs and counted before the join (A-18)."""
    per = (lines.select("purchase_order", "album_id").distinct()
           .groupBy("purchase_order").agg(F.count("album_id").alias("albums")))
    return (pos.join(per, "purchase_order")
            .select("purchase_order", ts_text("modified").alias("modified"), "status",
                    F.col("albums").cast("bigint").alias("albums"),
                    status_text("status").alias("status_text"))
            .orderBy(F.col("modified").desc_nulls_first(), F.col("purchase_order").asc()))


def _named_lines(lines: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    """Lines with album and artist (inner joins).  Artists meet the albums first: the
    lines are shuffled once, by album, and never by artist, of whom few hold many lines."""
    named = albums.select("album_id", "title", "artist_id").join(artists.select("artist_id", "name"), "artist_id")
    return lines.join(named, "album_id")


def purchase_order_detail(pos: DataFrame, lines: DataFrame, albums: DataFrame,
                          artists: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """J-2/A-5/A-8: invoice per order: lines with album and artist (inner
    joins) ordered by line, line sum and invoice total."""
    if ids is not None:
        pos = pos.join(ids.select("purchase_order"), "purchase_order", "left_semi")
        lines = lines.join(ids.select("purchase_order"), "purchase_order", "left_semi")
    li = _named_lines(lines, albums, artists)
    docs = nest_children(li, ["purchase_order"], F.struct(
        "line", "artist_id", "name", "album_id", "title", "quantity",
        F.col("confirmed_quantity").alias("confirmed"),
        money("line_total").alias("line_total")), "lines", [F.sum("line_total").alias("_sum")])
    return pos.join(docs, "purchase_order").select(
        "purchase_order", "status", ts_text("modified").alias("modified"),
        ts_text("estimated_receipt").alias("estimated_receipt"),
        money("shipping_cost").alias("shipping_cost"),
        money("_sum").alias("line_total"),
        money(F.col("_sum") + F.col("shipping_cost")).alias("invoice_total"),
        "lines")


def invoice_rows(lines: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    """J-2 as a flat table: one row per invoice line with its number on the invoice
    (1..n without gaps), for orders of any size."""
    li = _named_lines(lines, albums, artists)
    return number_items(li.select("purchase_order", "line", "album_id", "title", "name", "quantity",
                                  money("line_total").alias("line_total")), ["purchase_order"], ["line"],
                        bound=lines)


def confirmation_status(lines: DataFrame) -> DataFrame:
    """A-14: ``confirmed`` when every line's confirmed quantity equals its
    quantity (NULL-safe), else ``pending-buyer``; no lines counts as all."""
    full = F.coalesce(F.bool_and(F.col("quantity").eqNullSafe(F.col("confirmed_quantity"))),
                      F.lit(True))
    return (lines.groupBy("purchase_order").agg(full.alias("all_confirmed"))
            .withColumn("status", F.when(F.col("all_confirmed"), F.lit("confirmed"))
                        .otherwise(F.lit("pending-buyer"))))


def price_lines(lines: DataFrame, albums: DataFrame) -> DataFrame:
    """F-4: wholesale line total from the album price."""
    return (lines.join(albums.select("album_id", "price"), "album_id")
            .withColumn("line_total", wholesale_total("price", "quantity")))


def draft_totals(lines: DataFrame, freight: DataFrame) -> DataFrame:
    """A-15: item count, line sum and invoice total (freight added) per
    draft order, rounded to cents.  ``freight``: (purchase_order, freight)."""
    per = lines.groupBy("purchase_order").agg(
        F.sum("quantity").cast("bigint").alias("items"),
        F.sum("line_total").alias("_sum"))
    return (per.join(freight, "purchase_order", "left")
            .select("purchase_order", "items", money("_sum").alias("line_total"),
                    money(F.col("_sum") + F.coalesce(F.col("freight"), F.lit(0)))
                    .alias("invoice_total")))


def restock_flags(albums: DataFrame, lines: DataFrame) -> DataFrame:
    """F-5: per album and draft line of it: may one more be added (stock + ordered
    stays below the warehouse cap of 10) and may one be taken off.  An album
    without a line is a row too: nothing to take off, addable unless its stock
    alone is at the cap."""
    j = albums.select("album_id", "stock").join(lines, "album_id", "left")
    has_line = F.col("line").isNotNull()
    full = (F.col("stock") == WAREHOUSE_CAP) | (
        has_line & (F.col("stock") + F.col("quantity") >= WAREHOUSE_CAP))
    return j.select("purchase_order", "line", "album_id", "quantity", "stock",
                    (~full).alias("addable"), has_line.alias("deletable"))


def renumber_lines(lines: DataFrame) -> DataFrame:
    """W-1: lines renumbered 1..n per order without gaps (skew-safe numbering,
    not a window per order)."""
    return rank_within(lines.withColumnRenamed("line", "_old"), ["purchase_order"],
                       [F.col("_old").asc()], "line").drop("_old")


def append_lines(lines: DataFrame, new: DataFrame, order_col: str = "album_id"
                 ) -> DataFrame:
    """W-2: number added lines after the highest line of their order, in
    ``order_col`` order (unique inside an order)."""
    top = lines.groupBy("purchase_order").agg(F.max("line").alias("_top"))
    ranked = rank_within(new, ["purchase_order"], [F.col(order_col).asc()], "_n")
    numbered = (ranked.join(top, "purchase_order", "left")
                .withColumn("line", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("bigint"))
                .drop("_top", "_n"))
    return lines.unionByName(numbered.select(*lines.columns))


def dispatch_lines(dispatches: DataFrame, pos: DataFrame, lines: DataFrame) -> DataFrame:
    """J-8: confirmed quantities behind each dispatch."""
    return (dispatches.select("dispatch_id", "purchase_order")
            .join(pos.select("purchase_order"), "purchase_order")
            .join(lines.select("purchase_order", "album_id", "confirmed_quantity"),
                  "purchase_order"))


def orders_of_dispatches(dispatches: DataFrame, ids: DataFrame) -> DataFrame:
    """J-10: the purchase order behind each requested dispatch."""
    return dispatches.join(ids.select("dispatch_id"), "dispatch_id").select(
        "dispatch_id", "purchase_order")
