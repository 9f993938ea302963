"""Supply queries: J-1, J-2, J-6, J-8, J-10, A-3, A-5, A-14, A-15, PF-5,
PF-10..13, F-4, F-5, F-9, F-10, W-1, W-2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import money
from ..operators import supply as sup
from .registry import register

TS = "'%Y-%m-%d %H:%M:%S'"


def _money(c: str) -> str:
    return f"CAST(round({c}, 2) AS DOUBLE)"


@register("dispatch_report", f"""
SELECT d.purchase_order, d.dispatch_id, d.status, d.address,
       strftime(p.estimated_receipt, {TS}) AS estimated_receipt,
       {_money('p.shipping_cost')} AS shipping_cost,
       strftime(p.estimated_receipt, '%Y-%m-%d %H:%M') AS receipt_minutes,
       split_part(d.status, '-', 1) AS short_status
FROM dispatches d JOIN purchase_orders p ON p.purchase_order = d.purchase_order""")
def dispatch_report(s):
    return sup.dispatch_report(s.dispatches, s.purchase_orders)


@register("dispatch_status", """
SELECT d.dispatch_id, d.status FROM dispatches d
JOIN receipt_requests r ON r.dispatch_id = d.dispatch_id""")
def dispatch_status(s):
    return sup.dispatch_status(s.dispatches, s.receipt_requests)


@register("orders_of_dispatches", """
SELECT d.dispatch_id, d.purchase_order FROM dispatches d
JOIN receipt_requests r ON r.dispatch_id = d.dispatch_id""")
def orders_of_dispatches(s):
    return sup.orders_of_dispatches(s.dispatches, s.receipt_requests)


@register("dispatch_lines", """
SELECT d.purchase_order, d.dispatch_id, l.album_id, l.confirmed_quantity
FROM dispatches d JOIN purchase_orders p ON p.purchase_order = d.purchase_order
JOIN purchase_order_lines l ON l.purchase_order = d.purchase_order""")
def dispatch_lines(s):
    return sup.dispatch_lines(s.dispatches, s.purchase_orders, s.purchase_order_lines)


@register("purchase_order_list", f"""
SELECT p.purchase_order, strftime(p.modified, {TS}) AS modified, p.status,
       CAST(count(DISTINCT l.album_id) AS BIGINT) AS albums,
       regexp_replace(p.status, '-', ' ') AS status_text
FROM purchase_orders p JOIN purchase_order_lines l ON l.purchase_order = p.purchase_order
GROUP BY p.purchase_order, p.modified, p.status""")
def purchase_order_list(s):
    return sup.purchase_order_list(s.purchase_orders, s.purchase_order_lines)


@register("purchase_order_detail", f"""
SELECT p.purchase_order, p.status, strftime(p.modified, {TS}) AS modified,
       strftime(p.estimated_receipt, {TS}) AS estimated_receipt,
       {_money('p.shipping_cost')} AS shipping_cost,
       {_money('sum(l.line_total)')} AS line_total,
       {_money('sum(l.line_total) + p.shipping_cost')} AS invoice_total,
       CAST(count(*) AS BIGINT) AS n_lines,
       string_agg(CAST(l.line AS VARCHAR) || ':' || r.name || ':' || a.title || ':' ||
                  CAST(l.quantity AS VARCHAR) || ':' ||
                  coalesce(CAST(l.confirmed_quantity AS VARCHAR), ''), ';'
                  ORDER BY l.line) AS lines_text
FROM purchase_orders p JOIN purchase_order_lines l ON l.purchase_order = p.purchase_order
JOIN albums a ON a.album_id = l.album_id JOIN artists r ON r.artist_id = a.artist_id
GROUP BY p.purchase_order, p.status, p.modified, p.estimated_receipt, p.shipping_cost""")
def purchase_order_detail(s):
    doc = sup.purchase_order_detail(s.purchase_orders, s.purchase_order_lines, s.albums,
                                    s.artists)
    return doc.select(
        "purchase_order", "status", "modified", "estimated_receipt", "shipping_cost",
        "line_total", "invoice_total", F.size("lines").cast("bigint").alias("n_lines"),
        F.array_join(F.transform("lines", lambda x: F.concat(
            x["line"].cast("string"), F.lit(":"), x["name"], F.lit(":"), x["title"],
            F.lit(":"), x["quantity"].cast("string"), F.lit(":"),
            F.coalesce(x["confirmed"].cast("string"), F.lit("")))), ";").alias("lines_text"))


@register("invoice_rows", f"""
SELECT l.purchase_order, l.line, l.album_id, a.title, r.name, l.quantity, {_money('l.line_total')} AS line_total,
       row_number() OVER (PARTITION BY l.purchase_order ORDER BY l.line) AS item
FROM purchase_order_lines l JOIN albums a ON a.album_id = l.album_id
JOIN artists r ON r.artist_id = a.artist_id""")
def invoice_rows(s):
    return sup.invoice_rows(s.purchase_order_lines, s.albums, s.artists)


PENDING = """(SELECT count(purchase_order) FROM purchase_orders WHERE status <> 'confirmed')
    AS pending_pos,
    (SELECT count(dispatch_id) FROM dispatches WHERE status <> 'received') AS pending_dispatches"""


@register("pending_counts", f"SELECT {PENDING}")
def pending_counts(s):
    return sup.pending_counts(s.purchase_orders, s.dispatches)


@register("po_create_gate", f"""
SELECT pending_pos, pending_dispatches, pending_pos = 0 AND pending_dispatches = 0 AS can_create
FROM (SELECT {PENDING})""")
def po_create_gate(s):
    return sup.po_create_gate(s.purchase_orders, s.dispatches)


@register("pending_orders", """
SELECT purchase_order, status FROM purchase_orders WHERE status <> 'confirmed'""")
def pending_orders(s):
    return sup.pending_orders(s.purchase_orders).select("purchase_order", "status")


@register("pending_dispatches", """
SELECT dispatch_id, status FROM dispatches WHERE status <> 'received'""")
def pending_dispatches(s):
    return sup.pending_dispatches(s.dispatches).select("dispatch_id", "status")


@register("po_edit_gate", f"""
SELECT purchase_order, status, status = 'pending-buyer' AS allowed,
       CASE WHEN status = 'confirmed' THEN '{sup.PO_DONE}'
            WHEN status = 'pending-supplier' THEN '{sup.PO_WAITING}' END AS reason
FROM purchase_orders""")
def po_edit_gate(s):
    return sup.po_edit_gate(s.purchase_orders)


@register("receipt_gate", """
SELECT r.dispatch_id, d.status, coalesce(d.status = 'shipped', false) AS allowed,
       CASE WHEN NOT coalesce(d.status = 'shipped', false)
            THEN 'this dispatch must be in ''shipped'' status to confirm receipt' END AS reason
FROM receipt_requests r LEFT JOIN dispatches d ON d.dispatch_id = r.dispatch_id""")
def receipt_gate(s):
    return sup.receipt_gate(s.dispatches, s.receipt_requests)


@register("price_lines", f"""
SELECT l.purchase_order, l.line, l.album_id, l.quantity,
       {_money('round(a.price * l.quantity * CASE WHEN l.quantity <= 5 THEN 0.7 ELSE 0.6 END, 2)')}
       AS line_total
FROM purchase_order_lines l JOIN albums a ON a.album_id = l.album_id""")
def price_lines(s):
    return sup.price_lines(s.purchase_order_lines, s.albums).select(
        "purchase_order", "line", "album_id", "quantity", money("line_total").alias("line_total"))


@register("draft_totals", f"""
SELECT l.purchase_order, CAST(sum(l.quantity) AS BIGINT) AS items,
       {_money('sum(l.line_total)')} AS line_total,
       {_money('sum(l.line_total) + coalesce(max(p.shipping_cost), 0)')} AS invoice_total
FROM new_lines l LEFT JOIN purchase_orders p ON p.purchase_order = l.purchase_order
GROUP BY l.purchase_order""")
def draft_totals(s):
    freight = s.purchase_orders.select("purchase_order",
                                       F.col("shipping_cost").alias("freight"))
    return sup.draft_totals(s.new_lines, freight)


@register("restock_flags", """
SELECT l.purchase_order, l.line, a.album_id, l.quantity, a.stock,
       a.stock <> 10 AND coalesce(a.stock + l.quantity < 10, true) AS addable,
       l.album_id IS NOT NULL AS deletable
FROM albums a LEFT JOIN new_lines l ON a.album_id = l.album_id""")
def restock_flags(s):
    return sup.restock_flags(s.albums, s.new_lines)


@register("renumber_lines", """
SELECT purchase_order,
       CAST(row_number() OVER (PARTITION BY purchase_order ORDER BY line) AS BIGINT) AS line,
       album_id, quantity
FROM new_lines""")
def renumber_lines(s):
    return sup.renumber_lines(s.new_lines).select("purchase_order", "line", "album_id",
                                                  "quantity")


@register("append_lines", f"""
WITH base AS (SELECT * FROM new_lines WHERE line <> 99),
add AS (SELECT purchase_order, album_id, quantity, confirmed_quantity, line_total
        FROM new_lines WHERE line = 99),
top AS (SELECT purchase_order, max(line) AS top FROM base GROUP BY purchase_order)
SELECT purchase_order, line, album_id, quantity, confirmed_quantity,
       {_money('line_total')} AS line_total FROM base
UNION ALL
SELECT a.purchase_order,
       CAST(coalesce(t.top, 0) + row_number() OVER (PARTITION BY a.purchase_order
            ORDER BY a.album_id) AS BIGINT),
       a.album_id, a.quantity, a.confirmed_quantity, {_money('a.line_total')}
FROM add a LEFT JOIN top t ON t.purchase_order = a.purchase_order""")
def append_lines(s):
    base = s.new_lines.filter(F.col("line") != 99)
    add = s.new_lines.filter(F.col("line") == 99).drop("line")
    out = sup.append_lines(base, add)
    return out.withColumn("line_total", money("line_total"))


@register("confirmation_status", """
SELECT purchase_order,
       coalesce(bool_and(quantity IS NOT DISTINCT FROM confirmed_quantity), true) AS all_confirmed,
       CASE WHEN coalesce(bool_and(quantity IS NOT DISTINCT FROM confirmed_quantity), true)
            THEN 'confirmed' ELSE 'pending-buyer' END AS status
FROM purchase_order_lines GROUP BY purchase_order""")
def confirmation_status(s):
    return sup.confirmation_status(s.purchase_order_lines)
