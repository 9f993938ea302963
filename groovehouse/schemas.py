"""Declared schemas of the ten shop tables, with key and check metadata.

Integer columns are ``LongType`` throughout: key widths differ between the
source tables and widening once at the scan keeps every join on one type.
Money is ``DecimalType``; timestamps are zone-less UTC wall clock.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, S, TS, B = T.LongType(), T.StringType(), T.TimestampNTZType(), T.BooleanType()
PRICE = T.DecimalType(10, 2)
COST = T.DecimalType(6, 2)
LINE_TOTAL = T.DecimalType(12, 2)


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "albums": _st(("album_id", L), ("title", S), ("release_year", L), ("stock", L),
                  ("price", PRICE), ("photo", S), ("artist_id", L), ("modified", TS)),
    "artists": _st(("artist_id", L), ("name", S), ("bio", S), ("modified", TS)),
    "cart": _st(("user_id", L), ("album_id", L), ("quantity", L)),
    "dispatches": _st(("dispatch_id", S), ("purchase_order", L), ("status", S),
                      ("address", S)),
    "orders_h": _st(("order_id", L), ("user_id", L), ("dispatched", TS)),
    "orders_bridge": _st(("order_id", L), ("album_id", L), ("quantity", L)),
    "purchase_order_lines": _st(("purchase_order", L), ("line", L), ("album_id", L),
                                ("quantity", L), ("confirmed_quantity", L),
                                ("line_total", LINE_TOTAL)),
    "purchase_orders": _st(("purchase_order", L), ("status", S), ("modified", TS),
                           ("shipping_cost", COST), ("estimated_receipt", TS)),
    "songs": _st(("album_id", L), ("track", L), ("duration", L), ("song", S)),
    "users": _st(("user_id", L), ("role", S), ("username", S), ("created", TS)),
}

# Primary keys (C-1).
PRIMARY_KEYS: dict[str, list[str]] = {
    "albums": ["album_id"],
    "artists": ["artist_id"],
    "cart": ["user_id", "album_id"],
    "dispatches": ["dispatch_id"],
    "orders_h": ["order_id"],
    "orders_bridge": ["order_id", "album_id"],
    "purchase_order_lines": ["line", "purchase_order"],
    "purchase_orders": ["purchase_order"],
    "songs": ["track", "album_id"],
    "users": ["user_id"],
}

# Foreign keys (C-2): (child, child columns, parent, parent columns, on delete).
FOREIGN_KEYS: list[tuple[str, list[str], str, list[str], str]] = [
    ("albums", ["artist_id"], "artists", ["artist_id"], "restrict"),
    ("cart", ["user_id"], "users", ["user_id"], "restrict"),
    ("cart", ["album_id"], "albums", ["album_id"], "restrict"),
    ("dispatches", ["purchase_order"], "purchase_orders", ["purchase_order"], "restrict"),
    ("orders_h", ["user_id"], "users", ["user_id"], "restrict"),
    ("orders_bridge", ["order_id"], "orders_h", ["order_id"], "cascade"),
    ("orders_bridge", ["album_id"], "albums", ["album_id"], "restrict"),
    ("purchase_order_lines", ["purchase_order"], "purchase_orders", ["purchase_order"],
     "cascade"),
    ("purchase_order_lines", ["album_id"], "albums", ["album_id"], "restrict"),
    ("songs", ["album_id"], "albums", ["album_id"], "cascade"),
]

# Fixed values that must equal the reference's check constraints (C-3, C-4).
DISPATCH_STATUSES = ["received", "pending-supplier", "shipped", "rescheduled"]
ORDER_STATUSES = ["pending-supplier", "pending-buyer", "confirmed"]
USER_ROLES = ["user", "admin"]
