"""SRC-4: nested supplier messages to flat rows (``from_json`` + ``explode``).

Declared schemas only: a message that does not fit gives NULL fields, never
a schema guess.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, S = T.LongType(), T.StringType()

CONFIRMATION = T.StructType([
    T.StructField("client_id", S), T.StructField("purchase_order_id", L),
    T.StructField("status", S), T.StructField("modified", S),
    T.StructField("lines", T.ArrayType(T.StructType([
        T.StructField("line", L), T.StructField("confirmed", L),
        T.StructField("album_id", L)]))),
])

DISPATCH_NOTE = T.StructType([
    T.StructField("dispatch_id", S), T.StructField("purchase_order", L),
    T.StructField("status", S), T.StructField("address", S),
])

DISPATCH_UPDATE = T.StructType([
    T.StructField("dispatch_id", S), T.StructField("status", S),
    T.StructField("estimated_delivery", S),
])


def parse_confirmations(raw: DataFrame, col: str = "payload") -> DataFrame:
    """Order confirmation messages to one row per confirmed line."""
    m = raw.select(F.from_json(F.col(col), CONFIRMATION).alias("m"))
    return m.select(
        F.col("m.purchase_order_id").alias("purchase_order"),
        F.col("m.client_id").alias("client_id"), F.col("m.status").alias("status"),
        F.to_timestamp_ntz(F.col("m.modified")).alias("modified"),
        F.explode("m.lines").alias("l"),
    ).select("purchase_order", "client_id", "status", "modified", "l.line", "l.confirmed",
             "l.album_id")


def parse_dispatch_notes(raw: DataFrame, col: str = "payload") -> DataFrame:
    """Dispatch notes (a new dispatch for an order) to rows."""
    return raw.select(F.from_json(F.col(col), DISPATCH_NOTE).alias("m")).select("m.*")


def parse_dispatch_updates(raw: DataFrame, col: str = "payload") -> DataFrame:
    """Dispatch updates (status, new estimated delivery) to rows."""
    m = raw.select(F.from_json(F.col(col), DISPATCH_UPDATE).alias("m")).select("m.*")
    return m.withColumn("estimated_delivery", F.to_timestamp_ntz(F.col("estimated_delivery")))
