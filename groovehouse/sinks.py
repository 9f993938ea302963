"""Sinks: nested JSON documents, outbound purchase-order messages, and
versioned snapshots (SNK-1..3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.exprs import money, ts_text
from .operators.nesting import nest_children


def to_documents(df: DataFrame, drop_nulls: bool = True) -> DataFrame:
    """SNK-1: every row as one JSON text (``ignoreNullFields`` as asked)."""
    opts = {"ignoreNullFields": "true" if drop_nulls else "false"}
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), opts).alias("value"))


def write_documents(df: DataFrame, path: str, drop_nulls: bool = True) -> None:
    """SNK-1: JSON lines, one document per row."""
    to_documents(df, drop_nulls).write.mode("overwrite").text(path)


def po_messages(pos: DataFrame, lines: DataFrame, client_id: str = "shop") -> DataFrame:
    """SNK-2: outbound purchase-order message per order: header, lines
    ordered by line number, delivery date and freight cost."""
    per = nest_children(lines, ["purchase_order"], F.struct(
        "line", "album_id", "quantity", money("line_total").alias("line_total")), "data")
    msg = pos.join(per, "purchase_order").select(
        "purchase_order",
        F.to_json(F.struct(
            F.lit(client_id).alias("client_id"),
            F.col("purchase_order").alias("purchase_order_id"), "status",
            ts_text("modified").alias("modified"), "data",
            ts_text("estimated_receipt").alias("estimated_delivery"),
            money("shipping_cost").alias("dispatch_cost"))).alias("payload"))
    return msg


def save_snapshot(df: DataFrame, base: str, version: int,
                  partition_by: list[str] | None = None) -> str:
    """SNK-3: write a changed table as a new version folder, never over the
    input it was computed from.  ``partition_by`` (e.g. ``["status"]`` for
    purchase orders) lays the version out in folders a later filter on that
    column prunes.  Returns the written path."""
    path = f"{base.rstrip('/')}/v={version}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
