"""Bit filters of a fixed size that spare rows a shuffle.

A filter never decides a result: an exact join follows, and a full filter only
lets every row pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filters that spare rows a shuffle; a full filter spares none.
FILTER_BITS = 1 << 25
BITMAP = 32768  # bits of one row of bitmap_construct_agg


def bit_filter(df: DataFrame, column: str, size: int = FILTER_BITS) -> np.ndarray:
    """``size`` bits (a power of two), set where a value of ``column`` falls."""
    at = F.expr(f"{column} & {size - 1}")
    rows = (df.select(at.alias("at")).groupBy((F.col("at") / BITMAP).cast("int").alias("b"))
            .agg(F.bitmap_construct_agg((F.col("at") % BITMAP).cast("int")).alias("bits")).collect())
    out = np.zeros(size // 8, np.uint8)
    for r in rows:  # size bits in all
        out[r["b"] * BITMAP // 8:(r["b"] + 1) * BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & np.int64(8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def flagged(df: DataFrame, keys: DataFrame, column: str, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: whether ``column`` may be among those of
    ``keys`` (a null is not).  The filter is a table of FILTER_BITS bits at most,
    so its broadcast is bounded; no Python is involved."""
    def place(name: str):
        return F.expr(f"`{name}` & {FILTER_BITS - 1}")

    bits = (keys.select(place(column).alias("#at")).where("`#at` is not null")
            .groupBy(F.expr(f"cast(`#at` div {BITMAP} as int)").alias("#b"))
            .agg(F.bitmap_construct_agg(F.expr(f"cast(`#at` % {BITMAP} as int)")).alias("#bits")))
    rows = df.withColumn("#at", place(column))
    rows = rows.join(F.broadcast(bits), F.expr(f"cast(`#at` div {BITMAP} as int)") == F.col("#b"), "left")
    byte = f"cast(conv(hex(substring(`#bits`, cast(`#at` % {BITMAP} div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"shiftright({byte}, cast(`#at` % 8 as int)) & 1") == 1
    return rows.withColumn(flag, F.coalesce(bit, F.lit(False))).drop("#at", "#b", "#bits")
