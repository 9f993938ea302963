"""Helpers shared by the operators: columns, Arrow buffers, shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: Bytes of text that one numpy step works on (a longer text is one step).
CHUNK_BYTES = 1 << 20


#: Bytes of rows that reach a Python worker at once: texts vary too much for a row count.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session end at BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns called like one of ``names`` (any case): an
    operator's result column replaces an input column of the same name."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def plain_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row; further columns are left out."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def shuffle_width(spark: SparkSession) -> int:
    """Partitions that the session's shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage
    ends there and every later use reads the same rows."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def add_fields(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column as (all bytes, n + 1 offsets,
    mask of the rows that are not null); a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0], valid


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [lo, hi) of at most ``limit`` bytes (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """One list per row from the flat values and each row's count."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def labelled_sample(rows: DataFrame, label: str, most: int, seed: int = 5) -> DataFrame:
    """About ``most`` rows in all (twice as many at most), as many of each value
    of ``label`` as there are (a rare value gives all its rows), chosen by a hash
    of ``doc_id``."""
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    # bounded: one row per label
    counts = counts.withColumn("n_kinds", F.count(F.lit(1)).over(Window.partitionBy()))
    share = F.col("most") / F.col("n_kinds") / F.col("n_rows")
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return (rows.join(F.broadcast(counts.withColumn("most", F.lit(most))), label)
            .where(chance < share).drop("n_rows", "n_kinds", "most").limit(2 * most))


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text falls into one part of ``parts``."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts == part
