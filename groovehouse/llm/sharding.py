"""Operator 1, sharding: a two-pass external shuffle in DataFrame operations.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded
hash.  Pass 2 takes one bucket per task, puts it into a Fisher-Yates order
(Spark's ``shuffle`` of the bucket's array) and numbers it.  The buckets one
after the other are one uniformly random order of all records, which is cut
into shards whose row counts differ by one at most.

Cases: a null text has size 8 and no checksum bytes (crc32 of the empty
string); a null id is a record like any other; repeated rows stay as many as
they are and are scattered apart; an empty table gives no rows; an input
column called like a result column is replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, without

RESULT = ["shard", "slot", "bucket"]


def shuffle_into_shards(records: DataFrame, shards: int, *, id_col: str = "doc_id",
                        text_col: str = "text", bucket_bytes: int = 64 << 20,
                        seed: int = 17) -> DataFrame:
    """Every record with its ``shard`` (0 to shards - 1), its ``slot`` there
    (gapless from 0) and the ``bucket`` it was shuffled in.

    ``bucket_bytes`` bounds the text that one task holds; the number of buckets
    follows from the bytes of the whole table, read once beforehand, and is the
    session's shuffle width at least.  Which
    records go where depends on the seed, the records and the input's splits.
    """
    records = without(records, RESULT)
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + F.lit(64)
    total = records.agg(F.sum(size.cast("long")).alias("b")).first()["b"] or 0
    buckets = max(shuffle_width(records.sparkSession), math.ceil(total / bucket_bytes))

    # Equal rows are told apart by their place among the sorted rows of a split:
    # a task that runs again gives the same rows the same buckets.
    content = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in (id_col, text_col)])
    scattered = (
        records.select(F.struct("*").alias("record"), F.col(f"`{id_col}`").alias("key"),
                       content.alias("content"))
        .sortWithinPartitions("key", "content")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "content", "place"),
                                     F.lit(buckets)).cast("int"))
    )
    # Where each bucket starts in the whole order: one row per bucket.
    sizes = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(
        F.col("bucket").alias("b"),
        (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"),
        F.sum("n").over(Window.partitionBy()).alias("total"))

    # One bucket per partition: the bucket's number is its seed's offset.
    bucketed = (scattered.repartitionById(buckets, F.col("bucket"))
                .sortWithinPartitions("bucket", "content", "key", "place")
                .groupBy("bucket").agg(F.collect_list("record").alias("records")))
    placed = bucketed.select("bucket", F.posexplode(F.shuffle("records", F.lit(seed)))
                             .alias("i", "record"))
    at = F.col("start") + F.col("i")
    # The first at % shards-sized cut: shard s holds ceil or floor of total / shards rows.
    base, rest = F.floor(F.col("total") / shards), F.col("total") % shards
    edge = rest * (base + 1)
    shard = F.when(at < edge, F.floor(at / (base + 1))).otherwise(
        rest + F.floor((at - edge) / F.greatest(base, F.lit(1))))
    slot = F.when(at < edge, at % (base + 1)).otherwise((at - edge) % F.greatest(base, F.lit(1)))
    return (placed.join(F.broadcast(starts), F.col("bucket") == F.col("b"))
            .select("record.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"),
                    "bucket"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The shards as Parquet folders; a bucket goes into few shards, so each
    task writes few files."""
    sharded.write.partitionBy("shard").parquet(path)
