"""Structured Streaming jobs that keep cart and dispatch state current.

ST-1 ``stream_cart``: add/remove events → running cart (D-8 per batch).
ST-2 ``stream_dispatch_updates``: supplier messages → dispatches and
purchase orders (D-19).

State lies in hashed buckets.  A micro-batch reads and rewrites only the buckets that
its keys fall into; all other buckets keep their files.  Batch ``e`` writes its buckets
into folder ``v=e`` and then a small manifest that names, for each bucket, the version
that holds it.  Batch ids are consecutive and a retried batch starts from the manifest
of the one before, so a restart from the streaming checkpoint is idempotent.  Each
version is a written table, so lineage never grows across batches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import apply_dispatch_updates, fold_cart
from ..session import ensure_checkpoint_dir

#: Buckets of a state table; a bucket is what a batch rewrites at least.
BUCKETS = 64


def scratch_root(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/groovehouse-{name}-{uuid.uuid4().hex[:12]}"


class BucketedState:
    """A keyed table in hashed buckets under ``<root>/v=<n>/_bucket=<b>``.

    A version counts once its manifest ``<root>/_done/v=<n>`` is written, after its
    buckets: a reader never sees half a version, and a restarted driver finds the
    newest complete one in the store.  Version -1 is ``start``, written on first use."""

    def __init__(self, spark: SparkSession, root: str, start: DataFrame, keys: list[str],
                 buckets: int = BUCKETS):
        self.spark, self.root, self.start = spark, root.rstrip("/"), start
        self.keys, self.buckets = keys, buckets

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    @property
    def last(self) -> int:
        """The newest complete version, -1 before the first batch."""
        fs, path = self._fs("_done")
        if not fs.exists(path):
            return -1
        return max((int(f.getPath().getName().removeprefix("v=")) for f in fs.listStatus(path)), default=-1)

    def manifest(self, version: int) -> dict[int, int]:
        """Per bucket that has rows, the version whose folder holds it."""
        fs, path = self._fs(f"_done/v={version}")
        if not fs.exists(path):
            if version >= 0:
                raise ValueError(f"{self.root}: version {version} is not complete")
            self._write(-1, self.start, {})
        text = self.spark.read.text(str(path), wholetext=True).first()[0]
        return {int(b): v for b, v in json.loads(text).items()}

    def _write(self, version: int, rows: DataFrame, kept: dict[int, int]) -> None:
        rows.withColumn("_bucket", self.bucket()).write.partitionBy("_bucket").mode("overwrite").parquet(
            f"{self.root}/v={version}")
        fs, path = self._fs(f"v={version}")
        written = [f.getPath().getName() for f in fs.listStatus(path)]
        found = {int(n.removeprefix("_bucket=")): version for n in written if n.startswith("_bucket=")}
        fs, path = self._fs(f"_done/v={version}")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(kept | found).encode()))
        out.close()

    def read(self, version: int, only: set[int] | None = None) -> DataFrame:
        """The table at a version, or some buckets of it."""
        paths = [f"{self.root}/v={v}/_bucket={b}" for b, v in self.manifest(version).items()
                 if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.start.schema)
        return self.spark.read.schema(self.start.schema).parquet(*paths)

    def latest(self) -> DataFrame:
        return self.read(self.last)

    def update(self, version: int, batch: DataFrame, merge) -> None:
        """Write version ``version``: ``merge(old rows, batch)`` for the buckets that the
        keys of ``batch`` fall into."""
        # At most ``buckets`` numbers.
        touched = {r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()}
        kept = {b: v for b, v in self.manifest(version - 1).items() if b not in touched}
        old = self.read(version - 1, touched)
        self._write(version, merge(old, batch).select(*self.start.columns), kept)


def stream_cart(events: DataFrame, state: BucketedState, checkpoint: str,
                trigger: dict | None = None) -> StreamingQuery:
    """ST-1: apply each micro-batch of cart events, in arrival order, to the
    cart.  ``events`` is a streaming DataFrame with (event_id, ts, user_id, album_id,
    delta); ``state`` holds (user_id, album_id, quantity)."""
    def apply(batch: DataFrame, epoch: int) -> None:
        state.update(epoch, batch, fold_cart)

    w = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "0 seconds"})).start()


MESSAGE_COLUMNS = ["seq", "kind", "dispatch_id", "purchase_order", "status", "address", "estimated_delivery"]


def telling_messages(msgs: DataFrame) -> DataFrame:
    """Of each dispatch the messages that decide: its first note, its last update and its
    last rescheduling, by ``seq``.  They give ``apply_dispatch_updates`` the same result
    as all messages: an update counts if it comes after the first note, and if any does,
    the last one does.  Smallest and largest do not depend on the order in which messages
    arrive, nor on messages that come twice."""
    m = F.struct(*MESSAGE_COLUMNS)

    def pick(choose, where: Column) -> Column:
        return choose(m, F.when(where, F.col("seq")))

    note, update = F.col("kind") == "note", F.col("kind") == "update"
    found = F.array(pick(F.min_by, note), pick(F.max_by, update),
                    pick(F.max_by, update & (F.col("status") == "rescheduled")))
    per = msgs.groupBy("dispatch_id").agg(F.array_distinct(F.array_compact(found)).alias("_m"))
    return per.select(F.inline("_m"))


def stream_dispatch_updates(msgs: DataFrame, state: BucketedState, checkpoint: str,
                            trigger: dict | None = None) -> StreamingQuery:
    """ST-2: keep what each dispatch's messages say (``telling_messages``) in ``state``, keyed
    by dispatch.  Messages may arrive in any order and more than once: an update that
    comes a batch before its note waits in the state, and an older message than one
    already seen changes nothing.  ``dispatch_tables`` gives both tables from it."""
    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        return telling_messages(old.unionByName(batch.select(*MESSAGE_COLUMNS)))

    def apply(batch: DataFrame, epoch: int) -> None:
        state.update(epoch, batch, merge)

    w = msgs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def dispatch_tables(state: BucketedState, dispatches: DataFrame, pos: DataFrame, at: str
                    ) -> tuple[DataFrame, DataFrame]:
    """ST-2: (dispatches, purchase orders) after all messages of the stream so far."""
    return apply_dispatch_updates(dispatches, pos, state.latest(), at)
