"""Operator 3, document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the ``k`` smallest distinct 64-bit hashes of a text's
five-word shingles, ascending, as base64 of big-endian integers.  Two
fingerprints merge into that of the union, and two of them estimate
resemblance, containment and the number of distinct shingles; with fewer than
``k`` shingles all figures are exact.

Words stand between ASCII white space, A-Z lower-cased; a text of one to four
words has one shingle of all its words.

Cases: null, empty and blank texts have the empty fingerprint "" and resemble
each other by 1 and any other by 0; repeated rows give equal fingerprints; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, plain_texts, row_chunks, shuffle_width
from .words import SPACED, Powers, distinct_per_text, shingle_hashes, span_hashes, word_spans

K = 128


def sketches(data: np.ndarray, offsets: np.ndarray, powers: Powers, k: int = K,
             size: int = 5) -> list[np.ndarray]:
    """Bottom-k sketch of every text."""
    starts, ends, first = word_spans(data, offsets, SPACED)
    hashes, text_of = shingle_hashes(span_hashes(data, starts, ends, powers), first, size)
    flat, edge = distinct_per_text(hashes, text_of, len(offsets) - 1)
    return [flat[a:min(b, a + k)] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decode(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint or ""), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of the sets behind two sketches."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold."""
    both = np.sort(np.concatenate((a, b)))
    same = np.empty(len(both), bool)
    if not len(both):
        return 1.0
    same[-1] = False
    same[:-1] = both[1:] == both[:-1]
    union = both[np.concatenate(([True], ~same[:-1]))]
    shared = both[same]
    if len(a) == k or len(b) == k:  # a full sketch says nothing above its largest hash
        union = union[:k]
        shared = shared[shared <= union[-1]]
    return len(shared) / len(union)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / 2.0 ** 64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds too."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    na, nb = distinct_count(a, k), distinct_count(b, k)
    return min(1.0, j * (na + nb) / (1 + j) / na)


def fingerprint_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      k: int = K) -> DataFrame:
    """(doc_id, fingerprint, n_distinct: estimated) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            data, offsets, _ = bytes_of(batch.column("text"))
            found: list[np.ndarray] = []
            for lo, hi in row_chunks(offsets):
                found += sketches(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo],
                                  powers, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([encode(x) for x in found], pa.string()),
                 pa.array([distinct_count(x, k) for x in found], pa.float64())],
                ["doc_id", "fingerprint", "n_distinct"])

    plain = plain_texts(docs, id_col, text_col)
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, fingerprint string, n_distinct double")


def merge_parts(parts: DataFrame, key: str, *, fingerprint: str = "fingerprint", k: int = K,
                salt: int = 32) -> DataFrame:
    """(key, fingerprint) of the union of each key's parts.  A key's parts are
    merged in ``salt`` groups and then together; each task holds one sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, last, sketch, started = None, None, None, False
        for batch in batches:
            kind = batch.schema.field("key").type
            keys, out = batch.column("key").to_pylist(), []
            for x, f in zip(keys, batch.column("fingerprint").to_pylist(), strict=True):
                if started and x == last:
                    sketch = merged(sketch, decode(f), k)
                else:
                    if started:
                        out.append((last, encode(sketch)))
                    last, sketch, started = x, decode(f), True
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind),
                                              pa.array([x[1] for x in out], pa.string())],
                                             ["key", "fingerprint"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind),
                                              pa.array([encode(sketch)], pa.string())],
                                             ["key", "fingerprint"])

    rows = parts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{fingerprint}`").alias("fingerprint"))
    schema = rows.schema
    rows = (rows.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(salt)))
            .repartition("key", "salt").sortWithinPartitions("key", "salt").drop("salt")
            .mapInArrow(run, schema))
    rows = rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)
    return rows.withColumnRenamed("key", key)


def _range_bucket(bounds: list[int]):
    """Bucket of a key between the bounds; a key that is a bound several times
    (a hot one) is spread over its buckets by the text's hash."""
    limits = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series, h: pd.Series) -> pd.Series:
        lo, hi = np.searchsorted(limits, key, "left"), np.searchsorted(limits, key, "right")
        share = (h.to_numpy(np.float64) + 2.0 ** 63) / 2.0 ** 64
        return pd.Series(lo + np.minimum((share * (hi - lo + 1)).astype(np.int64), hi - lo))

    return bucket


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      k: int = K) -> DataFrame:
    """Each document in descending id order beside the next one (after the last:
    the first): (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).  The edited text has its last third replaced by the
    start of the next document.  Null ids come last; equal ids go by text hash.

    The documents are dealt once, into ranges of ids; a range also gets the first
    document of the range after it.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = plain_texts(docs, id_col, text_col).withColumns({
        "key": F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)),
        "h": F.xxhash64(F.coalesce("text", F.lit("")))})
    width = shuffle_width(spark)
    found = rows.agg(F.percentile_approx("key", [i / width for i in range(1, width)] or [0.5],
                                         100 * width).alias("b")).first()["b"]
    rows = rows.withColumn("bucket", _range_bucket(sorted(found or []))("key", "h"))
    # Of each range, its highest document: it follows the lowest of the range above.
    tops = rows.groupBy("bucket").agg(F.max(F.struct("key", "h")).alias("top"))
    above = F.lead("bucket").over(Window.orderBy("bucket"))
    tops = tops.select("top.*", "bucket", above.alias("above"),
                       F.min("bucket").over(Window.partitionBy()).alias("lowest"))
    # bounded: one row per range of the shuffle's width
    heads = (rows.join(F.broadcast(tops.select("key", "h", "bucket", "above", "lowest")),
                       ["key", "h", "bucket"])
             .groupBy("bucket").agg(F.first(F.struct("doc_id", "text", "key", "h")).alias("r"),
                                    F.first("above").alias("above"),
                                    F.first("lowest").alias("lowest"))
             .select("r.*", F.coalesce("above", "lowest").alias("bucket"), F.lit(True).alias("head")))
    dealt = (rows.withColumn("head", F.lit(False)).unionByName(heads)
             .repartitionById(width, F.col("bucket"))
             .sortWithinPartitions("head", F.desc("key"), F.desc("h"))
             .select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held = None  # (id, text, sketch) of the row whose next one is still to come
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data, offsets, _ = bytes_of(batch.column("text"))
            for lo, hi in row_chunks(offsets):
                part = data[offsets[lo]:offsets[hi]]
                edge = offsets[lo:hi + 1] - offsets[lo]
                raw = part.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                own = list(zip(ids[lo:hi], texts, sketches(part, edge, powers, k), strict=True))
                if held is not None:
                    own.insert(0, held)
                held = own[-1]
                if len(own) > 1:
                    yield compared(own, powers)

    def compared(own: list, powers: Powers) -> pa.RecordBatch:
        edited = []
        for (_, text, _), (_, after, _) in zip(own[:-1], own[1:], strict=True):
            cut = len(text) // 3
            edited.append((text[:len(text) - cut] + after[:cut]).encode())
        edge = np.concatenate(([0], np.cumsum([len(x) for x in edited])))
        changed = sketches(np.frombuffer(b"".join(edited), np.uint8), edge, powers, k)
        return pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in own[:-1]], pa.int64()),
            pa.array([len(x[1]) for x in own[:-1]], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
            pa.array([encode(x[2]) for x in own[:-1]], pa.string()),
            pa.array([encode(x) for x in changed], pa.string()),
            pa.array([resemblance(x[2], y, k) for x, y in zip(own[:-1], changed, strict=True)],
                     pa.float64()),
            pa.array([resemblance(x[2], y[2], k) for x, y in zip(own[:-1], own[1:], strict=True)],
                     pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            "near_edited", "near_next"])

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
                                 " edited_fingerprint string, near_edited double, near_next double")
