"""Operator 5, packing: bounded-space online best-fit packing of token ids.

A task tokenizes its documents one after the other and keeps at most
``open_windows`` sequences open.  A document's whole windows are sequences of
their own; its rest goes into the open sequence that it fills best.  When it
fits none and no further sequence may be opened, the fullest one is emitted.
What is still open when a split ends is written with the rest and merged at
the end: the pieces of a few splits at a time, longest first, each into the
sequence it fills best.

Cases: a null or empty text has one token, the closing one; null ids and
repeated rows are documents like any other; a text of any length is tokenized
whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, plain_texts, row_chunks, stored

#: Splits whose open sequences are merged together.
MERGE_SPLITS = 16
MERGED = 1 << 62


class TextTokenizer:
    """Token ids of texts.  The vocabulary and merges are the tokenizer file's;
    the encoder is the faster of the libraries that read such files, with the
    same ids, also those of added tokens that stand in a text.  Texts whose white space always stands alone, the usual ones, need
    no look-ahead to be cut into words and take a plain pattern."""

    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"

    def __init__(self, vocabulary: str):
        import tiktoken
        with open(vocabulary, encoding="utf-8") as f:
            known = json.load(f)
        special = {x["content"]: x["id"] for x in known["added_tokens"]}
        byte_of = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in known["model"]["vocab"].items()
                 if token not in special}
        self.full, self.plain = (
            tiktoken.Encoding("file", pat_str=self.WORDS + rest, mergeable_ranks=ranks,
                              special_tokens=special) for rest in (r"|\s+(?!\S)|\s+", r"|\s"))

        self.vocabulary, self.slow = vocabulary, None

    def ids(self, text: str, spaced_singly: bool) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        encoder = self.plain if spaced_singly else self.full
        try:
            found = encoder.encode(text, allowed_special="all")
        except ValueError:  # its look-ahead gives up on very long runs of white space
            if self.slow is None:
                from tokenizers import Tokenizer
                self.slow = Tokenizer.from_file(self.vocabulary)
            found = self.slow.encode(text, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()


#: ASCII white space, and the leading bytes of all other white space.
SPACE = np.zeros(256, bool)
SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
OTHER_SPACE = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))


def spaced_singly(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mask of the texts in which ASCII white space stands alone between other
    characters and no other white space can occur."""
    space = SPACE[data]
    odd = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        odd[1:-1] = space[1:] & space[:-1]
        for lead, after in OTHER_SPACE:
            odd[1:-1] |= (data[:-1] == lead) & (data[1:] == after)
    inside = offsets[:-1] < offsets[1:]
    odd[offsets[1:][inside]] = False  # what two texts make between them
    odd[offsets[:-1][inside]] = space[offsets[:-1][inside]]
    ends = offsets[1:][inside] - 1
    odd[ends] |= space[ends]
    counts = np.concatenate(([0], np.cumsum(odd)))
    return counts[offsets[1:]] == counts[offsets[:-1]]


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level files:
    printable Latin-1 bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Windows:
    """The open sequences of a split, by the room left in them."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[tuple[int, int]] = []  # (room left, sequence), ascending
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, length: int) -> tuple[int, int, int | None]:
        """(sequence, offset there, sequence emitted to make room or None)."""
        k, emitted = bisect_left(self.open, (length, -1)), None
        if k < len(self.open):
            room, sequence = self.open.pop(k)
        else:
            if len(self.open) >= self.most:
                emitted = self.open.pop(0)[1]
            room, sequence = self.size, self.new()
        if room > length:
            insort(self.open, (room - length, sequence))
        return sequence, self.size - room, emitted


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id",
                   text_col: str = "text", size: int = 1024, open_windows: int = 64,
                   end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset) and, with ``keep_ids``, ``ids`` as little-endian
    unsigned 32-bit integers.  ``vocabulary``: path of the tokenizer's file, the
    same on every machine.  ``start`` counts the document's ids before the
    piece, ``offset`` the sequence's."""
    docs = plain_texts(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids_field = ", ids binary" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, windows = TextTokenizer(vocabulary), Windows(size, open_windows)
        split = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        waiting: dict[int, list[tuple]] = {}  # pieces of the open sequences
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            ids = batch.column("doc_id").to_pylist()
            data, offsets, _ = bytes_of(batch.column("text"))
            for lo, hi in row_chunks(offsets):
                done: list[tuple] = []
                single = spaced_singly(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                for k in range(lo, hi):
                    raw = tokenizer.ids(data[offsets[k]:offsets[k + 1]].tobytes().decode(),
                                        bool(single[k - lo])) + end
                    n = len(raw) // 4
                    whole = n - n % size
                    for at in range(0, whole, size):
                        done.append(piece(ids[k], at, raw[4 * at:4 * (at + size)], n, windows.new(), 0))
                    if whole == n:
                        continue
                    sequence, offset, emitted = windows.place(n - whole)
                    if emitted is not None:
                        done += waiting.pop(emitted)
                    waiting.setdefault(sequence, []).append(
                        piece(ids[k], whole, raw[4 * whole:], n, sequence, offset))
                    if offset + n - whole == size:
                        done += waiting.pop(sequence)
                yield rows(done, False, id_type, split)
        if waiting:
            yield rows([x for own in waiting.values() for x in own], True, id_type, split)

    def piece(doc, start: int, raw: bytes, total: int, sequence: int, offset: int) -> tuple:
        return (doc, start, len(raw) // 4, zlib.crc32(raw), total, sequence, offset,
                raw if keep_ids else None)

    def rows(pieces: list[tuple], is_open: bool, id_type: pa.DataType, split: int) -> pa.RecordBatch:
        column = list(zip(*pieces, strict=True)) or [[]] * 8
        out = {"doc_id": pa.array(column[0], id_type)}
        for name, x in zip(("start", "length", "ids_crc32", "doc_tokens"), column[1:5], strict=True):
            out[name] = pa.array(x, pa.int64())
        out["sequence_id"] = pa.array([split << 32 | x for x in column[5]], pa.int64())
        out["offset"] = pa.array(column[6], pa.int64())
        out["open"] = pa.array([is_open] * len(pieces), pa.bool_())
        out["split"] = pa.array([split] * len(pieces), pa.int32())
        if keep_ids:
            out["ids"] = pa.array(column[7], pa.binary())
        return pa.RecordBatch.from_pydict(out)

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # bounded: open_windows sequences of at most ``size`` ids from each of a few splits
        group = group.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
        windows = Windows(size, 1 << 62)
        placed = [windows.place(int(x))[:2] for x in group["length"]]
        group["sequence_id"] = [MERGED | int(key[0]) << 32 | x for x, _ in placed]
        group["offset"] = [x for _, x in placed]
        return group

    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
              f"sequence_id long, offset long, open boolean, split int{ids_field}")
    pieces = stored(docs.mapInArrow(run, schema), "packing")
    merged = (pieces.where("open").withColumn("part", F.expr(f"split div {MERGE_SPLITS}"))
              .groupBy("part").applyInPandas(merge, f"{schema}, part long"))
    return (pieces.where("not open").unionByName(merged.drop("part"))
            .drop("open", "split"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids) of every sequence, from pieces with ``ids``."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # size ids at most
    return (pieces.groupBy("sequence_id").agg(ordered.alias("p"))
            .select("sequence_id",
                    F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_ids"),
                    F.aggregate("p", F.lit(b""), lambda b, x: F.concat(b, x["ids"])).alias("ids")))
