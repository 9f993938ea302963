"""Operator 12, fill-in-middle: cut a text at two token boundaries found through a
piecewise-linear learned rank index.

The boundaries of a text's tokens are the ends of its runs of other than white
space, and its end.  The index of a text fits segments to (rank, byte offset) of
all its boundaries, each the longest run that one line passes within ``ERROR``
bytes of every point (the cone of admissible slopes from the segment's first point
is narrowed until it is empty), and stores each boundary's residual in one byte.
A cut is predicted by the line of its segment and corrected by its residual, which
gives the exact offset.

The two cuts of a document and its form come from a hash of its id and the seed, so
they do not depend on where the row is processed.  Rows are independent: nothing is
shuffled, and a task holds one Arrow batch and the index of one text.

Cases: a null text is empty; a text that is empty or contains a sentinel is left
plain, so that an output can always be taken apart; a null id hashes as the empty
string; ids of any type hash by their text; repeated rows are transformed alike; an
input column called like a result column is replaced by it; an empty table gives no
rows; texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_fields, bytes_of, without

#: Largest distance of a boundary from its segment's line, in bytes; a residual fits in a byte.
ERROR = 64

RESULT = [T.StructField("output", T.StringType()), T.StructField("form", T.StringType()),
          T.StructField("n", T.LongType()), T.StructField("prefix_chars", T.LongType()),
          T.StructField("middle_chars", T.LongType())]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def boundaries(data: np.ndarray) -> np.ndarray:
    """Byte offsets between tokens: 0, then the end of each token."""
    if not len(data):
        return np.zeros(1, np.int64)
    space = _SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.concatenate([[0], ends, [len(data)]]).astype(np.int64)


@dataclass(frozen=True)
class RankIndex:
    """Segments (first rank, offset there, slope) and one residual a boundary."""
    first: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, at: np.ndarray, error: int = ERROR) -> RankIndex:
        first, offset, slope = [], [], []
        lo, n = 0, len(at)
        while lo < n:
            low, high, hi = -np.inf, np.inf, lo + 1
            width = 64
            while hi < n:  # a wider look ahead as long as the cone stays open
                end = min(hi + width, n)
                run = np.arange(hi - lo, end - lo)
                rise = at[hi:end] - at[lo]
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                closed = lows > highs
                stop = int(closed.argmax()) if closed.any() else len(run)
                if stop:
                    low, high = lows[stop - 1], highs[stop - 1]
                hi += stop
                if stop < len(run):
                    break
                width *= 2
            first.append(lo)
            offset.append(at[lo])
            slope.append((low + high) / 2 if hi > lo + 1 else 0.0)
            lo = hi
        index = cls(np.array(first, np.int64), np.array(offset, np.int64), np.array(slope),
                    np.zeros(0, np.int8))
        left = at - index.predict(np.arange(n))
        # Rounding may add one byte to the error.
        assert n == 0 or np.abs(left).max() <= error + 1
        return cls(index.first, index.offset, index.slope, left.astype(np.int8))

    def predict(self, rank: np.ndarray) -> np.ndarray:
        seg = np.searchsorted(self.first, rank, side="right") - 1
        return self.offset[seg] + np.rint(self.slope[seg] * (rank - self.first[seg])).astype(np.int64)

    def locate(self, rank: np.ndarray) -> np.ndarray:
        """Exact offsets of boundaries, by their rank."""
        return self.predict(rank) + self.residual[rank]


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned numbers from the hash of the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def transform(data: bytes, key: str, seed: int, rate: int, spm_rate: int,
              marks: tuple[bytes, bytes, bytes]) -> tuple:
    """(output, form, tokens, prefix characters, middle characters) of one text."""
    raw = np.frombuffer(data, np.uint8)
    at = boundaries(raw)
    n = len(at) - 1
    h1, h2, h3, h4 = draws(key, seed)
    if not data or h3 % 100 >= rate or any(m in data for m in marks):
        return data, "plain", n, None, None
    index = RankIndex.fit(at)
    cut = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(x) for x in index.locate(np.array(cut)))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    pre, suf, mid = marks
    if h4 % 100 < spm_rate:
        output, form = b"".join((suf, suffix, pre, prefix, mid, middle)), "spm"
    else:
        output, form = b"".join((pre, prefix, suf, suffix, mid, middle)), "psm"
    return output, form, n, _characters(raw[:a]), _characters(raw[a:b])


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   seed: int = 42, rate: int = 50, spm_rate: int = 80,
                   sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """Every row with its ``output`` text, ``form`` (plain, psm or spm), ``n`` tokens,
    ``prefix_chars`` and ``middle_chars`` (code points; null if plain).  Out of 100
    documents about ``rate`` are cut, and of these ``spm_rate`` put the suffix first.
    The sentinels open the prefix, the suffix and the middle."""
    # Then none can arise across the seam of a text and a sentinel.
    if len(set(sentinels)) < 3 or any(m[:1] in x[1:] for m in sentinels for x in sentinels):
        raise ValueError("sentinels: three different texts; the first character of each is not in the "
                         "rest of any")
    marks = tuple(m.encode() for m in sentinels)
    docs = without(docs, [f.name for f in RESULT])
    key, text = docs.columns.index(id_col), docs.columns.index(text_col)
    schema = add_fields(docs.schema, RESULT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = bytes_of(batch.column(text))
            data = data.tobytes()
            keys = ["" if k is None else str(k) for k in batch.column(key).to_pylist()]
            rows = [transform(data[offsets[i]:offsets[i + 1]], keys[i], seed, rate, spm_rate, marks)
                    for i in range(len(keys))]
            output, form, n, prefix, middle = zip(*rows) if rows else [()] * 5
            new = [pa.array(output, pa.binary()).cast(pa.string()), pa.array(form, pa.string()),
                   *[pa.array(x, pa.int64()) for x in (n, prefix, middle)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(work, schema)


def restored(output: Column, form: Column,
             sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that was cut, rebuilt from an output and its form: a cut text holds
    each sentinel once."""
    pre, suf, mid = (re.escape(m) for m in sentinels)
    psm = F.regexp_replace(output, f"(?s)^{pre}(.*){suf}(.*){mid}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{suf}(.*){pre}(.*){mid}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
