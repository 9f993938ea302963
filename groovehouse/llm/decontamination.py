"""Operator 2, benchmark decontamination by an FM-index per training shard.

A task reads its split in shards of bounded size.  A shard's words become
numbers of the benchmark's vocabulary; runs of such words that are at least
as long as the shortest test phrase are indexed (nothing else can match).
The FM-index is the wavelet tree of the Burrows-Wheeler transform of these
runs plus sampled suffix positions: all test phrases are searched backward at
once through its ranks, occurrences are located by walking to a sampled
position, and the word spans found are merged.

The benchmark reaches the tasks in blocks of at most ``block_bytes`` of text;
a larger benchmark makes further narrow passes over the documents.

Cases: a null or empty text has no words and is not contaminated; items
without words match nothing; a null item id counts as an item written as the
empty string; rows of one item id are one item; repeated documents are judged
each; an empty benchmark hits nothing; an input column called like a result
column is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_fields, bytes_of, list_array, row_chunks, without
from .words import ALNUM, lower_table, word_spans

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("items", T.ArrayType(T.StringType())),
          T.StructField("spans", T.ArrayType(SPAN))]
#: Lower-cases A-Z and turns every byte that is in no word into a space.
TABLE = bytes(c if ALNUM[i] else 32 for i, c in enumerate(lower_table()))


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order of ``seq`` by prefix doubling, as long as ranks are tied."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    rank = np.empty(n, np.int64)
    s = seq[order]
    rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1]))) if n else 0
    k = 1
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[:n - k] += rank[k:] + 1
        order = np.argsort(key)
        s = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        k *= 2
    return order


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector a level, most significant
    bit first, each level sorted stably by the bit above it."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before place ``i``."""
        lo = np.zeros_like(i)
        for ones, zeros, level in zip(self.ones, self.zeros, range(self.levels - 1, -1, -1),
                                      strict=True):
            bit = ((symbol >> level) & 1).astype(bool)
            lo1, i1 = ones[lo], ones[i]
            lo = np.where(bit, zeros + lo1, lo - lo1)
            i = np.where(bit, zeros + i1, i - i1)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbol at place ``i``."""
        out = np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[i]
            bit = ones[i + 1] - one
            out = out * 2 + bit
            i = np.where(bit == 1, zeros + one, i - one)
        return out


class FMIndex:
    """Backward search over runs of symbols (1 and up), each run followed by a
    separator that no phrase holds."""

    SAMPLE = 8

    def __init__(self, seq: np.ndarray, in_run: np.ndarray, symbols: int):
        """seq: symbols with 0 after each run; in_run: place within its run."""
        gaps = np.flatnonzero(seq == 0)
        ordered = seq.astype(np.int64) + len(gaps)
        ordered[gaps] = np.arange(len(gaps))  # separators differ, so no comparison passes one
        sa = suffix_array(ordered)
        bwt = seq[sa - 1]
        self.tree = WaveletTree(bwt, symbols)
        counts = np.bincount(seq, minlength=symbols + 1)
        self.before = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        sampled = (in_run[sa] % self.SAMPLE == 0) & (seq[sa] != 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = sa[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [lo, hi) of each phrase (rows of equal length)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.before[-1], np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column]
            start = self.before[symbol]
            both = self.tree.rank(np.concatenate((symbol, symbol)),
                                  np.concatenate((lo[live], hi[live])))
            lo[live] = start + both[:len(live)]
            hi[live] = start + both[len(live):]
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffix rows; every run's start is sampled,
        so a walk never leaves its run."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            symbol = self.tree.access(rows[todo])
            rows[todo] = self.before[symbol] + self.tree.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.samples[self.sample_rank[rows]] + steps


class Phrases:
    """Test phrases of one benchmark block: the windows of its items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                     for w in text.translate(TABLE).split()]
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                found.setdefault(tuple(words[k:k + size]), set()).add(number[item])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({len(p) for p in found}):
            own = [p for p in found if len(p) == size]
            owners = [sorted(found[p]) for p in own]
            self.by_length[size] = (
                np.array(own, np.int64), np.concatenate(([0], np.cumsum([len(o) for o in owners]))),
                np.array([x for o in owners for x in o], np.int64))
        self.shortest = min(self.by_length, default=0)


def find_phrases(ids: np.ndarray, phrases: Phrases, shard_words: int
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, phrase number of that length) of every occurrence in
    the words ``ids`` (0: not in the vocabulary)."""
    nothing = np.zeros(0, np.int64)
    inside = np.concatenate(([False], ids > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= max(phrases.shortest, 1)
    starts, ends = starts[long], ends[long]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    total = np.concatenate(([0], np.cumsum(ends - starts + 1)))
    lo = 0
    while lo < len(starts):  # an index holds shard_words words, or one longer run
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + shard_words, side="right")) - 1)
        size = ends[lo:hi] - starts[lo:hi] + 1
        in_run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(starts[lo:hi], size) + in_run
        seq = np.where(in_run == np.repeat(size - 1, size), 0,
                       ids[np.minimum(place, len(ids) - 1)]).astype(np.int64)
        index = FMIndex(seq, in_run, len(phrases.vocabulary))
        for length, (rows, _, _) in phrases.by_length.items():
            a, b = index.search(rows)
            hit = np.flatnonzero(a < b)
            counts = b[hit] - a[hit]
            suffixes = np.repeat(a[hit], counts) + np.arange(counts.sum()) \
                - np.repeat(np.cumsum(counts) - counts, counts)
            out.append((place[index.locate(suffixes)], np.full(len(suffixes), length),
                        np.repeat(hit, counts)))
        lo = hi
    if not out:
        return nothing, nothing, nothing
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _searcher(block, window: int, text_col: str, earlier: bool, shard_words: int, batch_bytes: int):
    """mapInArrow function: adds the block's hits to those of earlier blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(block.value, window)
        for whole in batches:
            _, all_offsets, _ = bytes_of(whole.column(text_col))
            for lo, hi in row_chunks(all_offsets, batch_bytes):
                yield search(whole.slice(lo, hi - lo), phrases)

    def search(batch: pa.RecordBatch, phrases: Phrases) -> pa.RecordBatch:
        data, offsets, _ = bytes_of(batch.column(text_col))
        raw, n = data.tobytes(), len(offsets) - 1
        get, parts, counts = phrases.vocabulary.get, [], np.zeros(n, np.int64)
        for k in range(n):
            found = raw[offsets[k]:offsets[k + 1]].translate(TABLE).split()
            counts[k] = len(found)
            parts.append(np.fromiter(map(get, found, repeat(0)), np.int32, len(found)))
            parts.append(np.zeros(1, np.int32))  # no run passes a text's end
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        first = np.concatenate(([0], np.cumsum(counts + 1)))
        at, length, number = find_phrases(ids, phrases, shard_words)
        text_of = np.searchsorted(first, at, side="right") - 1

        owners: list[set[str]] = [set() for _ in range(n)]
        for size, (_, edge, items) in phrases.by_length.items():
            mine = np.flatnonzero(length == size)
            pairs = np.unique(np.stack((text_of[mine], number[mine])), axis=1)
            for t, p in pairs.T:
                owners[t].update(phrases.items[x] for x in items[edge[p]:edge[p + 1]])
        covered = np.zeros(len(ids) + 1, np.int32)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + length, -1)
        hit = np.cumsum(covered)[:-1] > 0
        if earlier:
            before_items, before_spans = (batch.column(c).to_pylist() for c in ("items", "spans"))
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        n_hit = np.zeros(n, np.int64)
        for t in np.union1d(text_of, [k for k in range(n) if earlier and before_spans[k]]).astype(int):
            starts, ends, _ = word_spans(data[offsets[t]:offsets[t + 1]],
                                         np.array([0, offsets[t + 1] - offsets[t]]), ALNUM)
            mask = hit[first[t]:first[t] + counts[t]].copy()
            if earlier:
                owners[t].update(before_items[t])
                for x in before_spans[t]:
                    mask[np.searchsorted(starts, x["start"]):np.searchsorted(starts, x["end"])] = True
            n_hit[t] = mask.sum()
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
            spans[t] = [(int(starts[a]), int(ends[b - 1]))
                        for a, b in zip(edges[::2], edges[1::2], strict=True)]
        flat = [x for s in spans for x in s]
        out = {
            "n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
            "items": pa.array([sorted(o) for o in owners], pa.list_(pa.string())),
            "spans": list_array(pa.StructArray.from_arrays(
                [pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32())],
                ["start", "end"]), np.array([len(s) for s in spans], np.int64)),
        }
        kept = [c for c in batch.schema.names if c not in out]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out.values()],
                                          [*kept, *out])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", window: int = 13,
                       block_bytes: int = 16 << 20, shard_words: int = 1 << 20,
                       batch_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside an occurrence of a
    window of ``window`` consecutive item words), ``items`` (sorted ids of the
    items found) and ``spans`` (merged byte spans of the text to remove)."""
    spark = docs.sparkSession
    docs = without(docs, [f.name for f in FIELDS])
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("i"),
                             F.col(f"`{item_text}`").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t").cast("long")).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out, base = docs, docs.schema
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        block = spark.sparkContext.broadcast([(r["i"], r["t"].encode()) for r in own.toLocalIterator()])
        out = out.mapInArrow(_searcher(block, window, text_col, b > 0, shard_words, batch_bytes),
                             add_fields(base, FIELDS))
    return out


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The contamination rule: a twentieth of the words, at least one, are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
