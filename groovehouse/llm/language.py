"""Operator 10, language identification: a linear-chain CRF over words.

Every word of a sentence is labelled with a language.  A word's features are
its character n-grams, its affixes (n-grams that hold the word's start or end)
and the word itself (the lexicon); moves between languages have learned
weights, so that code-switched text is labelled word by word.  The CRF is
trained by gradient steps on sentences of a bounded sample of labelled
documents, some of them spliced from two languages; forward-backward gives
each word's label probabilities and a document's are their mean.

Cases: ``und`` with score 0 for a null text and one without a letter, or where
no language could be learned; null labels are not learned from; repeated rows
are labelled alike; an empty table gives no rows; an input column called like
a result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chains import LONGEST, Chains, adam, sentence_starts
from .common import add_fields, bytes_of, labelled_sample, list_array, row_chunks, without
from .words import Powers, mix, span_hashes, word_spans

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FEATURE_BITS = 17
RUN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                    T.StructField("lang", T.StringType())])
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
          T.StructField("runs", T.ArrayType(RUN))]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of U+00C0 to U+00DE lower-cased."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        after = data[1:]
        capital = (data[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        out[1:][capital] += 32
    return out


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words and each word's first place among them:
    n-grams of one to four bytes of the word between marks, and the word."""
    size = ends - starts + 2
    edge = np.concatenate(([0], np.cumsum(size)))
    text = np.zeros(edge[-1], np.uint64)
    place = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
    inner = (place > 0) & (place < np.repeat(size - 1, size))
    text[inner] = data[np.repeat(starts, size)[inner] + place[inner] - 1]
    text[edge[:-1]] = 256
    text[edge[1:] - 1] = 257
    left = np.repeat(size, size) - place
    grams = np.zeros((len(text), 5), np.uint64)
    code = np.zeros(len(text), np.uint64)
    for n in range(1, 5):
        code[:len(text) - n + 1] = code[:len(text) - n + 1] * np.uint64(512) + text[n - 1:]
        grams[:, n - 1] = np.where(left >= n, mix(code * np.uint64(8) + np.uint64(n)), 0)
    whole = mix(np.add.reduceat(mix(text + place.astype(np.uint64) * np.uint64(1024)), edge[:-1])
                if len(starts) else np.zeros(0, np.uint64))
    grams[edge[:-1], 4] = whole
    keep = grams != 0
    counts = np.concatenate(([0], np.cumsum(keep.sum(axis=1))))
    return (grams[keep] >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), counts[edge[:-1]]


class Text:
    """Words, distinct words and sentence starts of a run of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, powers: Powers):
        data = lower_latin(data)
        self.starts, self.ends, self.first = word_spans(data, offsets, LETTERS)
        self.begins = sentence_starts(data, self.starts, self.ends, self.first)
        hashes = span_hashes(data, self.starts, self.ends, powers, lower=False)
        _, pick, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.features, self.edge = word_features(data, self.starts[pick], self.ends[pick])


class Model:
    """Languages, feature weights (features x languages) and moves."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.weights = np.zeros((1 << FEATURE_BITS, len(langs)))
        self.moves = np.zeros((len(langs), len(langs)))

    def emissions(self, text: Text) -> np.ndarray:
        if not len(text.word):
            return np.zeros((0, len(self.langs)))
        return np.add.reduceat(self.weights[text.features], text.edge, axis=0)[text.word]


def fit(examples: list[tuple[str, str]], *, per_text: int = 12, splice: float = 0.2,
        steps: int = 40, rate: float = 0.15, decay: float = 1e-6, seed: int = 3) -> Model:
    """A model from (text, language) pairs: at most ``per_text`` sentences of each
    text, a share ``splice`` of them joined to a sentence of another text."""
    model = Model(sorted({x for _, x in examples}))
    if not examples:
        return model
    rng, powers = np.random.default_rng(seed), Powers()
    number = {x: k for k, x in enumerate(model.langs)}
    sentences: list[tuple[bytes, int]] = []
    for raw, lang in sorted(examples):
        own = [x for x in raw.replace("\n", ".").replace("!", ".").replace("?", ".").split(".")
               if any(map(str.isalpha, x))]
        for k in sorted(rng.permutation(len(own))[:per_text]):
            words = own[k].split()
            at = int(rng.integers(max(1, len(words) - LONGEST + 1)))
            sentences.append((" ".join(words[at:at + LONGEST]).encode(), number[lang]))
    rng.shuffle(sentences)
    joined = rng.random(len(sentences)) < splice
    parts = [raw for raw, _ in sentences]
    offsets = np.concatenate(([0], np.cumsum([len(x) + 1 for x in parts])))
    text = Text(np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), offsets, powers)
    counts = np.diff(text.first)
    gold = np.repeat([x for _, x in sentences], counts)
    begins = np.zeros(len(gold), bool)
    begins[text.first[:-1][(counts > 0) & ~joined]] = True
    begins[:1] = True
    chains = Chains(begins)
    follows = ~begins
    n = len(model.langs)
    seen = np.zeros((n, n))
    np.add.at(seen, (gold[np.flatnonzero(follows) - 1], gold[follows]), 1)
    size = np.diff(np.append(text.edge, len(text.features)))
    distinct = len(text.edge)

    def gradient(_: int) -> list[np.ndarray]:
        found, moved, _ = chains.marginals(model.emissions(text), model.moves)
        found[np.arange(len(gold)), gold] -= 1
        out = np.empty_like(model.weights)
        for k in range(n):
            by_word = np.bincount(text.word, found[:, k], distinct)
            out[:, k] = np.bincount(text.features, np.repeat(by_word, size), len(out))
        return [out / len(gold) + decay * model.weights, (moved - seen) / len(gold)]

    adam([model.weights, model.moves], gradient, steps, rate)
    return model


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", most: int = 1600) -> Model:
    """Fit on a sample of about ``most`` documents, alike for all languages."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                           F.col(f"`{lang_col}`").alias("lang")).where("text is not null")
    return fit([(r["text"], r["lang"]) for r in labelled_sample(rows, "lang", most)
                .select("text", "lang").collect()])


def label(data: np.ndarray, offsets: np.ndarray, model: Model, powers: Powers, runs: bool
          ) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """Best language (number), its mean word probability and the runs of words
    of one language, of every text."""
    text = Text(data, offsets, powers)
    found, _, _ = Chains(text.begins).marginals(model.emissions(text), model.moves)
    sums = np.concatenate((np.zeros((1, len(model.langs))), np.cumsum(found, axis=0)))
    counts = np.diff(text.first)
    mean = (sums[text.first[1:]] - sums[text.first[:-1]]) / np.maximum(counts, 1)[:, None]
    best = mean.argmax(axis=1)
    out: list[list[dict]] = []
    if runs:
        words = found.argmax(axis=1)
        for t, (a, b) in enumerate(zip(text.first[:-1], text.first[1:], strict=True)):
            own = []
            for lang, g in groupby(range(a, b), key=lambda k: words[k]):
                g = list(g)
                own.append({"start": int(text.starts[g[0]] - offsets[t]),
                            "end": int(text.ends[g[-1]] - offsets[t]), "lang": model.langs[lang]})
            out.append(own)
    return best, np.clip(mean[np.arange(len(best)), best], 0.0, 1.0), out


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", runs: bool = True
             ) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and, with ``runs``, the byte spans
    of the runs of words of one language."""
    docs = without(docs, [f.name for f in FIELDS])
    fields = FIELDS if runs else FIELDS[:2]
    spark = docs.sparkSession
    # bounded: feature weights and moves of the languages learned
    sent = spark.sparkContext.broadcast((model.langs, model.weights.astype(np.float32), model.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights, moves = sent.value
        own, powers = Model.__new__(Model), Powers()
        own.langs, own.weights, own.moves = langs, weights, moves
        for batch in batches:
            data, offsets, _ = bytes_of(batch.column(text_col))
            names: list[str] = []
            scores: list[float] = []
            spans: list[list[dict]] = []
            for lo, hi in row_chunks(offsets):
                edge = offsets[lo:hi + 1] - offsets[lo]
                part = data[offsets[lo]:offsets[hi]]
                raw = part.tobytes()
                letters = [any(map(str.isalpha, raw[a:b].decode()))
                           for a, b in zip(edge[:-1], edge[1:], strict=True)]
                if not langs or not any(letters):
                    names += ["und"] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    spans += [[]] * (hi - lo)
                    continue
                best, score, found = label(part, edge, own, powers, runs)
                names += [langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                scores += [float(s) if ok else 0.0 for s, ok in zip(score, letters, strict=True)]
                spans += [f if ok else [] for f, ok in zip(found, letters, strict=True)] if runs else []
            out = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            if runs:
                flat = [x for s in spans for x in s]
                out.append(list_array(pa.array(flat, pa.struct(
                    [("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])),
                    np.array([len(s) for s in spans], np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out],
                                             [*batch.schema.names, *[f.name for f in fields]])

    return docs.mapInArrow(run, add_fields(docs.schema, fields))


