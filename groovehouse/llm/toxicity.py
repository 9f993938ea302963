"""Operator 8, toxicity: multiple-instance learning over sentences.

A document is a bag of sentences.  A sentence's score is the logistic of its
words' weights; a document is toxic if any sentence is, so its score is the
noisy-or of theirs.  Only documents have labels: the weights are learned from
them through the noisy-or, by Adam, for the words that toxic documents hold
significantly more often.  Sentences whose own score is half or more are located.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased; texts
and labels are all that is looked at.

Cases: a null or empty text has no sentence and the score 0; null labels are not learned
from; without labels all scores are the prior's; repeated rows score alike; an
empty table gives no rows; an input column called like a result column is
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chains import adam, sentence_starts
from .common import add_fields, bytes_of, labelled_sample, list_array, row_chunks, without
from .words import ALNUM, Powers, span_hashes, word_spans

FEATURE_BITS = 18
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                     T.StructField("score", T.DoubleType())])
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("toxic_sentences", T.ArrayType(SPAN))]

class Bags:
    """Words as feature numbers, the sentences they are in, the texts those are in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, powers: Powers):
        self.starts, self.ends, self.first = word_spans(data, offsets, ALNUM)
        hashes = span_hashes(data, self.starts, self.ends, powers)
        self.word = (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        begins = sentence_starts(data, self.starts, self.ends, self.first)
        self.sentence = np.flatnonzero(begins)  # its first word
        self.of = np.cumsum(begins) - 1
        self.edge = np.searchsorted(self.sentence, self.first)  # each text's first sentence
        self.text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.edge))

    @classmethod
    def joined(cls, texts: list[bytes]) -> Bags:
        """Bags of all texts, a bounded run of them at a time; without byte places."""
        offsets, powers = np.concatenate(([0], np.cumsum([len(x) for x in texts]))), Powers()
        out, parts, words, sentences = cls.__new__(cls), [], 0, 0
        for lo, hi in row_chunks(offsets):
            b = cls(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), offsets[lo:hi + 1] - offsets[lo], powers)
            parts.append((b.word.astype(np.int32), b.sentence + words, (b.of + sentences).astype(np.int32),
                          b.edge[1:] + sentences, b.text_of + lo))
            words, sentences = words + len(b.word), sentences + len(b.sentence)
        out.word, out.sentence, out.of, edge, out.text_of = (
            np.concatenate(x) for x in zip(*parts, strict=True))
        out.edge = np.concatenate(([0], edge))
        return out

    def sentence_scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        if not len(self.sentence):
            return np.zeros(0)
        z = np.add.reduceat(weights[self.word], self.sentence) + bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def noisy_or(self, scores: np.ndarray) -> np.ndarray:
        """1 - product of (1 - score) over each text's sentences; 0 without any."""
        logs = np.bincount(self.text_of, np.log1p(-np.minimum(scores, 1 - 1e-12)),
                           len(self.edge) - 1)
        return -np.expm1(logs)


def telling_words(bags: Bags, y: np.ndarray, least: float) -> np.ndarray:
    """Mask of the words that toxic documents hold more often than clean ones, by
    a likelihood ratio of at least ``least``, or of what chance hardly gives to any of
    as many words as there are, if that is less.  Counted over distinct sentences,
    so a copied one counts once."""
    size = 1 << FEATURE_BITS
    place = np.arange(len(bags.word)) - bags.sentence[bags.of]
    content = np.bincount(bags.of, (bags.word + 1) * (place + 1) % 1000003, len(bags.sentence))
    del place
    label = y[bags.text_of]
    key = content * 2 + label
    _, pick = np.unique(key, return_index=True)
    fresh = np.zeros(len(bags.sentence), bool)
    fresh[pick] = True
    keep = fresh[bags.of]
    pairs = np.unique(bags.of[keep].astype(np.int64) * size + bags.word[keep])
    of, word = pairs // size, pairs % size
    toxic = np.bincount(word, label[of], size)
    every = np.bincount(word, minlength=size).astype(float)
    share = max(label[fresh].mean(), 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (every * share)), 0)
                     + np.where(every > toxic, (every - toxic)
                                * np.log((every - toxic) / (every * (1 - share))), 0))
    least = min(least, 2 * np.log(max(np.count_nonzero(every), 2)))
    return (ratio >= least) & (toxic > every * share)


def fit(examples: list[tuple[str, int]], *, steps: int = 200, rate: float = 0.1,
        decay: float = 1e-5, least: float = 10.0, prior: float = -6.0,
        toxic_weight: float = 0.2) -> tuple[np.ndarray, float]:
    """(word weights, bias) from (text, 0 or 1) pairs; the toxic ones together
    weigh ``toxic_weight`` of all."""
    weights, bias = np.zeros(1 << FEATURE_BITS), np.array([prior])
    examples = sorted(set(examples))
    if len({y for _, y in examples}) < 2:
        return weights, prior
    raw = [x.encode() for x, _ in examples]
    y = np.array([y for _, y in examples], np.float64)
    bags = Bags.joined(raw)
    known = telling_words(bags, y, least)
    keep = known[bags.word]
    word, of = (np.cumsum(known) - 1)[bags.word[keep]], bags.of[keep]
    n, m = len(bags.sentence), int(known.sum())
    balance = np.where(y == 1, toxic_weight / y.mean(), (1 - toxic_weight) / (1 - y.mean())) / len(y)
    w = np.zeros(m)

    def gradient(_: int) -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[word], n) + bias[0], -30, 30)))
        doc = np.clip(bags.noisy_or(p), 1e-9, 1 - 1e-9)
        # d loss / d logit of a sentence: p in a clean document, -p (1 - doc) / doc in a toxic one
        g = (balance * np.where(y == 1, -(1 - doc) / doc, 1.0))[bags.text_of] * p
        return [np.bincount(word, g[of], m) + decay * w, np.array([g.sum()])]

    adam([w, bias], gradient, steps, rate)
    weights[known] = w
    return weights, float(bias[0])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", most: int = 6000) -> tuple[np.ndarray, float]:
    """Fit on a sample of about ``most`` labelled documents, half of each label
    as far as there are as many."""
    marks = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label"))
             .where("doc_id is not null").distinct())
    # bounded: 2 * most ids; the documents are not dealt anew
    picked = F.broadcast(labelled_sample(marks, "label", most))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = (rows.where("text is not null").join(picked, "doc_id").select("text", "label")
             .limit(4 * most).collect())
    return fit([(r["text"], int(r["label"])) for r in found])


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text",
          sentences: bool = True) -> DataFrame:
    """``docs`` with ``score`` and, with ``sentences``, the byte spans and scores of
    the sentences that are toxic themselves."""
    docs = without(docs, [f.name for f in FIELDS])
    fields = FIELDS if sentences else FIELDS[:1]
    # bounded: one weight per feature number
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        powers = Powers()
        for batch in batches:
            data, offsets, _ = bytes_of(batch.column(text_col))
            scores: list[np.ndarray] = []
            spans: list[tuple[int, int, float]] = []
            counts: list[np.ndarray] = []
            for lo, hi in row_chunks(offsets):
                bags = Bags(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], powers)
                p = bags.sentence_scores(weights, bias)
                scores.append(bags.noisy_or(p))
                if sentences:
                    hit = np.flatnonzero(p >= 0.5)
                    last = np.append(bags.sentence, len(bags.starts))[hit + 1] - 1
                    base = offsets[lo:hi][bags.text_of[hit]] - offsets[lo]
                    spans += zip((bags.starts[bags.sentence[hit]] - base).tolist(),
                                 (bags.ends[last] - base).tolist(), p[hit].tolist(), strict=True)
                    counts.append(np.bincount(bags.text_of[hit], minlength=hi - lo))
            out = [pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            if sentences:
                flat = pa.array([{"start": a, "end": b, "score": s} for a, b, s in spans], pa.struct(
                    [("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                out.append(list_array(flat, np.concatenate(counts) if counts else np.zeros(0, int)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out],
                                             [*batch.schema.names, *[f.name for f in fields]])

    return docs.mapInArrow(run, add_fields(docs.schema, fields))
