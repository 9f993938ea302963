"""Each stage of the pipeline against a brute-force version on its own input."""

from __future__ import annotations

import corpus_pipeline as C
import numpy as np
import public_tokenizers
from groovehouse.llm.common import stored
from groovehouse.llm.decontamination import TABLE
from groovehouse.llm.line_dedup import NORMAL, edit_distance
from groovehouse.llm.queries import VOCABULARY, documents
from helpers import awkward
from test_op5_packing import check as check_pieces
from test_op6_jaccard_join import brute as components
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def contaminated(text, items):
    words = text.encode().translate(TABLE).split()
    hit = [False] * len(words)
    for item in items:
        own = item.encode().translate(TABLE).split()
        size = min(13, len(own))
        windows = {tuple(own[k:k + size]) for k in range(len(own) - size + 1)} if size else set()
        for k in range(len(words) - size + 1 if size else 0):
            if tuple(words[k:k + size]) in windows:
                hit[k:k + size] = [True] * size
    return sum(hit) > 0 and 20 * sum(hit) >= len(words)


def similar_lines(texts, percent=75, least_words=5):
    """(document, line) of every line that is not the first of its group, where lines of an
    edit similarity of ``percent`` are linked; ``texts`` in the order of occurrence."""
    at, lines = [], []
    for k, text in enumerate(texts):
        for n, line in enumerate(text.split("\n")):
            words = line.encode().translate(NORMAL).split()
            if len(words) >= least_words:
                at.append((k, n))
                lines.append(b" ".join(words).decode())
    up = list(range(len(lines)))

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    size = np.array([len(x) for x in lines])
    letters = np.array([np.bincount([ord(c) % 64 for c in x], minlength=64) for x in lines])
    for a in range(1, len(lines)):
        most = (100 - percent) * np.maximum(size[:a], size[a]) // 100
        # No fewer edits than the letters that differ ask for.
        more = np.maximum(letters[:a] - letters[a], 0).sum(1)
        less = np.maximum(letters[a] - letters[:a], 0).sum(1)
        for b in np.flatnonzero(np.maximum(more, less) <= most):
            i, j = root(a), root(int(b))
            if i != j and edit_distance(lines[a], lines[b], int(most[b])) <= most[b]:
                up[max(i, j)] = min(i, j)
    return {at[k] for k in range(len(lines)) if root(k) != k}


def test_stages_on_their_own_input(spark):
    docs = documents(spark, SF)
    columns, stage = docs.columns, dict(C.STAGES)
    assert list(stage) == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]

    before, docs = docs.collect(), stored(stage["language_id"](spark, docs, SF), "t")
    assert docs.columns == columns
    kept = {r["doc_id"] for r in docs.collect()}
    assert all(r["doc_id"] in kept for r in before if r["text"] and r["lang"])  # all are of a language here

    rows = sorted(docs.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r["doc_id"], r["h"]))
    similar = similar_lines([r["text"] for r in rows])
    docs = stored(stage["line_dedup"](spark, docs, SF), "t")
    got = {r["doc_id"]: r for r in docs.collect()}
    gone = set()
    for k, r in enumerate(rows):
        left = got[r["doc_id"]]["text"].split("\n") if r["doc_id"] in got else []
        for n, line in enumerate(r["text"].split("\n")):
            if left and line == left[0]:
                left.pop(0)
            else:
                gone.add((k, n))
        assert not left  # what stays is a part of what was, in its order
        if r["doc_id"] in got:
            assert got[r["doc_id"]]["n_chars"] == len(got[r["doc_id"]]["text"])
    # Lines that go are similar to an earlier one; of these at least nine in ten are found.
    assert all(x in similar for x in gone if rows[x[0]]["doc_id"] in got)
    assert len(gone & similar) >= 0.9 * len(similar)

    pairs = [(r["doc_id"], r["text"]) for r in got.values()]
    want = {i for i, _, c in map(eval, components(pairs)) if i == c}
    docs = stored(stage["jaccard_join"](spark, docs, SF), "t")
    assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == sorted(want)

    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r["doc_id"] for r in docs.collect() if not contaminated(r["text"], items)}
    docs = stored(stage["decontamination"](spark, docs, SF), "t")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns and set(texts) == want

    t = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    t.encode_special_tokens = True
    pieces = stage["packing"](spark, docs, SF).collect()
    assert check_pieces(pieces, texts, lambda x: t.encode(x, add_special_tokens=False).ids) < 0.05


def test_awkward_rows_keep_one_of_each(spark):
    docs = awkward(spark, "n_chars")
    out = C.STAGES[2][1](spark, docs, SF).collect()
    assert len({(r["doc_id"], r["text"]) for r in out}) == len(out)
    assert all(any(r["doc_id"] == i for r in out) for i in (0, 1, 2, 3, 6, 8))
    assert C.STAGES[2][1](spark, docs.limit(0), SF).count() == 0
