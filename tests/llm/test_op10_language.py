from __future__ import annotations

import inspect
import zlib
from itertools import product

import numpy as np
import pytest
from groovehouse.llm import language as G
from groovehouse.llm.chains import Chains
from groovehouse.llm.queries import queries
from helpers import awkward

SF = "/root/testdata/sf0.01"


def test_query_on_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op10_language_id"](spark, SF).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    emit, move = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    begins = np.zeros(9, bool)
    begins[[0, 2, 3]] = True
    got, moved, log_z = Chains(begins, 99).marginals(emit, move)
    want, moves, total = np.zeros((9, 3)), np.zeros((3, 3)), 0.0
    for a, b in ((0, 2), (2, 3), (3, 9)):
        paths = list(product(range(3), repeat=b - a))
        score = np.array([np.exp(sum(emit[a + k, x] for k, x in enumerate(p))
                                 + sum(move[x, y] for x, y in zip(p, p[1:], strict=False))) for p in paths])
        total += np.log(score.sum())
        for p, s in zip(paths, score / score.sum(), strict=True):
            for k, x in enumerate(p):
                want[a + k, x] += s
            for x, y in zip(p, p[1:], strict=False):
                moves[x, y] += s
    assert np.allclose(got, want) and np.allclose(moved, moves) and np.isclose(log_z, total)


@pytest.mark.parametrize("longest", [1, 2, 3, 7, 64])
def test_chains_of_several_blocks_are_as_whole_ones(longest):
    rng = np.random.default_rng(longest)
    for n in (1, 2, 5, 40, 400):
        emit, move = 3 * rng.normal(size=(n, 4)), rng.normal(size=(4, 4))
        begins = rng.random(n) < rng.choice([0.0, 0.05, 0.5])
        begins[0] = True
        whole, cut = Chains(begins, n + 1).marginals(emit, move), Chains(begins, longest).marginals(emit, move)
        for x, y in zip(whole, cut, strict=True):
            assert np.allclose(x, y)
    none = Chains(np.zeros(0, bool), longest).marginals(np.zeros((0, 4)), np.zeros((4, 4)))
    assert len(none[0]) == 0 and not none[1].any()


def test_code_switched_text_is_labelled_word_by_word(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = G.train(spark.read.parquet(f"{SF}/documents.parquet"))
    words = {x: [w for r in docs.values() if r["lang"] == x for w in r["text"].replace("\n", " ").split()[5:13]
                 if w.isalpha()][:400] for x in ("de", "es")}
    text = " ".join(words["de"][:12] + words["es"][:12] + words["de"][20:32])
    row = G.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    mid = len(" ".join(words["de"][:12] + words["es"][:6]).encode())
    at = next(x["lang"] for x in row["runs"] if x["start"] <= mid <= x["end"] + 1)
    assert at == "es" and row["runs"][0]["lang"] == "de" == row["runs"][-1]["lang"] == row["lang_pred"]


def test_awkward_rows_no_labels_and_empty_table(spark):
    docs = awkward(spark, "Score")
    rows = G.identify(docs, G.train(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert r["lang_pred"] == ("en" if letters else "und") and (letters or r["score"] == 0)
    none = G.train(docs.where("lang is null"))
    assert all(r["lang_pred"] == "und" for r in G.identify(docs, none).collect())
    assert G.identify(docs.limit(0), none).count() == 0


def test_sample_is_not_cut_below_its_size(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(G, "fit", lambda examples, **more: seen.append(examples))
    G.train(spark.range(6000).selectExpr("id as doc_id", "concat('text ', id) as text",
                                         "if(id % 2 = 0, 'en', 'fr') as lang"))
    assert 1450 <= len(seen[0]) <= 3200
    assert inspect.signature(G.train).parameters["most"].default == 1600
    monkeypatch.undo()
    assert inspect.signature(G.fit).parameters["per_text"].default == 12
