from __future__ import annotations

import zlib

import numpy as np
from groovehouse.llm import toxicity as X
from groovehouse.llm.queries import queries
from helpers import awkward

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_query_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries()["op8_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    score, y = (np.array(x) for x in zip(*held, strict=True))
    assert auc(score, y) > 0.94 and (score[y == 0] >= 0.5).mean() < 0.03
    assert (score[y == 1] >= 0.5).mean() > 0.7


def test_the_offending_sentence_is_found_from_document_labels(spark):
    clean = [f"The word{k} is fine. A day{k % 7} went by.\nAll good here{k % 5}!" for k in range(80)]
    bad = [x.replace("A day", "You utter rotter, day") for x in clean[:40]]
    model = X.fit([(x, 0) for x in clean[40:]] + [(x, 1) for x in bad])
    docs = spark.createDataFrame([(1, bad[3]), (2, clean[3])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in X.score(docs, model).collect()}
    spans = [bad[3].encode()[s["start"]:s["end"]].decode() for s in rows[1]["toxic_sentences"]]
    assert len(spans) == 1 and spans[0].startswith("You utter rotter") and rows[2]["toxic_sentences"] == []
    assert rows[1]["score"] > 0.5 > rows[2]["score"]


def test_noisy_or_by_hand():
    raw = [b"bad one. good. bad", b"", b"good"]
    bags = X.Bags(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), X.Powers())
    assert np.allclose(bags.noisy_or(np.array([0.5, 0.1, 0.2, 0.3])), [1 - 0.5 * 0.9 * 0.8, 0, 0.3])
    joined = X.Bags.joined(raw)
    assert joined.word.tolist() == bags.word.tolist() and joined.edge.tolist() == bags.edge.tolist()


def test_awkward_rows_no_labels_and_empty_table(spark):
    docs = awkward(spark, "Score")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None), (3, 0)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        model = X.train(docs, marks)
        rows = X.score(docs, model).collect()
        assert len(rows) == docs.count()
        assert all(r["score"] == 0 for r in rows if not (r["text"] or "").strip())
    assert X.score(docs.limit(0), model).count() == 0
