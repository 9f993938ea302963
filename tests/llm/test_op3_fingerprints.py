from __future__ import annotations

import hashlib

import numpy as np
from groovehouse.llm import fingerprints as P
from groovehouse.llm.queries import queries
from helpers import awkward
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, docs):
    order = sorted(docs, reverse=True)
    near = []
    for k, i in enumerate(order):
        text, after = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        r = rows[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own = shingles(text)
        near += [r["near_edited"] - jaccard(own, shingles(edited)), r["near_next"] - jaccard(own, shingles(after))]
    return np.abs(near)


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries()["op3_fingerprints"](spark, SF).collect()
    assert len(found) == len(docs)
    off = check({r["doc_id"]: r for r in found}, docs)
    assert off.mean() < 0.02 and off.max() < 0.2
    by_text = {}
    for r in found:
        by_text.setdefault(docs[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_many_ranges_and_hot_ids(spark):
    rows = [(5, f"hot {k} " * 9) for k in range(300)] + [(k, f"w{k} x y z a b c") for k in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = P.compare_with_next(docs).collect()
    assert len(found) == len(rows) and sum(r["doc_id"] == 5 for r in found) == 300
    single = {k: t for k, t in rows if k != 5}
    got = {r["doc_id"]: r for r in found}
    for i in range(11, 200):
        text, after = single[i], single.get(i - 1)
        cut = len(text) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((text[:len(text) - cut] + after[:cut]).encode()).hexdigest()


def test_awkward_rows_one_row_and_empty_table(spark):
    docs = awkward(spark)
    rows = P.compare_with_next(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["near_next"] <= 1 for r in rows)
    one = P.compare_with_next(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["n_chars"] == 5
    assert P.compare_with_next(docs.limit(0)).count() == 0


def test_merged_parts_equal_the_whole(spark):
    words = [f"w{k}" for k in range(3000)]
    parts = [(j % 2, " ".join(words[a:a + 304])) for j, a in enumerate(range(0, 2700, 150))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(t for _, t in parts)], "doc_id long, text string")
    prints = P.fingerprint_texts(df).withColumn("key", F.col("doc_id") % 2)
    merged = {r["key"]: P.decode(r["fingerprint"]) for r in P.merge_parts(prints, "key").collect()}
    for key in (0, 1):
        want = np.zeros(0, np.uint64)
        for r in prints.where(f"key = {key}").collect():
            want = P.merged(want, P.decode(r["fingerprint"]))
        assert merged[key].tolist() == want.tolist() and len(want) == P.K
        union = set().union(*(shingles(t) for k, t in parts if k == key))
        assert abs(P.distinct_count(merged[key]) / len(union) - 1) < 0.3


def test_containment():
    a = np.arange(1, 100, dtype=np.uint64)
    assert P.containment(a[:50], a) == 1.0 and abs(P.resemblance(a[:50], a) - 50 / 99) < 1e-9
