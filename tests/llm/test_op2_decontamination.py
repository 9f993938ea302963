from __future__ import annotations

import numpy as np
from groovehouse.llm import decontamination as D
from groovehouse.llm.queries import ORACLES, queries
from helpers import as_rows, awkward, oracle
from hypothesis import given, settings
from hypothesis import strategies as st

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    got = queries()["op2_decontamination"](spark, SF)
    assert as_rows(got) == oracle(ORACLES["op2_decontamination"], SF)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_index_finds_every_occurrence(ids, phrase):
    phrases = D.Phrases([("i", " ".join("abc"[x - 1] for x in phrase).encode())], 13)
    words = [phrases.vocabulary.get(b"abc"[x - 1:x], 0) if x else 0 for x in ids]
    at, length, _ = D.find_phrases(np.array(words, np.int32), phrases, 16)
    want = [k for k in range(len(ids)) if ids[k:k + len(phrase)] == phrase]
    assert sorted(at.tolist()) == want and set(length.tolist()) <= {len(phrase)}


def test_blocks_of_the_benchmark_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    once = D.find_contamination(docs, bench)
    often = D.find_contamination(docs, bench, block_bytes=2000, shard_words=100, batch_bytes=5000)
    assert as_rows(once) == as_rows(often)


def test_spans_are_the_hit_words(spark):
    docs = spark.createDataFrame([(1, "Zz A b, C d! É"), (2, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a B c"), (None, "d é"), (8, ""), (9, None)],
                                  "item_id long, text string")
    rows = {r["doc_id"]: r for r in D.find_contamination(docs, items, window=2).collect()}
    assert [(s["start"], s["end"]) for s in rows[1]["spans"]] == [(3, 9)]
    assert rows[1]["items"] == ["7"] and rows[1]["n_hit"] == 3
    # É is not lower-cased, so the null item is not found
    assert rows[2]["n_hit"] == 2 and rows[2]["items"] == ["7"]


def test_awkward_rows_and_empty_tables(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = awkward(spark, "N_HIT")
    rows = D.find_contamination(docs, bench).collect()
    assert len(rows) == docs.count() and all(r["n_hit"] == 0 for r in rows)
    assert D.find_contamination(docs.limit(0), bench).count() == 0
    assert all(r["items"] == [] for r in D.find_contamination(docs, bench.limit(0)).collect())
