"""Fill-in-middle: index and cuts against brute force, exact round trip, SQL."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groovehouse.llm import fill_middle as M
from groovehouse.llm import queries as Q
from helpers import as_rows, awkward, oracle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
text = st.text(st.sampled_from("ab é日\x1c \t\n\x0b\x0c\r<PSM>"), max_size=400)


@settings(max_examples=200, deadline=None)
@given(text)
def test_boundaries_and_index(t):
    at = M.boundaries(np.frombuffer(t.encode(), np.uint8))
    tokens = TOKEN.findall(t)
    assert at.tolist() == np.cumsum([0] + [len(x.encode()) for x in tokens]).tolist()
    for error in (0, 1, M.ERROR):
        index = M.RankIndex.fit(at, error)
        assert np.abs(index.residual).max() <= error + 1
        assert index.locate(np.arange(len(at))).tolist() == at.tolist()


def test_index_is_small_and_exact_on_uneven_texts():
    rng = np.random.default_rng(2)
    t = " ".join("x" * int(k) for k in rng.integers(1, 12, 50_000)) + "y" * 1_000_000 + " a" * 50_000
    at = M.boundaries(np.frombuffer(t.encode(), np.uint8))
    index = M.RankIndex.fit(at)
    assert (index.locate(np.arange(len(at))) == at).all()
    assert len(index.first) < len(at) / 50 and index.residual.dtype == np.int8


def brute(key, t, rate=50, spm=80):
    tokens = TOKEN.findall(t)
    n = len(tokens)
    h = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return t, "plain", n, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < spm:
        return f"<S>{suf}<P>{pre}<M>{mid}", "spm", n, len(pre), len(mid)
    return f"<P>{pre}<S>{suf}<M>{mid}", "psm", n, len(pre), len(mid)


def test_awkward_rows_against_brute_force(spark):
    docs = awkward(spark, "form").unionByName(spark.createDataFrame(
        [(100 + k, t, "en", 1, "s") for k, t in enumerate(
            ["<", "<P", "a<S>b", "<M>", "P><", "x <\n<S", "  lead", "trail \n"] * 8 + ["w " * 300_000])],
        "doc_id long, text string, lang string, form long, source string"))
    got = M.fill_in_middle(docs, rate=90)
    assert got.columns == ["doc_id", "text", "lang", "source", "output", "form", "n", "prefix_chars", "middle_chars"]
    back = got.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert len(back) == docs.count()
    for r in back:
        t = r["text"] or ""
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["output"], r["form"], r["n"], r["prefix_chars"], r["middle_chars"]) == brute(key, t, 90)
        assert r["back"] == t
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(docs.limit(0)).count() == 0


def test_query_matches_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert as_rows(Q.queries()["op12_fill_middle"](spark, sf)) == oracle(Q.OP12_SQL, sf)


def test_sentinels_must_not_arise_across_a_seam(spark):
    import pytest
    with pytest.raises(ValueError):
        M.fill_in_middle(awkward(spark), sentinels=("<P>", "P>x", "<M>"))
