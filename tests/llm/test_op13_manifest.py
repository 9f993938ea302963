"""Merkle manifest: trees against brute force, several rounds of blocks, SQL."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from groovehouse.llm import manifest as M
from groovehouse.llm import queries as Q
from helpers import as_rows, awkward, oracle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute(rows, claim):
    parts = {}
    for r in rows:
        parts.setdefault(r[1], []).append(r)
    order = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        parts[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in parts[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for i, r in enumerate(parts[s]):
            siblings, node = [], leaf(claim(r))
            for tree, at in ((trees[s], i), (top, place)):
                for row in tree[:-1]:
                    lo = at - at % 3
                    run = row[lo:lo + 3]
                    siblings += run[:at - lo] + run[at - lo + 1:]
                    node = H(*run[:at - lo], node, *run[at - lo + 1:])
                    at //= 3
            root = top[-1][0]
            out.append(str((r[0], s, leaf(r), trees[s][-1][0], root, siblings, H(*siblings), node, node == root)))
    return sorted(out)


def claim(r):
    return (*r[:4], None if r[4] is None else r[4].replace("\n", ""))


def proved(docs, **kw):
    text = F.replace("text", F.lit("\n"), F.lit(""))
    return sorted(str(tuple(r)) for r in M.prove(docs, claimed={"text": text}, **kw).collect())


@pytest.fixture()
def docs(spark):
    few = awkward(spark, "n_chars").withColumn("source", F.when(F.col("doc_id") % 4 == 1, None)
                                               .when(F.col("doc_id") == 6, "é").otherwise(F.col("source")))
    many = spark.range(1000, 1250).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("t\n"), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.col("id").alias("n_chars"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 17)).alias("source"))
    return few.select(*FIELDS).unionByName(many.select(*FIELDS)).withColumn("root", F.lit(1))


@pytest.mark.parametrize("height", [1, 2, 8])
def test_against_brute_force(spark, docs, height, monkeypatch):
    """Blocks of 3 and 9 leaves take several rounds up and down."""
    monkeypatch.setattr(M, "HEIGHT", height)
    monkeypatch.setattr(M, "BLOCK", M.FANOUT ** height)
    rows = [tuple(r[c] for c in FIELDS) for r in docs.collect()]
    assert proved(docs) == brute(rows, claim)


def test_one_row_and_no_rows(spark, docs):
    one = docs.where("doc_id = 1000")
    assert proved(one) == brute([tuple(r[c] for c in FIELDS) for r in one.collect()], claim)
    assert proved(docs.limit(0)) == []


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 28])
def test_folding_resumes_the_state_of_the_slot(size):
    leaves = [H(str(k)) for k in range(size)]
    tree = M.Tree(leaves)
    assert tree.top == levels(leaves)[-1][0]
    for at in range(size):
        assert tree.fold(at, leaves[at]).decode() == tree.top
        assert tree.fold(at, H("x")).decode() == levels(leaves[:at] + [H("x")] + leaves[at + 1:])[-1][0]


def test_unchanged_rows_verify(spark, docs):
    got = M.prove(docs, proofs=False)
    assert got.where("not verified or proof is not null").count() == 0 and got.count() == docs.count()


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert as_rows(Q.queries()["op13_manifest"](spark, sf)) == oracle(Q.OP13_SQL, sf)
