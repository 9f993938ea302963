from __future__ import annotations

import random

import pytest
from groovehouse.llm import jaccard_join as J
from groovehouse.llm.components import connected_components
from groovehouse.llm.queries import ORACLES, queries
from helpers import as_rows, awkward, oracle
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[root(k)] = min(least.get(root(k), (1, 0)), (i is None, i or 0))
    return sorted(str((i, len(sets[k]), i if not sets[k] or least[root(k)][0] else least[root(k)][1]))
                  for k, (i, _) in enumerate(docs))


def found(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_query_equals_sql(spark):
    assert as_rows(queries()["op6_jaccard_join"](spark, SF)) == oracle(ORACLES["op6_jaccard_join"], SF)


@pytest.mark.parametrize("small", [False, True])
def test_random_edits_against_brute_force(spark, monkeypatch, small):
    """Chains of edited copies near the threshold; with small groups and openings
    hot ones are split."""
    if small:
        monkeypatch.setattr(J, "GROUP", 3)
        monkeypatch.setattr(J, "OPENING", 2)
        monkeypatch.setattr(J, "MINHASHES", 1)
    rng, docs = random.Random(8), []
    common = " ".join(f"c{k}" for k in range(30))
    for base in range(6):
        words = [f"b{base}w{k}" for k in range(60)]
        for _ in range(18):
            words = list(words) if rng.random() < 0.6 else [f"b{base}w{k}" for k in range(60)]
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
            docs.append((len(docs), " ".join(words) + (" " + common if rng.random() < 0.5 else "")))
    docs += [(500 + k, common + f" t{k}") for k in range(10)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(J.similar_components(df)) == brute(docs)


def test_awkward_rows_and_empty_table(spark):
    docs = awkward(spark, "component_id")
    assert found(J.similar_components(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert J.similar_components(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-10**6, 10**6), 300)
    edges = [(ids[k], ids[k + 1]) for k in range(99)] + [(ids[150], ids[k]) for k in range(100, 200)]
    edges += [(a, a) for a in ids[200:210]]
    got = {r["node"]: r["root"] for r in connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(ids[:100]) for i in ids[:100]} | {i: min(ids[100:200]) for i in ids[100:200]}


def test_sets_of_other_sizes_with_frequent_tokens_against_brute_force(spark, monkeypatch):
    """Without pivots: pairs that share little but a passage of hundreds of documents,
    of sizes up to a third apart, some at the threshold; the smaller or the larger may ask."""
    rounds, real = [], J.open_groups

    def without_pivots(*args):
        rounds.append(real(*args))
        return rounds[-1].limit(0) if len(rounds) == 1 else rounds[-1]

    monkeypatch.setattr(J, "open_groups", without_pivots)
    texts = []
    for p in range(12):
        passage = [f"p{p}w{k}" for k in range(103)]
        for n, extra in enumerate((1, 31 - p % 4, 600, *[300] * 25)):
            texts.append(" ".join(passage + [f"p{p}n{n}x{k}" for k in range(extra)]))
    docs = list(enumerate(texts))
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    assert len({x.rsplit(", ", 1)[1] for x in want}) == len(docs) - 12
    assert found(J.similar_components(df)) == want


def test_whole_sets_are_not_written_between_steps(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join([*words[:40 + k % 3], f"x{k}", *words[43:]])) for k in range(8)]
    written, stored = [], J.stored
    monkeypatch.setattr(J, "stored", lambda df, name: written.append(df.columns) or stored(df, name))
    got = J.similar_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert found(got) == brute(docs)
    assert written and not any("tokens" in columns for columns in written)


def test_sets_meet_only_by_tokens_early_enough_in_both(spark, monkeypatch):
    """Two of many passages each: sets share frequent tokens, yet few pairs may link."""
    rng = random.Random(4)
    passages = [" ".join(f"p{k}w{j}" for j in range(30)) for k in range(30)]
    texts = [" ".join(rng.sample(passages, 2) + [f"own{i}"]) for i in range(300)]
    texts += [" ".join(t.split()[:-3] + ["cut"]) for t in texts[:20]]
    kept = {}

    def stored(df, name, real=J.stored):
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(J, "stored", stored)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.similar_components(docs).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == sorted(brute(rows))
    held = kept["held"].select("token", "node", "n", "root").distinct()
    other = held.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("r"))
    every = held.join(other, "token").where("root < r and 100 * m >= 75 * n and 100 * n >= 75 * m")
    assert kept["met"].count() < 0.5 * every.select("node", "b").distinct().count()
