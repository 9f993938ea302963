from __future__ import annotations

import zlib

import pytest
from groovehouse.llm import sharding
from groovehouse.llm.queries import queries
from helpers import awkward

SF = "/root/testdata/sf0.001"


def check_shards(rows, shards):
    per = {}
    for r in rows:
        per.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(per.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(per) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in per.values())


def test_query_places_every_document_once(spark):
    rows = queries()["op1_sharding"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    check_shards(rows, 24)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "rows")


def test_same_seed_same_order_other_seed_other_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    order = [[tuple(r) for r in sharding.shuffle_into_shards(docs, 3, seed=s)
              .select("doc_id", "shard", "slot").orderBy("shard", "slot").collect()] for s in (1, 1, 2)]
    assert order[0] == order[1] != order[2]
    ids = [x[0] for x in order[0]]
    assert ids != sorted(ids) and abs(sum(a < b for a, b in zip(ids, ids[1:], strict=False)) - 100) < 40


@pytest.mark.parametrize("shards", [1, 7, 50])
def test_awkward_rows(spark, shards):
    docs = awkward(spark, "Slot")
    rows = sharding.shuffle_into_shards(docs, shards, bucket_bytes=50_000).collect()
    assert len(rows) == docs.count()
    check_shards(rows, shards)


def test_empty_table(spark):
    assert sharding.shuffle_into_shards(awkward(spark).limit(0), 4).count() == 0


def test_main_path_runs_no_python(spark):
    plan = queries()["op1_sharding"](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapPartitions"))


def test_written_shards_read_back(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(sharding.shuffle_into_shards(docs, 5), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 5
