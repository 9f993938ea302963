"""Small tables and brute-force versions for the tests of the llm operators."""

from __future__ import annotations

import random

import duckdb

TABLES = ("documents", "benchmark", "pages", "labels")


def oracle(sql: str, sf_dir: str) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    names = sorted(con.sql(sql).columns)
    return sorted(map(str, con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()))


def as_rows(df) -> list[str]:
    names = sorted(df.columns)
    return sorted(str(tuple(r[c] for c in names)) for r in df.collect())


def awkward(spark, extra: str = ""):
    """Nulls, empty, blank and long texts, ties, repeated rows, and columns that
    are called like results."""
    words = "the quick brown fox jumps over a lazy dog again".split()
    rng = random.Random(4)
    long = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(20_000))
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    texts = [None, "", "   \n ", "a", "a", "ü. é!\n\n日本", long, long, near + " x", near + " x",
             near + " y z", "\n" + near + " x", near.upper() + " x", "12 34", "…", "a\tb  c"]
    rows = [(k, t, "en" if k % 3 else None, 1, "s") for k, t in enumerate(texts)]
    rows += [(3, "a", "en", 1, "s"), (3, "a", "en", 1, "s"), (None, near + " x", "en", 1, "s"),
             (None, None, None, None, None)]
    clash = extra or "slot"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {clash} long, source string")
