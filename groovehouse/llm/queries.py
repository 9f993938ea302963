"""Registered queries of this subpackage and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontamination, fill_middle, fingerprints, html_text, jaccard_join, language, line_dedup,
               manifest, packing, sharding, suffix_dedup, toxicity, url_filters)
from .common import bounded_batches, held_out, plain_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_into_shards(plain_texts(documents(spark, sf_dir)), 24)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"),
                      F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard",
                      "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Lower-cased A-Z, then the words.
_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
OP2_SQL = f"""
WITH item AS (SELECT cast(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size,
         array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k
        FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
place AS (
  SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS phrase
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM doc, sizes
        WHERE len(w) >= size)),
hit AS (SELECT r, k, place.size, item_id FROM place JOIN win USING (size, phrase)),
words AS (SELECT r, count(DISTINCT p) AS n_hit
          FROM (SELECT r, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT r, k, size FROM hit))
          GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


@register("op2_decontamination", OP2_SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.find_contamination(
        plain_texts(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      decontamination.contaminated().alias("contaminated"))


@register("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


@register("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.train(pages)).select("page_id", "url", "text", "n_chars")


#: The tokenizer of op5 and of the pipeline, by name in the public set.
VOCABULARY = "byte_bpe_50k.json"


@register("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY),
                                  keep_ids=False)


OP6_SQL = """
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k
        FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o
                    FROM shingle x JOIN shingle y USING (s) GROUP BY ALL)
  JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
  WHERE 100 * o >= 75 * (p.n + q.n - o)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM doc LEFT JOIN size USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
"""


@register("op6_jaccard_join", OP6_SQL)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id")


@register("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_strings(plain_texts(documents(spark, sf_dir)))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"))


@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = docs.where(~held_out("doc_id", 5, 0))
    model = toxicity.train(learned, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    places = F.transform("toxic_sentences", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return toxicity.score(plain_texts(docs), model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(places, ",").alias("toxic_bytes"))


@register("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(plain_texts(documents(spark, sf_dir)), minima=line_dedup.MINIMA)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(
        F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@register("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.where(~held_out("doc_id", 4, 2)))
    return language.identify(plain_texts(docs), model, runs=False).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


#: The rules of op11: host and start of the path.
BLOCK, ALLOW = ("net/", "example.com/de/"), ("example.net/en/", "org/fr/")


@register("op11_url_filters")
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filters.filter_urls(pages, url_filters.rule_table(spark, BLOCK, ALLOW)).select(
        "page_id", "host", "path", "rule", "verdict", "score")


OP12_SQL = """
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256('42:' || coalesce(cast(doc_id AS VARCHAR), '')) AS h FROM documents),
word AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w,
         cast('0x' || h[1:8] AS BIGINT) AS h1, cast('0x' || h[9:16] AS BIGINT) AS h2,
         cast('0x' || h[17:24] AS BIGINT) AS h3, cast('0x' || h[25:32] AS BIGINT) AS h4 FROM doc),
cut AS (
  SELECT doc_id, t, w, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a,
         greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM word),
part AS (
  SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid,
         array_to_string(w[b + 1:n], '') AS suf FROM cut)
SELECT doc_id, cast(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM part
"""


@register("op12_fill_middle", OP12_SQL)
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(plain_texts(documents(spark, sf_dir)))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(text.cast("binary"), 256).alias("restored_sha256"))


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(cast({c} AS VARCHAR)) || ':' || cast({c} AS VARCHAR) END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: The checksum's state after the decimal id, bit by bit (4294967295 and 3988292384 are fixed by
#: crc32); the checksum is even where the state is odd.
_CRC_STATE = """CASE WHEN k = '' THEN 4294967295 ELSE list_reduce(
    list_transform(string_split(k, ''), lambda c: cast(ord(c) AS BIGINT)),
    lambda s, c: list_reduce(cast([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]),
      lambda t, i: CASE WHEN t % 2 = 1 THEN xor(t // 2, 3988292384) ELSE t // 2 END, xor(s, c)),
    cast(4294967295 AS BIGINT)) END"""
_UP = "list_transform(range(0, len(row), 3), lambda i: sha256(array_to_string(row[i + 1:i + 3], '')))"
OP13_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
         CASE WHEN ({_CRC_STATE}) % 2 = 1 THEN {_leaf_sql("replace(text, chr(10), '')")}
              ELSE {_leaf_sql('text')} END AS claimed
  FROM (SELECT *, coalesce(cast(doc_id AS VARCHAR), '') AS k FROM documents)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         row_number() OVER () AS r FROM leaf),
tree AS (
  SELECT source, 0 AS level, list(leaf ORDER BY pos) AS row FROM ranked GROUP BY source
  UNION ALL SELECT source, level + 1, {_UP} FROM tree WHERE len(row) > 1),
sub AS (SELECT source, row[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
        FROM tree WHERE len(row) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS row FROM sub HAVING count(*) > 0
  UNION ALL SELECT level + 1, {_UP} FROM top WHERE len(row) > 1),
run AS (
  SELECT source, level, (i - 1) // 3 AS g, list(h ORDER BY i) AS hs
  FROM (SELECT source, level, unnest(row) AS h, generate_subscripts(row, 1) AS i
        FROM tree WHERE len(row) > 1) GROUP BY ALL),
top_run AS (
  SELECT level, (i - 1) // 3 AS g, list(h ORDER BY i) AS hs
  FROM (SELECT level, unnest(row) AS h, generate_subscripts(row, 1) AS i
        FROM top WHERE len(row) > 1) GROUP BY ALL),
levels AS (SELECT cast(unnest(range(0, 40)) AS INTEGER) AS level),
spot AS (SELECT r, source, level, pos // cast(pow(3, level) AS HUGEINT) AS p FROM ranked, levels),
top_at AS (SELECT source, level, place // cast(pow(3, level) AS HUGEINT) AS p FROM sub, levels),
step AS (
  SELECT r, spot.level, hs, cast(p % 3 AS INTEGER) AS j FROM spot JOIN run
  ON spot.source IS NOT DISTINCT FROM run.source AND spot.level = run.level AND spot.p // 3 = run.g
  UNION ALL
  SELECT r, 100 + t.level, hs, cast(t.p % 3 AS INTEGER) FROM ranked
  JOIN top_at t ON ranked.source IS NOT DISTINCT FROM t.source
  JOIN top_run u ON t.level = u.level AND t.p // 3 = u.g),
way AS (
  SELECT r, list({{'l': array_to_string(hs[1:j], ''), 'n': '', 'r': array_to_string(hs[j + 2:3], '')}}
                 ORDER BY level) AS steps FROM step GROUP BY r),
proved AS (
  SELECT doc_id, leaf, source, array_to_string(list_transform(coalesce(steps, []), lambda s: s.l || s.r), '') AS proof,
         list_reduce(list_concat([{{'l': '', 'n': claimed, 'r': ''}}], coalesce(steps, [])),
                     lambda a, b: {{'l': '', 'n': sha256(b.l || a.n || b.r), 'r': ''}}).n AS folded_root
  FROM ranked LEFT JOIN way USING (r))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM proved JOIN sub ON proved.source IS NOT DISTINCT FROM sub.source,
     (SELECT row[1] AS root FROM top WHERE len(row) = 1)
"""


@register("op13_manifest", OP13_SQL)
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0,
                  F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.prove(documents(spark, sf_dir), claimed={"text": text}, proofs=False).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
