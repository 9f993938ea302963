"""Operator 11, URL filters: rules of hosts and paths, and gradient-boosted trees on
lexical features for the URLs that no rule fits.

A rule is a host and a path prefix; it fits its host and all subdomains.  The URLs
that rules fit are the labelled URLs: from them the trees learn which URLs to block.

Features of a URL: length, depth (parts of the path), digit ratio, entropy of its
characters (a-z, 0-9, one class for the rest), parameters of the query, labels of the
host, and suffix statistics: the share of blocked URLs among the labelled ones with
the same last label, the same last two labels of the host and the same first
directory of the path, drawn towards the overall share where there are few.

The statistics cover all labelled URLs (one aggregate into ``CELLS`` hashed cells).
The trees are fitted to a sample of distinct labelled URLs, by default ``MOST`` (a
documented bound), in DataFrame aggregates: each level of a tree is one histogram
over (node, feature, bin).  Gradients are summed as integers, so that the order of
the rows does not change the model.  Scoring is one expression; no row is shuffled
but where the table of rules is too large to be broadcast.

Cases: a null URL and one without ``://`` have an empty host and path, fit no rule
and are judged by their features like any other; without labelled URLs the method
allows everything; with labels of one kind it gives that kind; repeated rows are
judged alike; a null rule fits nothing, and of equally long rules that fit the one
that blocks counts; an input column called like a result column is replaced by it; an
empty table gives no rows; URLs of any length are read whole.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, without

RESULT = ["host", "path", "rule", "rule_verdict", "score", "verdict"]
#: Hashed cells of each suffix statistic.
CELLS = 1024
#: Distinct labelled URLs that the trees are fitted to, about.
MOST = 20_000
#: Labelled URLs that the overall share counts for in a suffix statistic.
PRIOR = 20
TREES, DEPTH, BINS, RATE, RIDGE = 12, 3, 16, 0.3, 1.0
#: Gradients are rounded to this share of one.
UNIT = 1 << 20

PLAIN = ["length", "depth", "digit_ratio", "entropy", "parameters", "labels"]
SUFFIXES = ["last_label", "last_two", "directory"]
FEATURES = PLAIN + [f"{s}_share" for s in SUFFIXES]


# ---- URLs and rules ---------------------------------------------------------

def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase,
                       string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, block: Iterable[str], allow: Iterable[str]) -> DataFrame:
    """(rule, verdict) from texts like ``example.net/en/``."""
    rows = [(r, "block") for r in block] + [(r, "allow") for r in allow]
    parts = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rows]
    if not parts:
        return spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("verdict"))
    return spark.range(1).select(F.inline(F.array(*parts)))


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``rule_verdict`` (null where none
    fits).  One lookup by the host's last 1, 2, … labels, as many as the longest host
    of a rule has; a host's rules are one row, so no URL is multiplied."""
    urls = without(urls, RESULT)
    cut = F.locate("/", F.col("rule"))
    host = F.when(cut > 0, F.substring("rule", F.lit(1), cut - 1)).otherwise(F.col("rule"))
    parsed = rules.where("rule is not null").select(
        "rule", "verdict", F.translate(host, string.ascii_uppercase, string.ascii_lowercase).alias("h"),
        F.when(cut > 0, F.substring("rule", cut, F.length("rule"))).otherwise("").alias("start"))
    deepest = parsed.agg(F.max(F.size(F.split("h", "\\.")))).first()[0] or 0
    # The longest rule first; of equal ones the one that blocks.
    entry = F.struct(F.length("rule").alias("size"), F.col("verdict").alias("verdict"), "rule", "start")
    by_host = parsed.groupBy("h").agg(F.collect_set(entry).alias("found"))

    host, path = split_url(F.col(f"`{url_col}`"))
    out = urls.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    out = out.withColumn("parts", F.split("host", "\\."))
    none = F.array().cast(by_host.schema["found"].dataType)
    for k in range(1, deepest + 1):
        ending = F.when((F.size("parts") >= k) & (F.col("host") != ""),
                        F.substring_index("host", ".", -k))
        out = (out.withColumn("ending", ending)
               .join(by_host.select(F.col("h").alias("ending"), F.col("found").alias(f"found{k}")),
                     "ending", "left").drop("ending"))
    every = F.concat(none, *[F.coalesce(F.col(f"found{k}"), none) for k in range(1, deepest + 1)])
    fits = F.filter(every, lambda r: F.col("path").startswith(r["start"]))
    best = out.withColumn("best", F.array_max(fits))
    return best.select("row.*", "host", "path", F.col("best.rule").alias("rule"),
                       F.col("best.verdict").alias("rule_verdict"))


# ---- features ---------------------------------------------------------------

def _suffixes(host: Column, path: Column) -> list[Column]:
    """What the three suffix statistics are kept by."""
    return [F.substring_index(host, ".", -1), F.substring_index(host, ".", -2),
            F.regexp_extract(path, "^/([^/]*)/", 1)]


def _cell(at: int, key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(at), key), F.lit(CELLS)).cast("int")


def _entropy(text: Column, size: Column) -> Column:
    """Bits a character, by counts of a-z, 0-9 and the rest."""
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
              for c in string.ascii_lowercase + string.digits]
    rest = size - sum(counts[1:], counts[0])
    parts = [F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0) for c in [*counts, rest]]
    return F.when(size > 0, F.log2(size.cast("double")) - sum(parts[1:], parts[0]) / size).otherwise(0.0)


def plain_features(url: Column, host: Column, path: Column) -> list[Column]:
    text = F.lower(F.coalesce(url, F.lit("")))
    size = F.length(text)
    query = F.regexp_extract(text, "\\?([^#]*)", 1)
    digits = size - F.length(F.translate(text, string.digits, ""))
    return [size.cast("double"),
            F.regexp_count(path, F.lit("/[^/]+")).cast("double"),
            F.when(size > 0, digits / size).otherwise(0.0),
            _entropy(text, size),
            F.when(query == "", 0.0).otherwise(1.0 + F.regexp_count(query, F.lit("&"))),
            F.when(host == "", 0.0).otherwise(F.size(F.split(host, "\\.")).cast("double"))]


# ---- model ------------------------------------------------------------------

@dataclass
class Node:
    """A split (``feature`` above ``cut`` goes right) or a leaf's ``value``."""
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    below: Node | None = None
    above: Node | None = None

    def column(self, features: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(features[self.feature] > self.cut, self.above.column(features)) \
            .otherwise(self.below.column(features))


@dataclass
class UrlModel:
    base: float
    shares: list[list[float]] = field(default_factory=list)
    trees: list[Node] = field(default_factory=list)


def _shared(model_shares: list[list[float]], host: Column, path: Column) -> list[Column]:
    """Each suffix's share of blocked URLs, from tables of ``CELLS`` numbers."""
    found = []
    for at, (key, shares) in enumerate(zip(_suffixes(host, path), model_shares)):
        table = F.split(F.lit(",".join(repr(s) for s in shares)), ",").cast("array<double>")
        found.append(F.get(table, _cell(at, key)))
    return found


def _with_features(urls: DataFrame, shares: list[list[float]], url_col: str) -> DataFrame:
    host, path = F.col("host"), F.col("path")
    values = plain_features(F.col(f"`{url_col}`"), host, path) + _shared(shares, host, path)
    return urls.withColumns({f"x{i}": v for i, v in enumerate(values)})


def _logit(share: float) -> float:
    return math.log(share / (1 - share))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "rule_verdict", *,
          most: int = MOST, seed: int = 11) -> UrlModel:
    """A model of which URLs are blocked, from rows with a URL, its ``host`` and ``path``
    (``match_rules`` gives them) and a label ``block`` or another value."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(
        F.col(f"`{url_col}`").alias("url"), "host", "path",
        (F.col(label_col) == "block").cast("int").alias("y"))
    cells = [F.struct(F.lit(at).alias("kind"), _cell(at, key).alias("cell"))
             for at, key in enumerate(_suffixes(F.col("host"), F.col("path")))]
    # At most CELLS rows for each of the three suffixes.
    found = (rows.select("y", F.inline(F.array(*cells)))
             .groupBy("kind", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("b")).collect())
    n = sum(r["n"] for r in found if r["kind"] == 0)
    blocked = sum(r["b"] for r in found if r["kind"] == 0)
    if n == 0:
        return UrlModel(-1.0)
    overall = (blocked + 1) / (n + 2)
    shares = [[overall] * CELLS for _ in SUFFIXES]
    for r in found:
        shares[r["kind"]][r["cell"]] = (r["b"] + PRIOR * overall) / (r["n"] + PRIOR)
    model = UrlModel(_logit(overall), shares)
    if blocked in (0, n):
        return model

    distinct = rows.agg(F.approx_count_distinct("url")).first()[0] or 1
    share = F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(1 << 30)) / float(1 << 30)
    sample = (rows.where(share < most / distinct).groupBy("url", "host", "path")
              .agg(F.max("y").alias("y")).orderBy(F.xxhash64("url"), "url").limit(2 * most))
    sample = stored(_with_features(sample, shares, "url").drop("url", "host", "path"), "urls")
    _boost(model, sample)
    return model


def _boost(model: UrlModel, sample: DataFrame) -> None:
    """Add the trees.  Each level reads the sample once and gives the driver at most
    nodes x features x BINS sums."""
    values = [F.col(f"x{i}") for i in range(len(FEATURES))]
    share = [k / BINS for k in range(1, BINS)]
    row = sample.agg(*[F.percentile_approx(v, share, 10_000).alias(f"q{i}")
                       for i, v in enumerate(values)]).first()
    if row["q0"] is None:
        return
    cuts = [sorted(set(row[f"q{i}"])) for i in range(len(FEATURES))]
    bins = [sum([(v > c).cast("int") for c in q], F.lit(0)).alias("bin") for v, q in zip(values, cuts)]
    for _ in range(TREES):
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-_raw(model, values)))
        graded = sample.withColumn("p", chance).select(
            "*", F.round((F.col("p") - F.col("y")) * UNIT).cast("long").alias("g"),
            F.round(F.col("p") * (1 - F.col("p")) * UNIT).cast("long").alias("s"))
        root = Node()
        open_nodes = [(root, F.lit(True))]
        for level in range(DEPTH + 1):
            where = F.lit(None).cast("int")
            for k, (_, here) in enumerate(open_nodes):
                where = F.when(here, F.lit(k)).otherwise(where)
            marks = F.array(*[F.struct(F.lit(i).alias("feature"), b) for i, b in enumerate(bins)])
            sums = (graded.select(where.alias("node"), "g", "s", F.inline(marks))
                    .where("node is not null").groupBy("node", "feature", "bin")
                    .agg(F.sum("g").alias("g"), F.sum("s").alias("s")).collect())
            following = []
            for k, (node, here) in enumerate(open_nodes):
                mine = [r for r in sums if r["node"] == k]
                if not _split(node, mine, cuts) or level == DEPTH:
                    node.feature = -1
                    continue
                node.below, node.above = Node(), Node()
                high = values[node.feature] > node.cut
                following += [(node.below, here & ~high), (node.above, here & high)]
            open_nodes = following
            if not open_nodes:
                break
        model.trees.append(root)


def _split(node: Node, sums: list, cuts: list[list[float]]) -> bool:
    """Set a node's value and its best split; False if none gains."""
    g = sum(r["g"] for r in sums if r["feature"] == 0) / UNIT
    s = sum(r["s"] for r in sums if r["feature"] == 0) / UNIT
    node.value = -RATE * g / (s + RIDGE)
    best = 1e-6
    for f, q in enumerate(cuts):
        low_g = low_s = 0.0
        by_bin = {r["bin"]: (r["g"] / UNIT, r["s"] / UNIT) for r in sums if r["feature"] == f}
        for k, cut in enumerate(q):
            add = by_bin.get(k, (0.0, 0.0))
            low_g, low_s = low_g + add[0], low_s + add[1]
            gain = low_g ** 2 / (low_s + RIDGE) + (g - low_g) ** 2 / (s - low_s + RIDGE) \
                - g ** 2 / (s + RIDGE)
            if gain > best:
                best, node.feature, node.cut = gain, f, cut
    return node.feature >= 0


def _raw(model: UrlModel, features: list[Column]) -> Column:
    out = F.lit(model.base)
    for tree in model.trees:
        out = out + tree.column(features)
    return out


def score(urls: DataFrame, model: UrlModel, url_col: str = "url") -> DataFrame:
    """``urls`` (with ``host`` and ``path``) with ``score``, the chance of a block."""
    if not model.trees:
        return urls.withColumn("score", F.lit(1 / (1 + math.exp(-model.base))))
    names = urls.columns
    rows = urls.select(F.struct("*").alias("row"), F.col(f"`{url_col}`").alias("url"), "host", "path")
    raw = _raw(model, [F.col(f"x{i}") for i in range(len(FEATURES))])
    return (_with_features(rows, model.shares, "url")
            .select("row", (F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))).alias("score"))
            .select(*[F.col(f"row.`{c}`") for c in names], "score"))


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", *,
                most: int = MOST) -> DataFrame:
    """Every row with ``host``, ``path``, the longest ``rule`` that fits, its
    ``rule_verdict``, the method's ``score`` and the ``verdict``: the rule's, else
    ``block`` where the score is above one half."""
    matched = match_rules(urls, rules, url_col)
    model = train(matched, url_col, most=most)
    judged = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return score(matched, model, url_col).withColumn(
        "verdict", F.coalesce("rule_verdict", judged))
