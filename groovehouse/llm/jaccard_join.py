"""Operator 6, n-gram Jaccard join with a token-group matrix.

Documents with equal shingle sets are one node.  Nodes are first partitioned
into groups of similar ones: a node meets the pivots (two nodes of those)
that share one of its minimum hashes, and those it is verified to link with put it
into one component; a component is cut into groups of bounded size.  The
token-group matrix then stores each group's token union: the distinct (token,
group) pairs of the prefix tokens that several nodes hold.  A query node's
overlap with a group is bounded from the matrix, and only groups of other
components whose bound qualifies are opened: the node's whole set is compared
with every member's.  Nodes of one component need no comparison, so a large
group of near copies costs its size, not its square.

Prefix filter: of n tokens in a fixed order, linked sets share one of the
first n - ceil(t n) + 1.  The order puts tokens that a count sketch of the
whole corpus finds frequent last; it decides the work, never the result.

Cases: null, empty and blank texts have no shingle, link with nothing and are
their own component; a text of fewer words than a shingle has one; repeated
rows and equal texts link; null ids come last among ids; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, plain_texts, row_chunks, stored
from .components import connected_components
from .filters import bit_filter, flagged, in_filter
from .words import SPACED, Powers, distinct_per_text, mix, shingle_hashes, span_hashes, word_spans

#: Counters of the frequency sketch, in blocks of one row each.
COUNTERS, BLOCKS = 1 << 20, 64
#: Members of a group, and queries that one opening of a group compares.
GROUP, OPENING = 256, 1024
MINHASHES = 4


def sets_of(batch: pa.RecordBatch, powers: Powers, size: int
            ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows [lo, hi): distinct shingle hashes of each text, their
    edges and row numbers, and each set's hash (its node)."""
    data, offsets, _ = bytes_of(batch.column("text"))
    for lo, hi in row_chunks(offsets):
        part, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        starts, ends, first = word_spans(part, at, SPACED)
        hashes, text_of = shingle_hashes(span_hashes(part, starts, ends, powers), first, size)
        flat, edge = distinct_per_text(hashes, text_of, hi - lo)
        counts = np.diff(edge)
        rows = np.repeat(np.arange(hi - lo), counts)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(1)))))
        node = mix(sums[edge[1:]] - sums[edge[:-1]] + counts.astype(np.uint64))
        yield lo, hi, flat, edge, rows, node.view(np.int64)


def digests(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, h, n, node, m0 ...): text hash, set size, set hash and minimum hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for lo, hi, flat, edge, _, node in sets_of(batch, powers, size):
                counts = np.diff(edge)
                full = np.flatnonzero(counts)
                out = [batch.column("doc_id").slice(lo, hi - lo), batch.column("h").slice(lo, hi - lo),
                       pa.array(counts, pa.int64()),
                       pa.array(node, pa.int64())]
                for j in range(MINHASHES):
                    least = np.zeros(hi - lo, np.uint64)
                    if len(full):
                        least[full] = np.minimum.reduceat(mix(flat ^ np.uint64(0x5bd1e995 * (j + 1))),
                                                          edge[:-1][full])
                    out.append(pa.array(least.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    out, ["doc_id", "h", "n", "node", *[f"m{j}" for j in range(MINHASHES)]])

    docs = docs.withColumn("h", F.xxhash64("text"))
    return docs.mapInArrow(run, f"doc_id {kind}, h long, n long, node long, "
                           + ", ".join(f"m{j} long" for j in range(MINHASHES)))


def frequency_classes(docs: DataFrame, size: int) -> np.ndarray:
    """How far above the mean each counter of the sketch is, in powers of two of its spread.
    The sketch counts the shingles of all documents; its size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counters = Powers(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, flat, _, _, _ in sets_of(batch, powers, size):
                counters += np.bincount(flat >> np.uint64(44), minlength=COUNTERS)
        yield blocks(counters)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, any_row = np.zeros(COUNTERS, np.int64), False
        step = COUNTERS // BLOCKS
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(),
                            strict=True):
                counters[b * step:(b + 1) * step] += np.frombuffer(x, "<u4")
                any_row = True
        if any_row:
            yield blocks(counters)

    def blocks(counters: np.ndarray) -> pa.RecordBatch:
        step = COUNTERS // BLOCKS
        counts = np.minimum(counters, (1 << 32) - 1).astype("<u4")
        found = [k for k in range(BLOCKS) if counts[k * step:(k + 1) * step].any()]
        return pa.RecordBatch.from_pydict({
            "block": pa.array(found, pa.int32()),
            "counts": pa.array([counts[k * step:(k + 1) * step].tobytes() for k in found], pa.binary())})

    schema = "block int, counts binary"
    summed = (docs.select("text").mapInArrow(count, schema)
              .repartition(BLOCKS, "block").mapInArrow(add, schema))
    counters = np.zeros(COUNTERS, np.int64)
    for r in summed.collect():  # COUNTERS numbers in all
        step = COUNTERS // BLOCKS
        counters[r["block"] * step:(r["block"] + 1) * step] += np.frombuffer(r["counts"], "<u4")
    mean = counters.mean()  # of tokens that meet by chance, whose number varies by its root
    level = np.maximum(counters - mean, 0) // (4 * np.sqrt(mean) + 4)
    return np.minimum(np.ceil(np.log2(level + 1)), 63).astype(np.uint8)


def prefix_tokens(docs: DataFrame, size: int, percent: int, classes, shared=None) -> DataFrame:
    """(token, node, n, place): the prefix tokens of every set and their places in its
    order; with ``shared``, a bit filter, only tokens that pass it.  A task emits equal
    sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, rank = Powers(), classes.value
        done: set[int] = set()
        for batch in batches:
            for lo, hi, flat, edge, rows, node in sets_of(batch, powers, size):
                counts = np.diff(edge)
                fresh = np.array([not (x in done or done.add(x)) for x in node.tolist()])
                take = counts - -(-percent * counts // 100) + 1
                key = rank[flat >> np.uint64(44)].astype(np.uint64) << np.uint64(58) | flat >> np.uint64(6)
                order = np.argsort(key)
                order = order[np.argsort(rows[order].astype(np.uint16) if hi - lo < 1 << 16
                                         else rows[order], kind="stable")]
                place = np.arange(len(flat)) - edge[rows]
                keep = (place < take[rows]) & fresh[rows]
                token, of, place = flat[order][keep].view(np.int64), rows[keep], place[keep]
                if shared is not None:
                    ok = in_filter(shared.value, token)
                    token, of, place = token[ok], of[ok], place[ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token, pa.int64()), pa.array(node[of], pa.int64()),
                     pa.array(counts[of], pa.int64()), pa.array(place, pa.int64())],
                    ["token", "node", "n", "place"])

    return docs.select("text").mapInArrow(run, "token long, node long, n long, place long")


def node_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, tokens) of the given nodes: whole sets, ascending 64-bit.  They are read
    once, dealt by node as they are, so they are not written in between."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bit_filter(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        done: set[int] = set()
        for batch in batches:
            for _, _, flat, edge, _, node in sets_of(batch, powers, size):
                ok = np.flatnonzero(in_filter(wanted.value, node))
                ok = [k for k in ok if not (node[k] in done or done.add(node[k]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[ok], pa.int64()),
                     pa.array([flat[edge[k]:edge[k + 1]].tobytes() for k in ok], pa.binary())],
                    ["node", "tokens"])

    sets = docs.select("text").mapInArrow(run, "node long, tokens binary")
    sets = sets.join(nodes.select("node").distinct(), "node", "left_semi")
    return sets.groupBy("node").agg(F.first("tokens").alias("tokens"))


def open_groups(members: DataFrame, queries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the queries (grp, node) of a group and its members
    (grp, node), one link per query and opening.  A group with many queries is
    opened several times, each time for a share of them."""
    times = queries.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / OPENING).cast("int").alias("times"))
    asked = queries.join(times, "grp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("times")))
    held = members.join(times, "grp").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times").cast("long") - 1)))
    rows = held.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    rows = (rows.join(sets, "node").select("grp", "part", "asks", "node", "tokens")
            .repartition("grp", "part").sortWithinPartitions("grp", "part", "asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets, index = None, [], [], None
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("grp", "part", "asks", "node")]
            tokens = batch.column("tokens")
            for k, (grp, part, asks, node) in enumerate(zip(*columns, strict=True)):
                own = np.frombuffer(tokens[k].as_buffer(), np.uint64)
                if at != (grp, part):
                    at, nodes, sets, index = (grp, part), [], [], None
                if not asks:
                    nodes.append(node)
                    sets.append(own.copy())
                    continue
                if index is None:
                    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                    order = np.argsort(every)
                    index = every[order], owner[order], np.array([len(x) for x in sets])
                every, owner, sizes = index
                lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
                counts = hi - lo
                hits = np.repeat(lo, counts) + np.arange(counts.sum()) \
                    - np.repeat(np.cumsum(counts) - counts, counts)
                overlap = np.bincount(owner[hits], minlength=len(sizes))
                linked = np.flatnonzero((100 * overlap >= percent * (sizes + len(own) - overlap))
                                        & (overlap > 0))
                # members are of one component: one link to them says all
                found += [(node, nodes[m]) for m in linked[:1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()),
                                              pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, root) of every document: the size
    of its set of distinct ``size``-word shingles and the smallest id it reaches
    by links, pairs whose Jaccard similarity is at least ``percent`` hundredths.
    ``text_hash`` (xxhash64) tells rows of one id apart, ``root`` components (null
    for a document without shingles)."""
    docs = plain_texts(docs, id_col, text_col)
    spark: SparkSession = docs.sparkSession
    every = stored(digests(docs, size), "digests")
    full = every.where("n > 0")

    # Groups of similar nodes: links with the pivots of shared minimum hashes.
    pairs = None
    for j in range(MINHASHES):
        # another order of the nodes for each minimum hash, so that pivots differ
        rank = F.xxhash64("node", F.lit(j))
        pivots = (full.groupBy(F.col(f"m{j}").alias("m"))
                  .agg(F.min_by("node", rank).alias("p0"), F.max_by("node", rank).alias("p1"))
                  .where("p0 != p1").select("m", F.explode(F.array("p0", "p1")).alias("pivot")))
        met = (full.select("node", F.col(f"m{j}").alias("m")).distinct().join(pivots, "m")
               .where("node != pivot").select("node", "pivot"))
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = stored(pairs.distinct(), "pivots")
    involved = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct()
    sets = node_sets(docs, involved, size)
    links = stored(open_groups(pairs.select(F.col("pivot").alias("grp"), F.col("pivot").alias("node")).distinct(),
                               pairs.select(F.col("pivot").alias("grp"), "node"), sets, percent), "links")
    comps = connected_components(links)

    # Prefix tokens that several nodes hold.
    classes = spark.sparkContext.broadcast(frequency_classes(docs, size))
    held = prefix_tokens(docs, size, percent, classes)
    repeated = stored(held.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
                      .select("token"), "tokens")
    shared = spark.sparkContext.broadcast(bit_filter(repeated, "token"))
    # A group: up to about GROUP nodes of one component; a lone node is its own.
    sizes = comps.groupBy("root").agg(F.count(F.lit(1)).alias("c_size"))
    member = comps.join(sizes, "root").select(
        "node", "root", "c_size",
        F.when(F.col("c_size") <= GROUP, F.col("root")).otherwise(F.xxhash64(
            "root", F.pmod(F.xxhash64("node"), F.ceil(2 * F.col("c_size") / GROUP)))).alias("grp"))
    # Tokens that more than one component holds: the rows are dealt by token once, and
    # only those of such tokens are written.
    of_token = Window.partitionBy("token")
    held = (prefix_tokens(docs, size, percent, classes, shared).join(member, "node", "left").select(
        "token", "node", "n", "place", F.coalesce("root", "node").alias("root"),
        F.coalesce("c_size", F.lit(1).cast("long")).alias("c_size"),
        F.coalesce("grp", "node").alias("grp"))
        .join(repeated, "token", "left_semi").distinct()
        .withColumns({"r0": F.min("root").over(of_token), "r1": F.max("root").over(of_token)})
        .where("r0 != r1").drop("r0", "r1"))
    held = stored(held, "held")
    # The matrix of those.  Sets of n and m tokens that are linked have
    # percent (n + m) / (100 + percent) of them in common, and as many from their first
    # common one on in each: the places of that one are no further on.
    matrix = held.groupBy("token", "grp").agg(
        F.first("root").alias("g_root"), F.first("c_size").alias("g_size"),
        F.min("n").alias("least"), F.max("n").alias("most"),
        F.expr(f"max(100 * n - {100 + percent} * place)").alias("reach"))
    # The nodes of the smaller component ask the groups of the larger one.
    asks = (F.col("c_size") < F.col("g_size")) | (
        (F.col("c_size") == F.col("g_size")) & (F.col("root") > F.col("g_root")))
    met = stored(held.drop("grp").join(matrix, "token").where(asks)
                 .where(f"100 * most >= {percent} * n and 100 * n >= {percent} * least")
                 .where(f"reach >= {percent} * n and {100 * (100 + percent)} * (n - place) "
                        f">= {100 * percent} * n + {percent} * greatest(100 * least, {percent} * n)")
                 .select("node", "grp", "n").distinct(), "met")
    # Of these the matched tokens, whole prefixes.
    of_node = flagged(held, met, "node", "#own").where("`#own`").groupBy("node") \
        .agg(F.collect_set("token").alias("own"))
    of_grp = flagged(matrix, met, "grp", "#own").where("`#own`").groupBy("grp") \
        .agg(F.collect_set("token").alias("theirs"), F.min("least").alias("least"), F.max("most").alias("most"))
    overlap = met.join(of_node, "node").join(of_grp, "grp").select(
        "node", "grp", "n", "least", "most", F.size(F.array_intersect("own", "theirs")).alias("matched"))
    # Overlap with a member: at most the matched prefix tokens and all of the rest of
    # the one whose prefix ends first, the query's or (of ``big`` tokens at most) the member's.
    low = f"ceil({percent} * greatest(least, {percent} * n / 100) / {100 + percent}.0 " \
          f"+ {percent} * n / {100 + percent}.0 - 1e-6)"
    rest = f"ceil({percent} * n / 100.0) - 1"
    big = f"least(most, 100.0 * n / {percent})"
    larger = f"most > n and matched + {percent} * {big} / 100.0 + 1e-6 > {percent} * (n + {big}) / {100 + percent}.0"
    asking = stored(overlap.where(f"matched + {rest} >= {low} or {larger}").select("grp", "node"), "asking")
    opened = asking.select("grp").distinct()
    # All members of an opened group, also those without a mixed token.
    lone = asking.select("grp").distinct().join(member.select("grp").distinct(), "grp", "left_anti")
    members = (member.select("grp", "node").join(opened, "grp", "left_semi")
               .unionByName(lone.select("grp", F.col("grp").alias("node"))))
    involved = asking.select("node").unionByName(members.select("node")).distinct()
    sets = node_sets(docs, involved, size)
    more = open_groups(members, asking, sets, percent)

    comps = connected_components(links.unionByName(stored(more, "links")))
    # Classes of equal sets, their component's smallest id, and back to the rows.
    classes_ = full.groupBy("node").agg(F.min("doc_id").alias("least_id"))
    root = classes_.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = root.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = root.join(least, "root").select("node", "root", "component_id")
    linked = full.join(of, "node").select("doc_id", F.col("h").alias("text_hash"),
                                          F.col("n").alias("n_shingles"), "component_id", "root")
    alone = every.where("n = 0").select("doc_id", F.col("h").alias("text_hash"), F.col("n").alias("n_shingles"),
                                        F.col("doc_id").alias("component_id"),
                                          F.lit(None).cast("long").alias("root"))
    return linked.unionByName(alone)
