"""Operator 13, Merkle dataset manifest: a SHA-256 tree whose parents keep the hash
state before each child.

Every row is a leaf: the digest of its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value.  The leaves of a part (a source) ascend by id; while
several nodes remain, each run of ``FANOUT`` consecutive ones becomes the digest of
its digests (as hex text).  What remains is the part's subroot; the subroots in order
of their parts (null first) are folded likewise into the root.

A parent keeps a copy of its hash state before each child slot (``Tree``).  To fold a
changed leaf, the state of its slot is resumed with the replacement and the siblings
on its right only; the siblings on its left are not hashed again.

How it is spread: leaves are numbered inside their part by fixed cut points (a hot part
lies in many buckets), and ``BLOCK`` consecutive leaves of a part, a whole subtree, are
one task's unit of work.  Going up, each block gives one node, so a table shrinks to
its ``BLOCK``-th part with each round until every part has one node.  Going down, each
block learns the siblings on the way from its top to the root, one row a block, and
then proves and folds its own leaves.  A task holds one block, never a part.

Cases: a null part is a part of its own, the first; null ids come first in their part;
rows of one id ascend by leaf, so repeated rows are neighbours with equal leaves; an
empty text is not a null text; further columns are left out; an empty table gives no
rows; texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.positions import global_positions, rank_within
from .common import stored

FANOUT = 3
#: Levels of the subtree that one task builds at a time.
HEIGHT = 8
BLOCK = FANOUT ** HEIGHT


def digest(columns: list[Column]) -> Column:
    """The leaf of a row's fields, in their order."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class Tree:
    """A tree over digests (hex text): ``rows`` per level from the leaves to the top,
    and for each parent of ``slots`` the hash states before its children."""

    def __init__(self, leaves: list[str], height: int | None = None) -> None:
        self.rows: list[list[bytes]] = [[x.encode() for x in leaves]]
        self.slots: list[list[list]] = []
        while len(self.rows[-1]) > 1 if height is None else len(self.slots) < height:
            below, above, kept = self.rows[-1], [], []
            for lo in range(0, len(below), FANOUT):
                state, before = hashlib.sha256(), []
                for child in below[lo:lo + FANOUT]:
                    before.append(state.copy())
                    state.update(child)
                kept.append(before)
                above.append(state.hexdigest().encode())
            self.rows.append(above)
            self.slots.append(kept)

    @property
    def top(self) -> str:
        return self.rows[-1][0].decode()

    def siblings(self, at: int) -> list[tuple[bytes, bytes]]:
        """Per level from below, the digests left and right of the node on the way."""
        out = []
        for row in self.rows[:-1]:
            lo = at - at % FANOUT
            out.append((b"".join(row[lo:at]), b"".join(row[at + 1:lo + FANOUT])))
            at //= FANOUT
        return out

    def fold(self, at: int, leaf: str) -> bytes:
        """The top if ``leaf`` stood at ``at``: each parent's state before the slot is
        resumed with the replacement and the right siblings."""
        node = leaf.encode()
        for row, kept in zip(self.rows, self.slots):
            state = kept[at // FANOUT][at % FANOUT].copy()
            state.update(node)
            for right in row[at + 1:at - at % FANOUT + FANOUT]:
                state.update(right)
            node = state.hexdigest().encode()
            at //= FANOUT
        return node


def _block_tree(hashes: list[str], block: int) -> Tree:
    """The subtree of a block: full height, unless its part has no other block."""
    return Tree(hashes, HEIGHT if block > 0 or len(hashes) == BLOCK else None)


# ---- blocks of sorted rows --------------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch], tree: int, block: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal tree and block; rows come sorted by both."""
    run: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if run and (row[tree], row[block]) != (run[0][tree], run[0][block]):
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _emit(rows: Iterator[tuple], schema: pa.Schema, most: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _per_block(rows: DataFrame, order: list[str], schema: T.StructType,
               work: Callable[[list[tuple]], Iterator[tuple]]) -> DataFrame:
    """``work`` on the rows of each (tree, block), in ``order``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    tree, block = rows.columns.index("tree"), rows.columns.index("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit((out for rows in _blocks(batches, tree, block) for out in work(rows)), arrow)

    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)
    return dealt.mapInArrow(run, schema)


def _block_of(pos: str) -> Column:
    return F.floor(F.col(pos) / F.lit(BLOCK)).cast("long").alias("block")


def _climb(nodes: DataFrame) -> DataFrame:
    """(tree, pos, hash) of the blocks' tops."""
    schema = T.StructType([nodes.schema["tree"], T.StructField("pos", T.LongType()),
                           T.StructField("hash", T.StringType())])

    def top(rows: list[tuple]) -> Iterator[tuple]:
        yield rows[0][0], rows[0][1], _block_tree([r[3] for r in rows], rows[0][1]).top

    return _per_block(nodes.select("tree", _block_of("pos"), "pos", "hash"), ["pos"], schema, top)


def _forest(nodes: DataFrame) -> list[DataFrame]:
    """Stored tables of (tree, pos, hash): the given nodes, then the blocks' tops and so
    on; in the last one every tree has one node."""
    levels = [nodes]
    highest = nodes.agg(F.max("pos")).first()[0] or 0
    while highest >= 0:
        levels.append(stored(_climb(levels[-1]), "merkle-nodes"))
        highest = highest // BLOCK if highest >= BLOCK else -1
    return levels


def _pairs(path: list[tuple[bytes, bytes]]) -> list[str]:
    return [x.decode() for pair in path for x in pair]


def _with_paths(nodes: DataFrame, above: DataFrame, extra: list[str], order: list[str],
                schema: T.StructType, work: Callable[[list[tuple], list[str]], Iterator[tuple]]
                ) -> DataFrame:
    """``work`` on each block's nodes and the siblings above its top.  ``above``: (tree,
    pos, path) of the blocks' tops; its row is sorted before the block's nodes."""
    none = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ["pos", "hash", *extra]]
    tops = above.select("tree", F.col("pos").alias("block"), *none, "path")
    rows = nodes.select("tree", _block_of("pos"), "pos", "hash", *extra,
                        F.lit(None).cast("array<string>").alias("path")).unionByName(tops)

    def run(block: list[tuple]) -> Iterator[tuple]:
        if len(block) > 1:
            yield from work(block[1:], block[0][-1])

    return _per_block(rows, ["pos", *order], schema, run)


def _descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, pos, path) of the nodes: a label of the tree, then the siblings up to the
    root, left and right per level."""
    schema = T.StructType([nodes.schema["tree"], T.StructField("pos", T.LongType()),
                           T.StructField("path", T.ArrayType(T.StringType()))])

    def paths(rows: list[tuple], path: list[str]) -> Iterator[tuple]:
        tree = _block_tree([r[3] for r in rows], rows[0][1])
        for at, row in enumerate(rows):
            yield row[0], row[2], path[:1] + _pairs(tree.siblings(at)) + path[1:]

    return _with_paths(nodes, above, [], [], schema, paths)


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of the nodes of ``levels[0]``'s blocks, from those of the trees' last nodes."""
    above = tops
    for nodes in reversed(levels[1:-1]):
        above = stored(_descend(nodes, above), "merkle-paths")
    return above


# ---- manifest ---------------------------------------------------------------

def prove(docs: DataFrame, *, id_col: str = "doc_id", part_col: str = "source",
          fields: list[str] | None = None, claimed: dict[str, Column] | None = None,
          proofs: bool = True) -> DataFrame:
    """The manifest of a table: per row its id, ``part``, ``leaf``, ``subroot``, ``root``,
    ``proof`` (the siblings from the leaf to the root; null unless ``proofs``),
    ``proof_sha256`` (their digest), ``folded_root`` (the root that the row as it is
    claimed to be gives with the original siblings) and ``verified``.

    ``fields`` are hashed in their order; ``claimed`` replaces fields by other values, to
    check a copy of the rows against the manifest (none: the rows as they are)."""
    fields = fields or [id_col, part_col, "lang", "n_chars", "text"]
    claimed = claimed or {}
    given = [F.col(f"`{c}`") for c in fields]
    # One scan of the texts; all that follows works on digests.
    leaves = stored(docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{part_col}`").alias("tree"), digest(given).alias("hash"),
        digest([claimed.get(c, F.col(f"`{c}`")) for c in fields]).alias("claimed")), "merkle-leaves")
    numbered = rank_within(leaves, ["tree"], ["id ASC", "hash ASC", "claimed ASC"], "rank")
    leaves = stored(numbered.select("tree", (F.col("rank") - 1).alias("pos"), "hash", "id", "claimed"),
                    "merkle-ranked")

    parts = _forest(leaves.select("tree", "pos", "hash"))
    # The subroots are the leaves of one further tree.
    named = stored(global_positions(parts[-1].select(F.col("tree").alias("part"), "hash"),
                                    ["part ASC"], "rank"), "merkle-subroots")
    summits = _forest(named.select(F.lit(0).alias("tree"), (F.col("rank") - 1).alias("pos"), "hash"))
    root = summits[-1].select("hash").first()
    root = root["hash"] if root else None
    top = _paths(summits, summits[-1].select("tree", "pos", F.array(F.lit("")).alias("path")))
    steps = _descend(summits[0], top)
    # Where each part's subroot lies below the root; the subroot is its tree's label.
    tops = (named.join(steps.select((F.col("pos") + 1).alias("rank"), "path"), "rank")
            .select(F.col("part").alias("tree"), F.lit(0).cast("long").alias("pos"),
                    F.concat(F.array("hash"), F.slice("path", 2, 1 << 30)).alias("path")))
    above = _paths(parts, tops)
    return _prove_leaves(leaves, above, docs.schema[id_col], root, proofs)


def _prove_leaves(leaves: DataFrame, above: DataFrame, id_field: T.StructField, root: str | None,
                  proofs: bool) -> DataFrame:
    schema = T.StructType([
        T.StructField(id_field.name, id_field.dataType), T.StructField("part", leaves.schema["tree"].dataType),
        T.StructField("leaf", T.StringType()), T.StructField("subroot", T.StringType()),
        T.StructField("root", T.StringType()), T.StructField("proof", T.ArrayType(T.StringType())),
        T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType()),
        T.StructField("verified", T.BooleanType())])

    def work(rows: list[tuple], path: list[str]) -> Iterator[tuple]:
        tree = _block_tree([r[3] for r in rows], rows[0][1])
        # Above the block: the state behind the left siblings, the right ones, per level.
        subroot, upper = path[0], list(zip(path[1::2], path[2::2]))
        states = [(hashlib.sha256(left.encode()), right.encode()) for left, right in upper]
        tail = "".join(left + right for left, right in upper).encode()
        for at, (part, _, _, leaf, ident, claimed, _) in enumerate(rows):
            near = tree.siblings(at)
            node = tree.fold(at, claimed)
            for state, right in states:
                state = state.copy()
                state.update(node)
                state.update(right)
                node = state.hexdigest().encode()
            all_of_them = b"".join(x + y for x, y in near) + tail
            folded = node.decode()
            proof = None
            if proofs:
                text = all_of_them.decode()
                proof = [text[k:k + 64] for k in range(0, len(text), 64)]
            yield (ident, part, leaf, subroot, root, proof, hashlib.sha256(all_of_them).hexdigest(),
                   folded, folded == root)

    return _with_paths(leaves, above, ["id", "claimed"], [], schema, work)
