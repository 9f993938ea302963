"""Positions, ids and numbers inside a key by fixed bounds (D-3, S-5, W-1, W-2).

``row_number().over(Window.orderBy(...))`` moves every row to one task, and a
window per key moves a hot key to one task.  Here the rows are dealt into
buckets that follow the sort order.  The cut points are a stored table, drawn
from the rows with a low hash of their sort key, so a row's bucket is a
plain expression over fixed data: whichever job or retried task evaluates it, it
gives the same bucket, and nothing has to be pinned.  Rows are numbered inside
their bucket by a window and what earlier buckets hold is added: for positions
the rows of all earlier buckets (one number a bucket), for numbers inside a key
only the earlier rows of keys that a cut point splits (at most one key a cut).
Both tables have no more rows than there are buckets and are broadcast.

Finding the bucket of a row costs far more than sorting it, so numbers inside a key
use buckets only for the keys that need them: the frequent keys, which one pass over
the key columns finds.  All other keys are numbered by a plain window.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored_table

#: Rows of the sample per bucket: buckets differ by about a fifth in size.
SAMPLE_PER_BUCKET = 32

#: A key with fewer rows than this is never frequent: one task sorts them at once.
FREQUENT_ROWS = 100_000

_SORT = re.compile(r"^(.*?)(?: (ASC|DESC))?(?: NULLS (FIRST|LAST))?$", re.S)


@dataclass(frozen=True)
class SortKey:
    """One column of a sort order."""
    text: str
    descending: bool
    nulls_first: bool

    @classmethod
    def of(cls, column: Column | str) -> SortKey:
        """From a sort column (``F.col("price").desc()``) or its SQL text."""
        text = column if isinstance(column, str) else str(column)[len("Column<'"):-len("'>")]
        name, way, nulls = _SORT.match(text.strip()).groups()
        down = way == "DESC"
        return cls(name, down, nulls == "FIRST" if nulls else not down)

    def value(self, df: DataFrame) -> Column:
        return F.col(f"`{self.text}`") if self.text in df.columns else F.expr(self.text)

    def sorted(self, column: Column) -> Column:
        if self.descending:
            return column.desc_nulls_first() if self.nulls_first else column.desc_nulls_last()
        return column.asc_nulls_first() if self.nulls_first else column.asc_nulls_last()

    def before(self, a: Column, b: Column) -> Column:
        """Does ``a`` sort strictly before ``b``?"""
        less = (a > b) if self.descending else (a < b)
        return (F.when(a.isNull(), b.isNotNull() if self.nulls_first else F.lit(False))
                .when(b.isNull(), F.lit(not self.nulls_first)).otherwise(less))


def _width(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_points(df: DataFrame, order: list[SortKey], partitions: int | None = None) -> DataFrame:
    """The stored table of cut points (``_i``, ``_k0``, ``_k1``, …), about one per
    bucket.  The sample holds the sort keys whose hash is below a share that gives
    about ``SAMPLE_PER_BUCKET`` rows a bucket, each once: repeated rows do not swell
    it, and only these rows meet in one task."""
    keys = [k.value(df).alias(f"_k{i}") for i, k in enumerate(order)]
    names = [f"_k{i}" for i in range(len(order))]
    share = SAMPLE_PER_BUCKET * _width(df, partitions) / max(df.count(), 1)
    chance = F.shiftrightunsigned(F.xxhash64(*names), 11) / float(1 << 53)
    sample = df.select(*keys).where(chance < share).distinct()
    place = F.row_number().over(Window.orderBy(*[k.sorted(F.col(n)) for k, n in zip(order, names)]))
    cuts = (sample.withColumn("_i", place).where(F.col("_i") % SAMPLE_PER_BUCKET == 0)
            .select("_i", *names))
    return stored_table(cuts, "cuts")


def _with_bucket(df: DataFrame, order: list[SortKey], cuts: DataFrame) -> DataFrame:
    """``df`` with ``_gh_pid``: how many cut points lie before or at the row,
    found by halving the sorted array of cut points."""
    names = cuts.columns
    array = cuts.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("a")).scalar()
    row = [k.value(df) for k in order]

    def after(cut: Column) -> Column:
        """Does the cut point sort after the row?"""
        decided: Column = F.lit(False)
        for i in reversed(range(len(order))):
            c = cut[f"_k{i}"]
            decided = F.when(c.eqNullSafe(row[i]), decided).otherwise(order[i].before(row[i], c))
        return decided

    size = F.size("_gh_cuts")
    # (lo, hi): the cut points below lo lie before the row, those from hi on after it.
    start = F.struct(F.lit(0).alias("lo"), size.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        late = after(F.get(F.col("_gh_cuts"), mid))
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & ~late, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(open_ & late, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + F.lit(1.0))).cast("int"))
    return (df.withColumn("_gh_cuts", array)
            .withColumn("_gh_pid", F.aggregate(steps, start, halve)["lo"]).drop("_gh_cuts"))


def with_bucket(df: DataFrame, order: list[Column | str], col: str,
                partitions: int | None = None) -> DataFrame:
    """``df`` with ``col``, the number of the bucket of its place in ``order``: buckets
    of about equal size that follow one another, the same in every evaluation."""
    keys = [SortKey.of(c) for c in order]
    return _with_bucket(df, keys, cut_points(df, keys, partitions)).withColumnRenamed("_gh_pid", col)


def global_positions(df: DataFrame, order: list[Column], pos_col: str = "pos",
                     partitions: int | None = None) -> DataFrame:
    """Add ``pos_col`` = 1..n in the total order ``order`` (which must end in
    a unique key)."""
    keys = [SortKey.of(c) for c in order]
    dealt = _with_bucket(df, keys, cut_points(df, keys, partitions))
    counts = dealt.groupBy("_gh_pid").agg(F.count(F.lit(1)).alias("_gh_n"))
    # One row a bucket: a single small task is fine here.
    before = Window.orderBy("_gh_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_gh_pid", F.coalesce(F.sum("_gh_n").over(before), F.lit(0)).alias("_gh_off"))
    inside = Window.partitionBy("_gh_pid").orderBy(*[k.sorted(k.value(df)) for k in keys])
    return (dealt.withColumn("_gh_row", F.row_number().over(inside))
            .join(F.broadcast(offsets), "_gh_pid")
            .withColumn(pos_col, (F.col("_gh_off") + F.col("_gh_row")).cast("bigint"))
            .drop("_gh_pid", "_gh_row", "_gh_off"))


def assign_ids(new: DataFrame, current: DataFrame, id_col: str, order: list[Column],
               start_after: int = 0) -> DataFrame:
    """D-3: surrogate ids for appended rows, continuing from the highest id
    in ``current`` (like a serial), in the order ``order``."""
    top = current.agg(F.coalesce(F.max(id_col), F.lit(start_after)).cast("bigint")).scalar()
    pos = global_positions(new, order, "_gh_pos")
    return pos.withColumn(id_col, top + F.col("_gh_pos")).drop("_gh_pos")


def edge_carry(dealt: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """(``_gh_pid``, ``_c0``, …, ``_gh_carry``): rows of a key in earlier buckets,
    for the keys that a cut point splits; others are not counted at all."""
    split = cuts.select(*[F.col(f"_k{i}").alias(f"_c{i}") for i in range(len(keys))]).distinct()
    same = None
    for i, k in enumerate(keys):
        c = dealt[f"`{k}`"].eqNullSafe(split[f"_c{i}"])
        same = c if same is None else same & c
    names = [f"_c{i}" for i in range(len(keys))]
    counts = (dealt.join(F.broadcast(split), same)
              .groupBy(*names, "_gh_pid").agg(F.count(F.lit(1)).alias("_gh_n")))
    before = Window.partitionBy(*names).orderBy("_gh_pid").rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("_gh_carry", F.sum("_gh_n").over(before))
            .where("_gh_carry is not null").drop("_gh_n").withColumnRenamed("_gh_pid", "_c_pid"))


def frequent_keys(df: DataFrame, keys: list[str], partitions: int | None = None,
                  least: int = FREQUENT_ROWS) -> list[int]:
    """The hashes of the keys that hold half a task's share of the rows or more (and at
    least ``least``), by one pass over the key columns with a sketch of bounded size.  The
    sketch may name a key with somewhat fewer rows too, which only deals more rows."""
    width = _width(df, partitions)
    # Its counts err by less than a quarter of a task's share.
    size = min(max(1 << (16 * width - 1).bit_length(), 4096), 1 << 19)
    hashed = df.select(F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("_h"))
    found = hashed.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_h, {2 * width}, {size})").alias("top")).first()
    bound = max(found["n"] / (2 * width), least)
    return [item["item"] for item in found["top"] if item["count"] >= bound]


def rank_within(df: DataFrame, keys: list[str], order: list[Column], col: str,
                partitions: int | None = None, bound: DataFrame | None = None,
                frequent_rows: int = FREQUENT_ROWS) -> DataFrame:
    """Dense 1..n numbering inside each key, in ``order`` (which must make rows
    unique inside a key).  A key that holds half a task's share of the rows is numbered
    over several tasks (``_rank_in_buckets``), all others by one window.  ``bound``:
    a table that is cheaper to read and whose ``keys`` are those of ``df`` before inner
    joins; only how rows are dealt depends on it, never a number."""
    hot = frequent_keys(df if bound is None else bound, keys, partitions, frequent_rows)
    by_key = [F.col(f"`{k}`") for k in keys]
    window = Window.partitionBy(*by_key).orderBy(*[k.sorted(k.value(df)) for k in map(SortKey.of, order)])

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{c}`") for c in rows.columns],
                           F.row_number().over(window).cast("bigint").alias(col))

    if not hot:
        return plain(df)
    frequent = F.xxhash64(*by_key).isin(hot)
    return plain(df.where(~frequent)).unionByName(
        _rank_in_buckets(df.where(frequent), keys, order, col, partitions))


def _rank_in_buckets(df: DataFrame, keys: list[str], order: list[Column], col: str,
                     partitions: int | None = None) -> DataFrame:
    """Numbering of keys with many rows: ``row_number`` inside (bucket, key) plus the
    carry of keys that go on over a cut point.  The rows are shuffled once, by (bucket,
    key), so a key that holds a third of the rows is spread over its buckets."""
    total = [SortKey.of(F.col(f"`{k}`").asc()) if k not in df.columns else SortKey(k, False, True)
             for k in keys] + [SortKey.of(c) for c in order]
    cuts = cut_points(df, total, partitions)
    dealt = _with_bucket(df, total, cuts)
    inside = Window.partitionBy("_gh_pid", *keys).orderBy(
        *[k.sorted(k.value(df)) for k in total[len(keys):]])
    numbered = dealt.withColumn("_gh_row", F.row_number().over(inside))
    carry = edge_carry(dealt, cuts, keys)
    here = F.col("_gh_pid") == F.col("_c_pid")
    for i, k in enumerate(keys):
        here = here & F.col(f"`{k}`").eqNullSafe(F.col(f"_c{i}"))
    return (numbered.join(F.broadcast(carry), here, "left")
            .withColumn(col, (F.col("_gh_row") + F.coalesce("_gh_carry", F.lit(0))).cast("bigint"))
            .select(*df.columns, col))
