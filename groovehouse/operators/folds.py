"""Order-dependent folds over event tables (D-8, D-22, D-23).

A fold over the events of a key is cut into segments of the sort order, so that a
key with a third of all events is spread over tasks like any other rows:

``clamped_ledger`` (D-8): a quantity that never drops below zero is a running sum
clamped at 0.  The pair (total, lowest prefix) of a run of events combines
associatively: a window summarises each segment, a second one combines the
segments of a key.

``fold_draft_quantities`` (D-23): a draft line moves by one between 0 and its cap, a
clamp at both ends.  The effect of a run of clicks is a map x -> min(hi, max(lo,
x + shift)), and such maps combine into one of the same form.

``admit_cart_events`` (D-22): stock is shared by all users of an album, so no small
summary of a run exists.  Segments are folded side by side from presumed entry
states, and folded again until what they decide agrees with what was presumed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored_table
from .positions import rank_within, with_bucket

# The fold step of D-22 runs in Python workers, which need not have this package on
# their path (a driver started elsewhere, a cluster without the wheel): it is
# shipped by value with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Events of one segment: the most that an admission step or a click map holds.
SEGMENT_EVENTS = 200_000


# ---- D-8: cart ledger -------------------------------------------------------

def clamped_ledger(start: DataFrame, events: DataFrame, keys: list[str],
                   qty: str = "quantity", delta: str = "delta", ts: str = "ts",
                   seq: str = "event_id", partitions: int | None = None) -> DataFrame:
    """End quantity per key after ``events`` on top of ``start``; a step
    below zero is ignored.  Keys ending at 0 are kept (callers drop them).

    Rows are dealt into buckets of the order (key, time, id) by fixed cut points.  A
    segment is what a bucket holds of a key: a key with a burst of events, or with a
    third of them all, has a segment in each of its buckets."""
    first = start.select(*keys, F.lit(None).cast("timestamp_ntz").alias("_ts"),
                         F.lit(None).cast("bigint").alias("_seq"), F.col(qty).cast("bigint").alias("_d"))
    rest = events.select(*keys, F.col(ts).alias("_ts"), F.col(seq).cast("bigint").alias("_seq"),
                         F.col(delta).cast("bigint").alias("_d"))
    rows = with_bucket(first.unionByName(rest), [*keys, "_ts", "_seq"], "_seg", partitions)
    # A window and an aggregate on the same keys share one shuffle.
    inside = (Window.partitionBy(*keys, "_seg").orderBy(F.col("_ts").asc(), F.col("_seq").asc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    segments = (rows.withColumn("_run", F.sum("_d").over(inside)).groupBy(*keys, "_seg")
                .agg(F.sum("_d").alias("_t"), F.min("_run").alias("_m")))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    per = (segments.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0)))
           .groupBy(*keys)
           .agg(F.sum("_t").alias("_total"), F.min(F.col("_before") + F.col("_m")).alias("_low")))
    return per.select(*keys, (F.col("_total") - F.least(F.lit(0), F.col("_low")))
                      .cast("bigint").alias(qty))


# ---- D-22: admission of cart events per album ------------------------------

ADMIT_SCHEMA = ("album_id long, _seg long, event_id long, user_id long, delta long, _rank long, "
                "_presumed boolean, accepted boolean, stock_after long, cart_after long")
_ADMIT_OUT = [c.split()[0] for c in ADMIT_SCHEMA.split(", ")]


def _admit_step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold sorted segments: first the album's stock, then the users' holdings as the
    segment is entered, then its events.  Only the current segment's state is kept."""
    segment = None
    stock = 0
    held: dict[int, int] = {}
    for b in batches:
        # Plain lists: per-element access is much cheaper than numpy scalars.
        kinds, users, qty = b["_kind"].tolist(), b["user_id"].tolist(), b["_qty"].tolist()
        deltas = b["delta"].tolist()
        n = len(b)
        accepted, stocks, holdings = [False] * n, [0] * n, [0] * n
        for i, key in enumerate(zip(b["album_id"].tolist(), b["_seg"].tolist())):
            if key != segment:
                segment, stock, held = key, 0, {}
            if kinds[i] == 0:
                stock = int(qty[i])
            elif kinds[i] == 1:
                held[users[i]] = int(qty[i])
            else:
                h = held.get(users[i], 0)
                if deltas[i] > 0:
                    ok, step = stock > 0, 1
                else:
                    ok, step = h > 0, -1
                if ok:
                    stock -= step
                    h += step
                held[users[i]] = h
                accepted[i], stocks[i], holdings[i] = ok, stock, h
        out = b.assign(accepted=accepted, stock_after=stocks, cart_after=holdings)
        out = out[b["_kind"] == 2][_ADMIT_OUT]
        yield out.astype({"event_id": "int64", "user_id": "int64", "delta": "int64", "_rank": "int64",
                          "_presumed": "bool"})


def _entries(events: DataFrame, albums: DataFrame, cart: DataFrame) -> DataFrame:
    """The state in which segments are entered if exactly the adds marked ``_presumed``
    are refused: (album, segment, kind, user, quantity) with the stock (kind 0) and the
    holdings of the users that occur in the segment (kind 1).  A user's holding is a
    clamped running sum, so all of it is windows over sums, in parallel."""
    step = F.when(F.col("delta") <= 0, -1).when(F.col("_presumed"), 0).otherwise(1)
    pair = ["album_id", "user_id"]
    inside = Window.partitionBy(*pair, "_seg").orderBy("_rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    runs = (events.withColumn("_d", step).withColumn("_run", F.sum("_d").over(inside))
            .groupBy(*pair, "_seg").agg(F.sum("_d").alias("_t"), F.min("_run").alias("_m")))
    before = Window.partitionBy(*pair).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    start = cart.groupBy(*pair).agg(F.sum("quantity").cast("bigint").alias("_h0"))
    held = (runs.withColumn("_tb", F.coalesce(F.sum("_t").over(before), F.lit(0)))
            .withColumn("_low", F.min(F.col("_tb") + F.col("_m")).over(before))
            .join(start, pair, "left")
            .withColumn("_h0", F.coalesce("_h0", F.lit(0))))
    entry = F.col("_h0") + F.col("_tb") - F.least(F.lit(0), F.col("_h0") + F.coalesce("_low", F.lit(0)))
    held = held.withColumn("_h", entry).withColumn(
        "_end", F.col("_h") + F.col("_t") - F.least(F.lit(0), F.col("_h") + F.col("_m")))
    taken = held.groupBy("album_id", "_seg").agg(F.sum(F.col("_end") - F.col("_h")).alias("_taken"))
    earlier = Window.partitionBy("album_id").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    stock = (taken.withColumn("_before", F.coalesce(F.sum("_taken").over(earlier), F.lit(0)))
             .join(albums.select("album_id", F.col("stock").cast("bigint").alias("_s0")), "album_id", "left")
             .select("album_id", "_seg", F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("user_id"),
                     F.greatest(F.coalesce("_s0", F.lit(0)) - F.col("_before"), F.lit(0))
                     .cast("bigint").alias("_qty")))
    return stock.unionByName(held.select("album_id", "_seg", F.lit(1).alias("_kind"), "user_id",
                                         F.col("_h").cast("bigint").alias("_qty")))


def _fold_segments(events: DataFrame, entries: DataFrame) -> DataFrame:
    none = {c: F.lit(None).cast("bigint") for c in ("event_id", "delta", "_rank")}
    rows = events.withColumns({"_kind": F.lit(2), "_qty": F.lit(None).cast("bigint")}).unionByName(
        entries.withColumns({**none, "_presumed": F.lit(False)}))
    dealt = rows.repartition("album_id", "_seg").sortWithinPartitions("album_id", "_seg", "_kind", "_rank")
    return dealt.mapInPandas(_admit_step, ADMIT_SCHEMA)


def admit_cart_events(albums: DataFrame, cart: DataFrame, events: DataFrame,
                      segment_events: int = SEGMENT_EVENTS) -> DataFrame:
    """D-22: in time order per album, an add is accepted while stock > 0 and
    a remove while the user holds the album; each event is marked.

    An album's events are cut into segments of ``segment_events`` by their rank.  The
    first round presumes that every add is accepted, which gives each segment's entry
    state by sums alone, and all segments are folded side by side.  As long as the
    folds refuse just what was presumed, the entry states were the true ones: the
    first segment's is, hence its decisions, hence the second's, and so on.  So an album
    that never runs out is done in one round, however many events it has.  Where a
    segment decides otherwise, it and all before it are settled, and the rest is folded
    again from the true state behind it, presuming the refusals just found.  An album
    that sells out over and over settles about a segment a round.  No task holds more
    than a segment, and the result is a stored table, so that every consumer reads the
    one fold."""
    base = events.select("album_id", "user_id", "event_id", F.col("delta").cast("bigint"), "ts")
    ranked = rank_within(base, ["album_id"], [F.col(c).asc() for c in ("ts", "event_id", "user_id")], "_rank")
    ranked = stored_table(ranked.select(
        "album_id", F.floor((F.col("_rank") - 1) / F.lit(segment_events)).cast("bigint").alias("_seg"),
        "event_id", "user_id", "delta", "_rank", F.lit(False).alias("_presumed")), "admission")
    first = F.col("_seg") == 0
    known = albums.select("album_id", F.lit(0).cast("bigint").alias("_seg"), F.lit(0).alias("_kind"),
                          F.lit(None).cast("bigint").alias("user_id"),
                          F.col("stock").cast("bigint").alias("_qty")).unionByName(
        cart.select("album_id", F.lit(0).cast("bigint").alias("_seg"), F.lit(1).alias("_kind"),
                    "user_id", F.col("quantity").cast("bigint").alias("_qty")))
    # Albums of several segments, few by nature: each has at least ``segment_events`` events.
    long = ranked.groupBy("album_id").agg(F.max("_seg").alias("_last")).where("_last > 0")
    long = stored_table(long, "admission-long")
    later = _entries(ranked.join(long, "album_id", "left_semi"), albums, cart).where(~first)
    done, events_left, entries = [], ranked, known.unionByName(later)
    while True:
        out = stored_table(_fold_segments(events_left, entries), "admission")
        refused = (F.col("delta") > 0) & ~F.col("accepted")
        # The first segment of an album that decides otherwise than presumed.
        wrong = (out.join(long, "album_id").where((F.col("_seg") < F.col("_last")) & (refused != F.col("_presumed")))
                 .groupBy("album_id").agg(F.min("_seg").alias("_wrong")))
        wrong = stored_table(wrong, "admission-wrong")
        if wrong.isEmpty():
            done.append(out)
            break
        marked = out.join(wrong, "album_id", "left")
        done.append(marked.where("_wrong is null or _seg <= _wrong").drop("_wrong"))
        again = marked.where("_wrong is not null").withColumn("_presumed", refused)
        entries = stored_table(_entries(again.select(*ranked.columns), albums, cart)
                               .join(wrong, "album_id").where("_seg > _wrong"), "admission-entries")
        events_left = again.where("_seg > _wrong").select(*ranked.columns)
        # From here on: the true state behind the segment just settled.
        albums = entries.where("_kind = 0 and _seg = _wrong + 1").select("album_id", F.col("_qty").alias("stock"))
        cart = (entries.where("_kind = 1").groupBy("album_id", "user_id")
                .agg(F.min_by("_qty", "_seg").alias("quantity")))
        entries = entries.drop("_wrong")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select("event_id", "user_id", "album_id", "delta", "accepted", "stock_after", "cart_after")


# ---- D-23: draft purchase-order lines edited by +1/-1 clicks ---------------

def _click(x: Column, cap: Column, up: Column) -> Column:
    """A line's quantity after a click: +1 opens a line at 1 and counts only within the
    cap, -1 stops at 0.  The cap is 1 at least, since an absent line always opens."""
    return F.when(up, F.when(x < cap, x + 1).otherwise(x)).otherwise(F.greatest(x - 1, F.lit(0).cast("bigint")))


def fold_draft_quantities(lines: DataFrame, albums: DataFrame, events: DataFrame,
                          partitions: int | None = None,
                          segment_events: int = SEGMENT_EVENTS) -> DataFrame:
    """D-23 core: final quantity per (order, album) after ordered +1/-1
    clicks: +1 on an absent album opens a line at 1; +1 on a line counts
    only while quantity + stock stays within 10; -1 stops at 0 (the line is
    dropped).  ``birth`` orders the surviving lines: the first line number
    for lines that were never dropped, else the event that opened them.

    Clicks are ranked inside their pair and cut into segments.  Each segment becomes
    a map (lo, hi, shift) of its entering quantity, the maps of a pair are combined in
    order, which gives every segment's entering quantity, and each segment is walked
    once more from there for its last opening.  A line that starts above its cap falls
    by its -1 clicks alone until it reaches the cap; its segments up to there have a
    known end, whatever came before."""
    keys = ["purchase_order", "album_id"]
    cap = albums.select("album_id", F.greatest(F.lit(10) - F.col("stock"), F.lit(1)).cast("bigint").alias("_cap"))
    start = (lines.groupBy(*keys)
             .agg(F.sum("quantity").cast("bigint").alias("_q0"),
                  F.min("line").cast("bigint").alias("_line"))
             .join(cap.select("album_id"), "album_id", "left_semi"))
    clicks = events.select(*keys, "ts", "event_id", (F.col("delta") > 0).alias("_up"))
    ranked = rank_within(clicks, keys, [F.col("ts").asc(), F.col("event_id").asc()], "_rank", partitions)
    segment = F.floor((F.col("_rank") - 1) / F.lit(segment_events)).cast("bigint")
    # At most ``segment_events`` clicks in an array.
    segments = (ranked.groupBy(*keys, segment.alias("_seg"))
                .agg(F.sort_array(F.collect_list(F.struct("_rank", "event_id", "_up"))).alias("_clicks"),
                     F.count_if(~F.col("_up")).alias("_downs"))
                .join(cap, "album_id").join(start.select(*keys, "_q0"), keys, "left")
                .withColumn("_q0", F.coalesce("_q0", F.lit(0)).cast("bigint")))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.withColumn("_fallen", F.coalesce(F.sum("_downs").over(before), F.lit(0)))

    zero, c = F.lit(0).cast("bigint"), F.col("_cap")

    def clamp(m: Column, click: Column) -> Column:
        up = click["_up"]
        return F.struct(*[_click(m[k], c, up).alias(k) for k in ("lo", "hi")],
                        (m["shift"] + F.when(up, 1).otherwise(-1)).cast("bigint").alias("shift"))

    def walk(x: Column) -> Column:
        """(quantity, last opening) behind the segment's clicks."""
        return F.aggregate("_clicks", F.struct(x.alias("x"), F.lit(None).cast("bigint").alias("opened")),
                           lambda s, click: F.struct(
                               _click(s["x"], c, click["_up"]).alias("x"),
                               F.when(click["_up"] & (s["x"] == 0), click["event_id"])
                               .otherwise(s["opened"]).alias("opened")))

    # Above the cap on entry: the end does not depend on the map of earlier segments.
    above = F.col("_q0") - F.col("_fallen")
    known = F.when(above > c, walk(above)["x"])
    clamped = F.aggregate("_clicks", F.struct(zero.alias("lo"), c.alias("hi"), zero.alias("shift")), clamp)
    mapped = segments.withColumn("_map", F.when(
        known.isNotNull(), F.struct(known.alias("lo"), known.alias("hi"), zero.alias("shift"))).otherwise(clamped))

    # Combined in order: from the state before a segment to the one behind it.
    maps = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    passed = mapped.withColumn("_maps", F.collect_list("_map").over(maps))
    entering = F.aggregate("_maps", F.col("_q0"), lambda x, m: F.least(m["hi"], F.greatest(m["lo"], x + m["shift"])))
    walked = passed.withColumn("_walk", walk(entering)).select(*keys, "_seg", "_walk.*")
    folded = walked.groupBy(*keys).agg(
        F.max_by("x", "_seg").alias("_x"),
        F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("_seg"))).alias("_opened"))

    j = start.join(folded, keys, "full_outer")
    born = F.col("_opened").isNotNull()
    return (j.select(*keys, F.coalesce("_x", "_q0").cast("bigint").alias("quantity"),
                     born.alias("born_by_event"),
                     F.when(born, F.col("_opened")).otherwise(F.col("_line")).alias("birth"))
            .filter(F.col("quantity") > 0))
