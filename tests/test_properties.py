"""Property tests: folds against a row-by-row fold, merges against inputs,
positions unique and dense, pages against the full sort."""

from __future__ import annotations

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from groovehouse.operators import catalogue as cat
from groovehouse.operators import changes as ch
from groovehouse.operators.positions import assign_ids, global_positions

T0 = dt.datetime(2024, 1, 1)


def _py_admit(stock: dict, cart: dict, events: list) -> list:
    """Row-by-row reference fold of D-22 (events sorted by (ts, id))."""
    held = dict(cart)
    s = dict(stock)
    out = []
    for eid, _ts, u, a, d in sorted(events, key=lambda e: (e[3], e[1], e[0])):
        h = held.get((u, a), 0)
        if d > 0:
            ok = s.get(a, 0) > 0
            if ok:
                s[a] -= 1
                h += 1
        else:
            ok = h > 0
            if ok:
                s[a] = s.get(a, 0) + 1
                h -= 1
        held[(u, a)] = h
        out.append((eid, ok, s.get(a, 0), h))
    return sorted(out)


def test_admission_equals_row_by_row_fold(spark, shop_small):
    s = shop_small
    adm = ch.admit_cart_events(s.albums, s.cart, s.cart_events)
    got = sorted((r.event_id, r.accepted, r.stock_after, r.cart_after) for r in adm.collect())
    stock = {r.album_id: r.stock for r in s.albums.collect()}
    cart = {(r.user_id, r.album_id): r.quantity for r in s.cart.collect()}
    evs = [(r.event_id, r.ts, r.user_id, r.album_id, r.delta) for r in s.cart_events.collect()
           if r.album_id in stock]
    assert got == _py_admit(stock, cart, evs)


def test_stock_plus_cart_is_conserved(spark, shop_small):
    s = shop_small
    adm = ch.admit_cart_events(s.albums, s.cart, s.cart_events)
    new_stock = ch.move_stock(s.albums, adm)
    new_cart = ch.cart_after_admission(s.cart, adm)
    before = (s.albums.agg(F.sum("stock")).first()[0]
              + s.cart.join(s.albums.select("album_id"), "album_id")
              .agg(F.sum("quantity")).first()[0])
    after = (new_stock.agg(F.sum("stock")).first()[0]
             + new_cart.join(s.albums.select("album_id"), "album_id")
             .agg(F.sum("quantity")).first()[0])
    assert before == after
    assert new_stock.filter("stock < 0").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from([-1, 1]), st.integers(0, 400)),
                min_size=1, max_size=40),
       st.integers(0, 3))
def test_clamped_ledger_equals_row_by_row(spark, evs, start):
    data = [(i, T0 + dt.timedelta(minutes=m), 1, a, d) for i, (a, d, m) in enumerate(evs)]
    events = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, "
                                         "album_id long, delta long")
    st_df = spark.createDataFrame([(1, 0, start)], "user_id long, album_id long, quantity long")
    got = {r.album_id: r.quantity for r in ch.fold_cart(st_df, events).collect()}
    want = {0: start}
    for _i, _ts, _u, a, d in sorted(data, key=lambda e: (e[1], e[0])):
        want[a] = max(0, want.get(a, 0) + d)
    assert got == {k: v for k, v in want.items() if v > 0}


def test_merge_of_diff_gives_new(spark, shop_small):
    s = shop_small
    merged, _albums = ch.merge_songs(s.songs, s.albums, s.new_songs, "2024-06-01 00:00:00")
    assert rows(merged) == rows(s.new_songs.select(*s.songs.columns))


def test_global_positions_unique_dense_and_ordered(spark, shop_small):
    s = shop_small
    order = [F.col("price").desc_nulls_first(), F.col("album_id").desc()]
    pos = global_positions(s.albums.select("album_id", "price"), order, "pos", partitions=5)
    got = [r.album_id for r in pos.orderBy("pos").collect()]
    want = [r.album_id for r in s.albums.orderBy(*order).collect()]
    assert got == want
    p = [r.pos for r in pos.collect()]
    assert sorted(p) == list(range(1, len(want) + 1))


def test_assign_ids_continue_from_max(spark, shop_small):
    s = shop_small
    new = s.users.select("user_id")
    out = assign_ids(new, s.orders_h, "order_id", [F.col("user_id").asc()])
    top = s.orders_h.agg(F.max("order_id")).first()[0]
    ids = sorted(r.order_id for r in out.collect())
    assert ids == list(range(top + 1, top + 1 + new.count()))


def test_pages_concatenate_to_full_sort(spark, shop_small):
    s = shop_small
    full = [r.album_id for r in cat.album_listing_columns(
        cat.albums_with_artist(s.albums, s.artists))
        .orderBy(F.col("title").asc_nulls_last(), F.col("album_id").asc()).collect()]
    pages = []
    for p in range(1, len(full) // 8 + 2):
        pages += [r.album_id for r in
                  cat.album_page(s.albums, s.artists, p, "title", "ascending").collect()]
    assert pages == full


def test_draft_fold_equals_row_by_row(spark, shop_small):
    s = shop_small
    got = {(r.purchase_order, r.album_id): r.quantity for r in
           ch.fold_draft_quantities(s.purchase_order_lines, s.albums, s.draft_events).collect()}
    stock = {r.album_id: r.stock for r in s.albums.collect()}
    start = {}
    for r in s.purchase_order_lines.collect():
        k = (r.purchase_order, r.album_id)
        start[k] = start.get(k, 0) + r.quantity
    state = {k: v for k, v in start.items() if k[1] in stock}
    for r in sorted(s.draft_events.collect(), key=lambda e: (e.ts, e.event_id)):
        k = (r.purchase_order, r.album_id)
        if r.album_id not in stock:
            continue
        x = state.get(k, 0)
        if r.delta > 0:
            x = 1 if x == 0 else (x + 1 if x + 1 <= 10 - stock[r.album_id] else x)
        else:
            x = max(0, x - 1)
        state[k] = x
    assert got == {k: v for k, v in state.items() if v > 0}


def test_stream_parity_random_slices(spark, shop_small):
    import __spark_entry__ as E
    q = E.queries()
    a = rows(q["stream_cart"](spark, "/root/testdata/sf0.001"))
    b = rows(q["fold_cart"](spark, "/root/testdata/sf0.001"))
    assert a == b
    random.seed(1)


def test_draft_fold_hot_group_split_across_partitions(spark):
    from decimal import Decimal

    from groovehouse.operators.folds import fold_draft_quantities
    from groovehouse.schemas import SCHEMAS
    rnd = random.Random(7)
    albums = spark.createDataFrame(
        [(a, "t", 2000, st, Decimal("1.00"), "p", 1, T0) for a, st in ((1, 3), (2, 10), (3, 0))],
        SCHEMAS["albums"])
    lines = spark.createDataFrame([(9, 1, 1, 4), (9, 2, 3, 12)],
                                  "purchase_order long, line long, album_id long, quantity long")
    evs = []
    for i in range(600):                       # one hot group holds most events
        a = 1 if i % 10 else rnd.choice([2, 3])
        evs.append((i, T0 + dt.timedelta(seconds=i), 9, a, rnd.choice([1, 1, -1])))
    events = spark.createDataFrame(evs, "event_id long, ts timestamp_ntz, purchase_order long, "
                                        "album_id long, delta long")
    got = {(r.album_id): (r.quantity, r.born_by_event, r.birth) for r in
           fold_draft_quantities(lines, albums, events, partitions=13).collect()}
    stock = {1: 3, 2: 10, 3: 0}
    state = {1: (4, False, 1), 3: (12, False, 2)}
    for i, _ts, _po, a, d in evs:
        x, be, b = state.get(a, (0, False, None))
        if d > 0:
            if x == 0:
                x, be, b = 1, True, i
            elif x + 1 <= 10 - stock[a]:
                x += 1
        else:
            x = max(0, x - 1)
        state[a] = (x, be, b)
    assert got == {a: v for a, v in state.items() if v[0] > 0}


def test_folds_carry_state_across_arrow_batches(spark, shop_small):
    """Tiny Arrow batches: a group's events arrive in many batches."""
    s = shop_small
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        adm = ch.admit_cart_events(s.albums, s.cart, s.cart_events)
        got = sorted((r.event_id, r.accepted, r.stock_after, r.cart_after)
                     for r in adm.collect())
        drafts = {(r.purchase_order, r.album_id): r.quantity for r in
                  ch.fold_draft_quantities(s.purchase_order_lines, s.albums,
                                           s.draft_events).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    stock = {r.album_id: r.stock for r in s.albums.collect()}
    cart = {(r.user_id, r.album_id): r.quantity for r in s.cart.collect()}
    evs = [(r.event_id, r.ts, r.user_id, r.album_id, r.delta) for r in s.cart_events.collect()
           if r.album_id in stock]
    assert got == _py_admit(stock, cart, evs)
    want = {(r.purchase_order, r.album_id): r.quantity for r in
            ch.fold_draft_quantities(s.purchase_order_lines, s.albums, s.draft_events).collect()}
    assert drafts == want


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.sampled_from([-1, 1]),
                          st.integers(0, 30)), min_size=1, max_size=40),
       st.tuples(st.integers(0, 3), st.integers(0, 3)),
       st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(1, 2)),
                max_size=4, unique_by=lambda t: (t[0], t[1])))
def test_admission_random_streams(spark, evs, stocks, holds):
    from decimal import Decimal

    from groovehouse.schemas import SCHEMAS
    albums = spark.createDataFrame(
        [(a, "t", 2000, stocks[a], Decimal("1.00"), "p", 1, T0) for a in (0, 1)],
        SCHEMAS["albums"])
    cart = spark.createDataFrame([(u, a, q) for u, a, q in holds],
                                 "user_id long, album_id long, quantity long")
    data = [(i, T0 + dt.timedelta(minutes=m), u, a, d) for i, (u, a, d, m) in enumerate(evs)]
    events = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, "
                                         "album_id long, delta long")
    got = sorted((r.event_id, r.accepted, r.stock_after, r.cart_after)
                 for r in ch.admit_cart_events(albums, cart, events).collect())
    want = _py_admit({0: stocks[0], 1: stocks[1]},
                     {(u, a): q for u, a, q in holds}, data)
    assert got == want
