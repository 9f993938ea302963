"""Hand-written rows for rules the synthetic data does not reach."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows
from groovehouse.functions import exprs
from groovehouse.operators import accounts as acc
from groovehouse.operators import audits as au
from groovehouse.operators import catalogue as cat
from groovehouse.operators import changes as ch
from groovehouse.operators import supply as sup
from groovehouse.schemas import SCHEMAS
from groovehouse.sources import forms

T0 = dt.datetime(2024, 1, 1)


def _df(spark, name, data):
    return spark.createDataFrame(data, SCHEMAS[name])


def _artists(spark):
    return _df(spark, "artists", [(1, "Ringo", "drums and more", T0),
                                  (2, "Solo Act", "a lone artist", T0),
                                  (3, "A%B Band", "percent band", T0)])


def _albums(spark):
    return _df(spark, "albums", [
        (10, "axb", 1999, 3, Decimal("10.00"), "p.jpg", 1, T0),
        (11, "a%b", 2000, None, None, "q.jpg", 1, T0),
        (12, "Other", 2001, 0, Decimal("5.00"), "r.jpg", 3, T0),
        (13, "No Artist", 2002, 1, Decimal("7.00"), "s.jpg", None, T0)])


def test_search_wildcards_act_like_the_reference(spark):
    a, r = _albums(spark), _artists(spark)
    ids = lambda q: sorted(x.album_id for x in cat.search_albums(a, r, q).collect())  # noqa
    assert ids("a_b") == [10, 11, 12]       # '_' matches any char, also in "A%B Band"
    assert ids("A%B") == [10, 11, 12]
    assert ids("%") == [10, 11, 12]         # the album without artist is never listed
    assert ids("RINGO") == [10, 11]


def test_null_sort_order_follows_postgres(spark):
    a, r = _albums(spark), _artists(spark)
    asc = [x.album_id for x in cat.album_page(a, r, 1, "stock", "ascending").collect()]
    desc = [x.album_id for x in cat.album_page(a, r, 1, "price", "descending").collect()]
    assert asc == [12, 10, 11]              # NULL last
    assert desc == [11, 10, 12]             # NULL first


def test_page_count_counts_albums_without_artist(spark):
    a, r = _albums(spark), _artists(spark)
    assert cat.page_count(a, r, "albums").first().pages == 1
    assert cat.page_count(a, r, "albums", "zzz").first().pages == 0


def test_artist_without_albums_has_empty_array_and_zero(spark):
    a, r = _albums(spark), _artists(spark)
    doc = {x.artist_id: x for x in cat.artist_with_albums(r, a).collect()}
    assert doc[2].albums == []
    assert [x.album_id for x in doc[1].albums] == [10, 11]
    counts = {x.artist_id: x.albums for x in cat.artist_listing(r, a).collect()}
    assert counts == {1: 2, 2: 0, 3: 1}


def test_account_with_empty_cart_and_no_orders(spark):
    users = _df(spark, "users", [(1, "user", "alice", T0), (2, "user", "bobby", T0)])
    cart = _df(spark, "cart", [(2, 10, 2)])
    orders = _df(spark, "orders_h", [])
    bridge = _df(spark, "orders_bridge", [])
    doc = {x.user_id: x for x in acc.account_document(
        users, cart, orders, bridge, _albums(spark), _artists(spark)).collect()}
    assert doc[1].cart.albums is None and doc[1].cart.balance is None
    assert doc[1].orders == []
    assert doc[2].cart.balance == 20.0 and doc[2].orders == []
    act = {x.user_id: x.summary for x in acc.user_activity(users, orders, cart).collect()}
    assert act == {1: "", 2: "1 albums in cart."}


def test_short_arrays_pad_with_null(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [100, 200], ["a", "b", "c"])],
                               "album_id long, track array<long>, duration array<long>, "
                               "song array<string>")
    out = rows(ch.arrays_to_rows(df, ["album_id"], ["track", "duration", "song"]))
    assert out == [(1, 1, 100, "a"), (1, 2, 200, "b"), (1, 3, None, "c")]


def test_rows_to_arrays_then_back_is_identity(spark, shop_small):
    s = shop_small.songs
    arr = ch.rows_to_arrays(s, ["album_id"], ["track", "duration", "song"], "track")
    back = ch.arrays_to_rows(arr, ["album_id"], ["track", "duration", "song"])
    assert rows(back) == rows(s.select("album_id", "track", "duration", "song"))


def test_form_line_twelve_and_durations(spark):
    kv = spark.createDataFrame([
        ("f", "track_12", " 12 "), ("f", "song_12", " Twelve "), ("f", "duration_12", " 2:49 "),
        ("f", "track_2", "2"), ("f", "song_2", "Two"), ("f", "duration_2", "  "),
        ("f", "album_id", "7")], "form_id string, key string, value string")
    out = rows(forms.song_form_rows(kv))
    assert out == [("f", 12, 12, "Twelve", 169), ("f", 2, 2, "Two", None)]


def test_wholesale_price_five_against_six(spark):
    df = spark.createDataFrame([(Decimal("10.00"), 5), (Decimal("10.00"), 6),
                                (Decimal("9.99"), 1)], "price decimal(10,2), q long")
    got = [r[0] for r in df.select(exprs.wholesale_total("price", "q")).collect()]
    assert got == [Decimal("35.00"), Decimal("36.00"), Decimal("6.99")]


def test_restock_cap_at_exactly_ten(spark):
    albums = _df(spark, "albums", [(1, "t", 2000, 4, Decimal("1.00"), "p", 1, T0),
                                   (2, "t", 2000, 10, Decimal("1.00"), "p", 1, T0)])
    lines = spark.createDataFrame([(1, 1, 1, 6), (1, 2, 1, 5), (1, 3, 2, 0)],
                                  "purchase_order long, line long, album_id long, quantity long")
    got = {(r.line): r.addable for r in sup.restock_flags(albums, lines).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_restock_flags_of_an_album_without_a_line(spark):
    albums = _df(spark, "albums", [(6, "t", 2000, 10, Decimal("1.00"), "p", 1, T0),
                                   (7, "t", 2000, 9, Decimal("1.00"), "p", 1, T0)])
    lines = spark.createDataFrame([(1, 1, 5, 6)],
                                  "purchase_order long, line long, album_id long, quantity long")
    got = {r.album_id: (r.addable, r.deletable) for r in sup.restock_flags(albums, lines).collect()}
    assert got == {6: (False, False), 7: (True, False)}


def test_delete_parents_refuses_or_cascades(spark):
    a, r = _albums(spark), _artists(spark)
    asked = spark.createDataFrame([(1,), (2,)], "artist_id long")
    left, refused, _ = ch.delete_parents(r, asked, "artist_id",
                                         [("albums", a, "artist_id", "restrict")])
    assert [x.artist_id for x in refused.collect()] == [1]
    assert sorted(x.artist_id for x in left.collect()) == [1, 3]
    songs = _df(spark, "songs", [(10, 1, 100, "x"), (12, 1, 100, "y")])
    asked = spark.createDataFrame([(12,)], "album_id long")
    left, refused, kids = ch.delete_parents(a, asked, "album_id",
                                            [("songs", songs, "album_id", "cascade")])
    assert refused.count() == 0
    assert [x.album_id for x in kids["songs"].collect()] == [10]


def test_audits_find_violations(spark):
    t = {n: _df(spark, n, []) for n in SCHEMAS}
    t["albums"] = _df(spark, "albums", [(1, "t", 2030, -1, Decimal("9.99"), "p", 99, T0),
                                        (1, "", 1999, 2, Decimal("123.45"), "p", None, T0)])
    t["users"] = _df(spark, "users", [(1, "root", "samename", T0), (2, "user", "samename", T0)])
    t["dispatches"] = _df(spark, "dispatches", [("d", None, "lost", "x")])
    pk = rows(au.audit_primary_keys(t))
    assert ("albums", "1", "repeated key", 2) in pk
    fk = rows(au.audit_foreign_keys(t))
    assert ("albums", "artist_id", "artists", "99", 1) in fk
    checks = rows(au.audit_checks(t))
    assert ("albums", "1", "stock", "-1") in checks
    assert ("dispatches", "d", "status", "lost") in checks
    assert ("users", "1", "role", "root") in checks
    assert rows(au.audit_unique(t["users"])) == [("samename", 2)]
    bad = rows(au.audit_input(t["albums"], t["artists"], t["songs"], t["users"]))
    assert ("album", "1", "release year") in bad and ("album", "1", "title length") in bad
    assert ("album", "1", "price format") in bad      # 123.45 has three leading digits


def test_fold_cart_ignores_remove_at_zero(spark):
    start = _df(spark, "cart", [(1, 5, 1)])
    evs = [(i, T0 + dt.timedelta(minutes=i * 50), 1, 5, d)
           for i, d in enumerate([-1, -1, 1, 1, -1, -1, -1, 1])]
    evs += [(100, T0, 2, 5, -1)]
    events = spark.createDataFrame(evs, "event_id long, ts timestamp_ntz, user_id long, "
                                        "album_id long, delta long")
    got = rows(ch.fold_cart(start, events))
    assert got == [(1, 5, 1)]              # 1,0,0,1,2,1,0,0,1; user 2 never gets a row


def test_scalar_formats(spark):
    df = spark.createDataFrame([(0, "2:49"), (61, ""), (3599, "x:1"), (3600, "10:00")],
                               "s long, t string")
    got = df.select(exprs.format_duration("s").alias("f"),
                    exprs.parse_duration("t").alias("p")).collect()
    assert [(r.f, r.p) for r in got] == [("0:00", 169), ("1:01", None), ("59:59", None),
                                         ("0:00", 600)]
    one = spark.createDataFrame([("AC/DC", "Back in Black!", "up.load.PNG", "Rock N Roll")],
                                "n string, t string, f string, s string")
    r = one.select(exprs.photo_name("n", "t", "f").alias("p"),
                   exprs.url_slug("s").alias("u")).first()
    assert r.p == "acdc-back-in-black.PNG"
    assert r.u == "rock-n-roll"


def test_confirmation_status_null_safe_and_empty(spark):
    lines = spark.createDataFrame([(1, 5, 5), (1, 3, None), (2, 4, 4), (3, None, None)],
                                  "purchase_order long, quantity long, confirmed_quantity long")
    got = {r.purchase_order: r.status for r in sup.confirmation_status(lines).collect()}
    assert got == {1: "pending-buyer", 2: "confirmed", 3: "confirmed"}


def test_receipt_gate_only_shipped(spark):
    d = _df(spark, "dispatches", [("a", 1, "shipped", "x"), ("b", 2, "received", "x")])
    req = spark.createDataFrame([("a",), ("b",), ("zz",)], "dispatch_id string")
    got = {r.dispatch_id: r.allowed for r in sup.receipt_gate(d, req).collect()}
    assert got == {"a": True, "b": False, "zz": False}


def test_remove_cart_items_whole_or_one(spark):
    cart = _df(spark, "cart", [(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 11, 1)])
    req = spark.createDataFrame([(1, None), (2, 11)], "user_id long, album_id long")
    assert rows(ch.remove_cart_items(cart, req)) == [(2, 10, 1)]


def test_update_by_key_last_change_wins(spark):
    d = _df(spark, "dispatches", [("a", 1, "shipped", "x")])
    chg = spark.createDataFrame([("a", "received", 2), ("a", "rescheduled", 1)],
                                "dispatch_id string, status string, seq long")
    out = ch.update_by_key(d, chg, ["dispatch_id"], ["status"], order_col="seq")
    assert out.first().status == "received"


def test_upsert_add(spark):
    cart = _df(spark, "cart", [(1, 10, 1)])
    delta = spark.createDataFrame([(1, 10, 2), (1, 11, 1)], "user_id long, album_id long, "
                                                            "quantity long")
    assert rows(ch.upsert_add(cart, delta, ["user_id", "album_id"], "quantity")) == \
        [(1, 10, 3), (1, 11, 1)]


def test_title_conflicts_new_and_edit(spark):
    a = _albums(spark)
    cand = spark.createDataFrame([(None, 1, "AXB"), (10, 1, "AXB"), (11, 1, "AXB"),
                                  (None, 2, "axb")],
                                 "album_id long, artist_id long, title string")
    got = sorted((r.album_id or 0) for r in ch.title_conflicts(a, cand).collect())
    assert got == [0, 11]


def test_match_previews_first_outside_album(spark):
    a, r = _albums(spark), _artists(spark)
    songs = _df(spark, "songs", [(10, 1, 100, "x"), (10, 2, 100, "y"), (12, 1, 50, "z")])
    ext = spark.createDataFrame([(7, "AXB", "RINGO"), (5, "axb", "ringo")],
                                "ext_album_id long, title string, artist string")
    tr = spark.createDataFrame([(5, 1, "p5-1"), (7, 1, "p7-1"), (7, 2, "p7-2")],
                               "ext_album_id long, position long, preview string")
    got = rows(cat.match_previews(a, r, songs, ext, tr))
    assert got == [(10, 1, "x", "p5-1"), (10, 2, "y", None), (12, 1, "z", None)]


def test_allow_list_admission(spark):
    allow = spark.createDataFrame([("ann:admin,bob:user",)], "allow string")
    req = spark.createDataFrame([("ann",), ("eve",)], "username string")
    got = rows(forms.admit_users(req, forms.allow_list(allow)))
    assert got == [("ann", "admin", True), ("eve", None, False)]


def test_draft_lines_fold_rules(spark):
    albums = _df(spark, "albums", [(1, "t", 2000, 8, Decimal("10.00"), "p", 1, T0),
                                   (2, "t", 2000, 10, Decimal("10.00"), "p", 1, T0),
                                   (3, "t", 2000, 0, Decimal("10.00"), "p", 1, T0)])
    lines = spark.createDataFrame(
        [(7, 1, 1, 1, Decimal("7.00")), (7, 2, 3, 2, Decimal("14.00")), (7, 3, 4, 5, Decimal("1.50")),
         (8, 4, 1, 3, Decimal("2.50"))],          # nobody clicked order 8, nor album 4 of order 7
        "purchase_order long, line long, album_id long, quantity long, line_total decimal(6,2)")
    ev = [(1, 1, +1), (2, 1, +1), (3, 1, +1),     # album 1: 1 -> 2, cap 2 holds
          (4, 2, +1), (5, 2, +1),                 # album 2: new line at 1, then capped
          (6, 3, -1), (7, 3, -1), (8, 3, -1)]     # album 3: 2 -> 1 -> 0 (dropped) -> 0
    events = spark.createDataFrame(
        [(i, T0 + dt.timedelta(seconds=i), 7, a, d) for i, a, d in ev],
        "event_id long, ts timestamp_ntz, purchase_order long, album_id long, delta long")
    got = rows(ch.fold_draft_lines(lines, albums, events), order=True)
    got = sorted(got)
    assert got == [(7, 1, 1, 2, Decimal("14.00")), (7, 2, 4, 5, Decimal("1.50")),
                   (7, 3, 2, 1, Decimal("7.00")), (8, 4, 1, 3, Decimal("2.50"))]


def test_one_document_per_parent_at_any_size(spark):
    """25,000 children under one parent give one document; the flat form numbers them."""
    from groovehouse.operators.nesting import nest_children, number_items
    df = spark.range(25_000).select(F.lit(1).cast("long").alias("album_id"), F.col("id").alias("track")).unionByName(
        spark.createDataFrame([(2, 5), (2, 1)], "album_id long, track long")).repartition(4)
    out = {r.album_id: r for r in nest_children(df, ["album_id"], F.struct("track"), "songs",
                                                [F.sum("track").alias("total")]).collect()}
    assert [x.track for x in out[1].songs] == list(range(25_000)) and [x.track for x in out[2].songs] == [1, 5]
    assert out[1].total == sum(range(25_000)) and out[2].total == 6
    flat = number_items(df, ["album_id"], ["track"])
    assert flat.where("album_id = 1 and item <> track + 1").count() == 0
    assert rows(flat.where("album_id = 2")) == [(2, 1, 1), (2, 5, 2)]


def test_rank_within_matches_row_number(spark, shop_small):
    from groovehouse.operators.positions import rank_within
    s = shop_small.purchase_order_lines
    got = rank_within(s.withColumnRenamed("line", "old"), ["purchase_order"],
                      [F.col("old").asc()], "n")
    assert got.filter("n <> old").count() == 0


def test_snapshot_roundtrip_with_declared_schemas(spark, shop_small):
    from groovehouse.sinks import save_snapshot
    from groovehouse.sources.tables import load_tables
    from groovehouse.streaming.streams import scratch_root
    root = scratch_root(spark, "tables")
    for name, df in shop_small.tables().items():
        path = save_snapshot(df, f"{root}/{name}", 1)
        assert path.endswith("/v=1")
    from groovehouse.sources.tables import read_table
    for n in SCHEMAS:
        df = read_table(spark, f"{root}/{n}/v=1", n)
        assert df.schema == SCHEMAS[n]
        assert df.count() == shop_small.tables()[n].count()
    assert set(load_tables(spark, root)) == set(SCHEMAS)


def test_dispatch_message_parsers(spark):
    from groovehouse.sources.messages import parse_dispatch_notes, parse_dispatch_updates
    raw = spark.createDataFrame(
        [('{"dispatch_id": "d-1", "purchase_order": 7, "status": "shipped", '
          '"address": "dock 1"}',)], "payload string")
    n = parse_dispatch_notes(raw).first()
    assert (n.dispatch_id, n.purchase_order, n.status, n.address) == ("d-1", 7, "shipped",
                                                                       "dock 1")
    raw = spark.createDataFrame(
        [('{"dispatch_id": "d-1", "status": "rescheduled", '
          '"estimated_delivery": "2024-02-03 10:00:00"}',), ('not json',)], "payload string")
    u = parse_dispatch_updates(raw).collect()
    assert u[0].estimated_delivery == dt.datetime(2024, 2, 3, 10, 0)
    assert u[1].dispatch_id is None


def test_stamp_now_or_fixed(spark):
    df = spark.range(1).select(exprs.stamp().alias("a"),
                               exprs.stamp("2024-06-01 00:00:00").alias("b"))
    r = df.first()
    assert r.b == dt.datetime(2024, 6, 1) and r.a.year >= 2024


def test_partitioned_snapshot_prunes_by_status(spark, shop_small):
    from groovehouse.sinks import save_snapshot
    from groovehouse.streaming.streams import scratch_root
    root = scratch_root(spark, "po")
    path = save_snapshot(shop_small.purchase_orders, root, 1, partition_by=["status"])
    df = spark.read.parquet(path).filter(F.col("status") == "pending-buyer")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan
    assert df.count() == shop_small.purchase_orders.filter(
        F.col("status") == "pending-buyer").count()


def test_null_order_in_every_sort_column(spark):
    """Every album sort column, both directions, against PostgreSQL's rule
    (NULL last ascending, first descending; id tie-break in the same
    direction)."""
    artists = _df(spark, "artists", [(1, "Ann", "a bio here", T0), (2, None, "no name", T0)])
    albums = _df(spark, "albums", [
        (10, "b", 2000, 1, Decimal("2.00"), "p", 1, T0),
        (11, None, None, None, None, "p", 1, None),
        (12, "a", 1999, 1, Decimal("2.00"), "p", 2, dt.datetime(2023, 1, 1)),
        (13, "c", 2001, 0, Decimal("1.00"), "p", 2, T0)])
    name_of = {1: "Ann", 2: None}
    rows_ = {r[0]: r for r in albums.collect()}

    def value(aid, col):
        r = rows_[aid]
        return {"name": name_of[r[6]], "title": r[1], "release_year": r[2], "stock": r[3],
                "price": r[4], "modified": r[7]}[col]

    for col in cat.ALBUM_SORTS:
        for direction in ("ascending", "descending"):
            got = [x.album_id for x in cat.album_page(albums, artists, 1, col,
                                                      direction).collect()]
            nulls = sorted([a for a in rows_ if value(a, col) is None],
                           reverse=direction == "descending")
            vals = sorted([a for a in rows_ if value(a, col) is not None],
                          key=lambda a: (value(a, col), a),
                          reverse=direction == "descending")
            want = vals + nulls if direction == "ascending" else nulls + vals
            assert got == want, (col, direction)


def test_local_time_in_another_zone_and_page_numbers(spark):
    import pytest
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5),), (dt.datetime(2024, 7, 9, 22, 0),)],
                               "t timestamp_ntz")
    got = [r[0] for r in df.select(exprs.local_time("t", "Europe/Berlin")).collect()]
    assert got == ["1.1.2024 01:05", "10.7.2024 00:00"]
    with pytest.raises(ValueError):
        cat.album_page(_albums(spark), _artists(spark), 0, "title", "ascending")


def test_documents_with_and_without_null_fields(spark):
    from groovehouse.sinks import to_documents
    df = spark.createDataFrame([(1, None, [1, 2])], "id long, note string, xs array<long>")
    dropped = to_documents(df, drop_nulls=True).first().value
    kept = to_documents(df, drop_nulls=False).first().value
    assert dropped == '{"id":1,"xs":[1,2]}'
    assert kept == '{"id":1,"note":null,"xs":[1,2]}'


def test_snapshot_never_overwrites_a_version(spark, shop_small):
    import pytest
    from pyspark.errors import AnalysisException

    from groovehouse.sinks import save_snapshot
    from groovehouse.streaming.streams import scratch_root
    root = scratch_root(spark, "versions")
    save_snapshot(shop_small.artists, root, 3)
    with pytest.raises(AnalysisException):
        save_snapshot(shop_small.artists, root, 3)
    assert spark.read.parquet(f"{root}/v=3").count() == shop_small.artists.count()
