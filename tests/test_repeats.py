"""Repeated keys and messages out of order, on hand-made rows (D-4, D-5, D-18 to D-20, ST-1)."""

from __future__ import annotations

import pytest
from conftest import rows
from groovehouse import session
from groovehouse.operators import changes as ch

AT = "2024-05-01 10:00:00"


def test_update_takes_the_last_of_a_repeated_key(spark):
    table = spark.createDataFrame([(1, 5), (2, 6)], "k long, v long")
    new = spark.createDataFrame([(1, 8, 2), (1, 9, 1), (3, 1, 1)], "k long, v long, seq long")
    assert rows(ch.update_by_key(table, new, ["k"], ["v"], "seq")) == [(1, 8), (2, 6)]
    # without an order the larger one, never two rows
    assert rows(ch.update_by_key(table, new.drop("seq"), ["k"], ["v"])) == [(1, 9), (2, 6)]


def test_patches_of_one_key_fold_in_sequence(spark):
    table = spark.createDataFrame([(1, "a", "b")], "k long, x string, y string")
    patch = spark.createDataFrame([(1, "c", None, 1), (1, None, "d", 2), (1, "e", None, 3), (1, "f", None, 0)],
                                  "k long, x string, y string, seq long")
    assert rows(ch.patch_rows(table, patch, "k", None, None, "seq")) == [(1, "e", "d")]


def test_resent_confirmation_keeps_one_line(spark):
    pos = spark.createDataFrame([(1, "pending-supplier", None)],
                                "purchase_order long, status string, modified timestamp_ntz")
    lines = spark.createDataFrame([(1, 1, 4, 3, None)], "purchase_order long, line long, album_id long, "
                                  "quantity long, confirmed_quantity long")
    for early, late in ((2, 3), (3, 2)):
        sent = spark.createDataFrame([(1, 1, late, "2024-05-02 00:00:00"), (1, 1, early, "2024-05-01 00:00:00")],
                                     "purchase_order long, line long, confirmed long, modified string")
        new_lines, new_pos = ch.apply_confirmations(pos, lines, sent)
        assert rows(new_lines.select("line", "confirmed_quantity")) == [(1, late)]
        assert rows(new_pos.select("status")) == [("confirmed" if late == 3 else "pending-buyer",)]


def test_update_before_its_note_changes_nothing(spark):
    dispatches = spark.createDataFrame([("d0", 1, "pending-supplier", "x")],
                                       "dispatch_id string, purchase_order long, status string, address string")
    pos = spark.createDataFrame([(1, None, None), (2, None, None)],
                                "purchase_order long, estimated_receipt timestamp_ntz, modified timestamp_ntz")
    msgs = spark.createDataFrame(
        [(1, "update", "d1", None, "shipped", None, None), (2, "note", "d1", 2, "pending-supplier", "y", None),
         (3, "update", "d0", None, "rescheduled", None, "2024-06-01 00:00:00"),
         (1, "update", "d1", None, "rescheduled", None, "2024-07-01 00:00:00")],
        "seq long, kind string, dispatch_id string, purchase_order long, status string, address string, "
        "estimated_delivery string").withColumn("estimated_delivery", ch.F.to_timestamp_ntz("estimated_delivery"))
    d, p = ch.apply_dispatch_updates(dispatches, pos, msgs, AT)
    assert rows(d.select("dispatch_id", "status")) == [("d0", "rescheduled"), ("d1", "pending-supplier")]
    moved = {r["purchase_order"]: r["estimated_receipt"] for r in p.collect()}
    assert str(moved[1]) == "2024-06-01 00:00:00" and moved[2] is None
    later = msgs.withColumn("seq", ch.F.when(ch.F.col("kind") == "note", 0).otherwise(ch.F.col("seq")))
    d, _ = ch.apply_dispatch_updates(dispatches, pos, later.where("status != 'rescheduled'"), AT)
    assert rows(d.select("dispatch_id", "status")) == [("d0", "pending-supplier"), ("d1", "shipped")]


def test_receipt_asked_twice_is_one_receipt(spark, shop_small):
    s = shop_small
    once = ch.receive_dispatches(s.dispatches, s.albums, s.purchase_orders, s.purchase_order_lines,
                                 s.receipt_requests)
    twice = ch.receive_dispatches(s.dispatches, s.albums, s.purchase_orders, s.purchase_order_lines,
                                  s.receipt_requests.unionByName(s.receipt_requests))
    for a, b in zip(once, twice, strict=True):
        assert rows(a) == rows(b)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_restarted_driver_reads_the_newest_complete_version(spark, tmp_path):
    from groovehouse.streaming.streams import BucketedState
    start = spark.createDataFrame([(k, 1) for k in range(50)], "x long, n long")

    def state():
        return BucketedState(spark, str(tmp_path / "s"), start, ["x"], buckets=8)

    def merge(old, batch):
        return old.unionByName(batch).groupBy("x").agg(ch.F.sum("n").alias("n"))

    first = state()
    assert first.last == -1 and first.latest().count() == 50
    batch = spark.createDataFrame([(3, 5), (99, 7)], "x long, n long")
    first.update(0, batch, merge)
    want = {k: 1 for k in range(50)} | {3: 6, 99: 7}
    assert dict(rows(state().latest())) == want
    state().update(0, batch, merge)  # the batch again, as after a lost driver
    assert dict(rows(state().latest())) == want
    # Only the buckets of the two keys were written; the others keep their files.
    assert sorted(set(state().manifest(0).values())) == [-1, 0]
    assert sum(v == 0 for v in state().manifest(0).values()) <= 2


def test_order_edit_sets_freight_and_receipt_date(spark):
    pos = spark.createDataFrame(
        [(1, "pending-buyer", "2024-01-01", 1.0, "2024-02-01"), (2, "pending-buyer", "2024-01-01", 1.0, None),
         (3, "confirmed", "2024-01-01", 1.0, None)],
        "purchase_order long, status string, modified string, shipping_cost double, estimated_receipt string")
    for c in ("modified", "estimated_receipt"):
        pos = pos.withColumn(c, ch.F.to_timestamp_ntz(c))
    lines = spark.createDataFrame([(k, 1, 4, 3, None, 1.0) for k in (1, 2, 3)], "purchase_order long, line long, "
                                  "album_id long, quantity long, confirmed_quantity long, line_total double")
    headers = spark.createDataFrame([(1, 9.0, "2024-03-01"), (2, 1.0, None), (3, 9.0, None)],
                                    "purchase_order long, shipping_cost double, estimated_receipt string") \
        .withColumn("estimated_receipt", ch.F.to_timestamp_ntz("estimated_receipt"))
    # The header counts only together with a changed line: order 1 has one.
    edited = lines.drop("confirmed_quantity").withColumn(
        "quantity", ch.F.when(ch.F.col("purchase_order") == 2, ch.F.col("quantity")).otherwise(7))
    headers = headers.withColumn("shipping_cost", ch.F.lit(9.0))
    got = {r["purchase_order"]: r for r in ch.merge_lines(lines, pos, edited, AT, headers)[1].collect()}
    assert (got[1]["status"], got[1]["shipping_cost"], str(got[1]["estimated_receipt"])[:10]) == (
        "pending-supplier", 9.0, "2024-03-01")
    assert got[2]["status"] == "pending-buyer" and got[2]["shipping_cost"] == 1.0
    assert got[3]["status"] == "confirmed" and got[3]["shipping_cost"] == 1.0


def test_album_edit_by_title_only_applies_and_stamps(spark):
    albums = spark.createDataFrame(
        [(1, "a", 2000, 1.0, 5, "p"), (2, "b", 2000, 1.0, 5, "p"), (3, "c", 2000, 1.0, 5, "p")],
        "album_id long, title string, release_year long, price double, artist_id long, photo string"
    ).withColumn("modified", ch.F.to_timestamp_ntz(ch.F.lit("2020-01-01")))
    songs = spark.createDataFrame([(k, 1, 10, "s") for k in (1, 2, 3)],
                                  "album_id long, track long, duration long, song string")
    forms = albums.withColumn("title", ch.F.when(ch.F.col("album_id") == 1, "new").otherwise(ch.F.col("title")))
    new = songs.withColumn("song", ch.F.when(ch.F.col("album_id") == 2, "t").otherwise(ch.F.col("song")))
    left, got = ch.merge_songs(songs, albums, new, AT, forms)
    found = {r["album_id"]: (r["title"], str(r["modified"])[:4]) for r in got.collect()}
    year = AT[:4]
    assert found == {1: ("new", year), 2: ("b", year), 3: ("c", "2020")}
    assert {r["album_id"]: r["song"] for r in left.collect()} == {1: "s", 2: "t", 3: "s"}
