"""Hot keys derived from the given tables: results stay exact."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from groovehouse.operators import catalogue as cat
from groovehouse.operators import changes as ch
from groovehouse.operators.folds import fold_draft_quantities


def _hot_events(s):
    """Every third cart event moved onto user 0 / album 0 (a third of rows)."""
    hot = F.col("event_id") % 3 == 0
    return s.cart_events.select(
        "event_id", "ts",
        F.when(hot, F.lit(0)).otherwise(F.col("user_id")).cast("bigint").alias("user_id"),
        F.when(hot, F.lit(0)).otherwise(F.col("album_id")).cast("bigint").alias("album_id"),
        "delta")


def test_cart_ledger_exact_with_a_hot_pair(spark, shop_mid):
    ev = _hot_events(shop_mid)
    got = rows(ch.fold_cart(shop_mid.cart.filter(F.lit(False)), ev))
    w = (Window.partitionBy("user_id", "album_id").orderBy("ts", "event_id")
         .rowsBetween(Window.unboundedPreceding, 0))
    want = (ev.withColumn("run", F.sum("delta").over(w))
            .groupBy("user_id", "album_id")
            .agg((F.sum("delta") - F.least(F.lit(0), F.min("run"))).alias("quantity"))
            .filter("quantity > 0"))
    assert got == rows(want)


def test_draft_fold_exact_with_a_hot_order(spark, shop_mid):
    s = shop_mid
    ev = _hot_events(s).withColumnRenamed("user_id", "purchase_order")
    small = {(r.purchase_order, r.album_id): r.quantity for r in
             fold_draft_quantities(s.purchase_order_lines, s.albums, ev).collect()}
    split = {(r.purchase_order, r.album_id): r.quantity for r in
             fold_draft_quantities(s.purchase_order_lines, s.albums, ev, partitions=31)
             .collect()}
    assert small == split


def test_documents_exact_with_a_hot_artist(spark, shop_mid):
    s = shop_mid
    albums = s.albums.withColumn("artist_id", F.lit(0).cast("bigint"))   # one artist
    doc = cat.artist_with_albums(s.artists, albums)
    assert doc.filter("artist_id = 0").select(F.size("albums")).first()[0] == albums.count()


def test_cart_ledger_burst_cut_by_buckets(spark, shop_mid):
    """All of a hot pair's events inside one hour, cut into about 30 of 100 buckets."""
    from groovehouse.operators.folds import clamped_ledger
    ev = _hot_events(shop_mid).withColumn(
        "ts", F.when((F.col("user_id") == 0) & (F.col("album_id") == 0),
                     F.lit("2024-03-01 10:00:00").cast("timestamp_ntz")
                     + F.make_dt_interval(secs=(F.col("event_id") % 3000) / 1000))
        .otherwise(F.col("ts")))
    start = shop_mid.cart
    got = rows(clamped_ledger(start, ev, ["user_id", "album_id"], partitions=100)
               .filter("quantity > 0"))
    want = rows(clamped_ledger(start, ev, ["user_id", "album_id"], partitions=1)
                .filter("quantity > 0"))
    assert got == want
    w = (Window.partitionBy("user_id", "album_id")
         .orderBy(F.col("ts").asc_nulls_first(), F.col("event_id").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, 0))
    allev = (start.select("user_id", "album_id", F.lit(None).cast("timestamp_ntz").alias("ts"),
                          F.lit(None).cast("bigint").alias("event_id"),
                          F.col("quantity").alias("delta"))
             .unionByName(ev.select("user_id", "album_id", "ts", "event_id", "delta")))
    plain = (allev.withColumn("run", F.sum("delta").over(w)).groupBy("user_id", "album_id")
             .agg((F.sum("delta") - F.least(F.lit(0), F.min("run"))).alias("quantity"))
             .filter("quantity > 0"))
    assert got == rows(plain)
