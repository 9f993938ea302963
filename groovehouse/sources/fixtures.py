"""Reference-shaped views over the driver's synthetic tables (FIXTURES.md).

Every view here has a twin in ``groovehouse.plans.fixture_sql`` written for
DuckDB with the same formulas; the oracle queries are built on those twins.
All views are lazy DataFrames; nothing is collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COST, LINE_TOTAL, PRICE

# Derived tables materialised once per (application, folder, table).
_MATERIALISED: dict[tuple[str, str, str], DataFrame] = {}

# Fixed values of the fixture definitions.
DAY0 = "2024-01-01 00:00:00"
PATCH_AT = "2024-06-01 00:00:00"
EXT_ID_OFFSET = 1_000_000


def day0_plus(days: Column) -> Column:
    return F.lit(DAY0).cast("timestamp_ntz") + F.make_dt_interval(days=days.cast("int"))


def plus_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(days=F.lit(days))


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cart_events_of(events: DataFrame) -> DataFrame:
    """Cart events from the raw events, batch or stream."""
    return events.filter(F.col("event_type").isin("click", "view", "error")).select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("album_id"),
        F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.lit(1))
        .cast("bigint").alias("delta"))


def dispatch_messages_of(orders: DataFrame) -> DataFrame:
    """D-19 messages from the raw orders, batch or stream: a note for a third of the
    pending-buyer orders, a ``shipped`` update per dispatch, ``rescheduled`` for every
    fourth.  Each order row gives its own messages."""
    k, day = F.col("o_orderkey").cast("bigint"), F.col("o_orderdate").cast("timestamp_ntz")
    none = {"purchase_order": F.lit(None).cast("bigint"), "address": F.lit(None).cast("string"),
            "estimated_delivery": F.lit(None).cast("timestamp_ntz")}

    def message(seq, kind, prefix, status, **given):
        fields = {**none, **given}
        return F.struct((k * 3 + seq).alias("seq"), F.lit(kind).alias("kind"),
                        F.concat(F.lit(prefix), k.cast("string")).alias("dispatch_id"),
                        fields["purchase_order"].alias("purchase_order"), F.lit(status).alias("status"),
                        fields["address"].alias("address"), fields["estimated_delivery"].alias("estimated_delivery"))

    noted = (F.col("o_orderstatus") == "P") & (k % 3 == 0)
    sent = F.col("o_orderstatus") == "F"
    note = message(0, "note", "n-", "pending-supplier", purchase_order=k,
                   address=F.concat(F.lit("dock "), (k % 7).cast("string")))
    shipped = message(1, "update", "d-", "shipped", estimated_delivery=plus_days(day, 20))
    moved = message(2, "update", "d-", "rescheduled", estimated_delivery=plus_days(day, 27))
    return orders.select(F.inline(F.array_compact(F.array(
        F.when(noted, note), F.when(sent, shipped), F.when(sent & (k % 4 == 0), moved)))))


class Shop:
    """The ten shop tables plus change/message inputs, derived lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return read_raw(self.spark, self.sf_dir, name)

    # ---- the ten tables -------------------------------------------------
    @cached_property
    def artists(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            F.col("s_suppkey").cast("bigint").alias("artist_id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("bio"),
            day0_plus(F.col("s_suppkey") % 50).alias("modified"),
        )

    @cached_property
    def albums(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        return p.select(
            k.cast("bigint").alias("album_id"),
            F.col("p_name").alias("title"),
            (F.lit(1970) + F.col("p_size")).cast("bigint").alias("release_year"),
            (F.col("p_size") % 11).cast("bigint").alias("stock"),
            F.col("p_retailprice").cast(PRICE).alias("price"),
            F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit(".jpg"))
            .alias("photo"),
            F.when(k % 41 == 40, F.lit(None)).otherwise(k % 41).cast("bigint")
            .alias("artist_id"),
            day0_plus(k % 365).alias("modified"),
        )

    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").cast("bigint").alias("user_id"),
            F.when(F.col("c_custkey") % 100 == 0, F.lit("admin")).otherwise(F.lit("user"))
            .alias("role"),
            F.col("c_name").alias("username"),
            day0_plus(F.col("c_custkey") % 365).alias("created"),
        )

    @cached_property
    def orders_h(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").cast("bigint").alias("order_id"),
            F.col("o_custkey").cast("bigint").alias("user_id"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("dispatched"),
        )

    @cached_property
    def orders_bridge(self) -> DataFrame:
        li = self.raw("lineitem")
        return (li.groupBy(F.col("l_orderkey").alias("order_id"),
                           F.col("l_partkey").alias("album_id"))
                .agg(F.sum("l_quantity").cast("bigint").alias("quantity")))

    @cached_property
    def cart_events(self) -> DataFrame:
        return cart_events_of(self.raw("events"))

    @cached_property
    def cart(self) -> DataFrame:
        return (self.cart_events.groupBy("user_id", "album_id")
                .agg(F.sum("delta").alias("quantity"))
                .filter(F.col("quantity") > 0))

    @cached_property
    def purchase_orders(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        d = F.col("o_orderdate").cast("timestamp_ntz")
        return o.select(
            k.cast("bigint").alias("purchase_order"),
            F.when(F.col("o_orderstatus") == "F", "confirmed")
            .when(F.col("o_orderstatus") == "O", "pending-supplier")
            .when(F.col("o_orderstatus") == "P", "pending-buyer").alias("status"),
            d.alias("modified"),
            ((k % 5000) / F.lit(100.0)).cast(COST).alias("shipping_cost"),
            F.when(k % 50 == 0, F.lit(None)).otherwise(plus_days(d, 14))
            .alias("estimated_receipt"),
        )

    @cached_property
    def purchase_order_lines(self) -> DataFrame:
        """Lines numbered 1..n per order (skew-safe numbering, not a window
        per order).  The numbered table stands for a stored table: it is
        written once per session and folder as Parquet in the checkpoint
        folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "purchase_order_lines")
        if key not in _MATERIALISED:
            _MATERIALISED[key] = self._number_lines()
        return _MATERIALISED[key]

    def _number_lines(self) -> DataFrame:
        from ..operators.positions import rank_within
        li = self.raw("lineitem")
        # Shuffled: the sort columns, which give the others, and one the flags decide.
        q = F.col("l_quantity").cast("bigint")
        base = li.select(
            F.col("l_orderkey").cast("bigint").alias("purchase_order"),
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_shipdate",
            F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), None)
            .when(F.col("l_returnflag") == "R", q - 1).otherwise(q)
            .alias("confirmed_quantity"))
        order = [F.col(c).asc() for c in ("l_linenumber", "l_partkey", "l_suppkey",
                                          "l_quantity", "l_extendedprice", "l_shipdate")]
        ranked = rank_within(base, ["purchase_order"], order, "line")
        # Written as a Parquet table in the shared folder: later scans prune
        # columns and push filters, which an RDD checkpoint would not allow.
        from ..schemas import SCHEMAS
        from ..streaming.streams import scratch_root
        path = f"{scratch_root(self.spark, 'tables')}/purchase_order_lines"
        cols = [f.name for f in SCHEMAS["purchase_order_lines"].fields]
        lines = ranked.withColumns({"album_id": F.col("l_partkey").cast("bigint"), "quantity": q,
                                    "line_total": F.col("l_extendedprice").cast(LINE_TOTAL)})
        lines.select(*cols).write.parquet(path)
        return self.spark.read.schema(SCHEMAS["purchase_order_lines"]).parquet(path)

    @cached_property
    def dispatches(self) -> DataFrame:
        o = self.raw("orders").filter(F.col("o_orderstatus") == "F")
        p = F.substring("o_orderpriority", 1, 1)
        return o.select(
            F.concat(F.lit("d-"), F.col("o_orderkey").cast("string")).alias("dispatch_id"),
            F.col("o_orderkey").cast("bigint").alias("purchase_order"),
            F.when(p == "1", "received").when(p == "2", "shipped")
            .when(p == "3", "rescheduled").otherwise("pending-supplier").alias("status"),
            F.concat(F.lit("dock "), (F.col("o_orderkey") % 7).cast("string")).alias("address"),
        )

    @cached_property
    def songs(self) -> DataFrame:
        c = self.raw("conversations")
        return c.select(
            F.col("conv_id").cast("bigint").alias("album_id"),
            (F.col("turn") + 1).cast("bigint").alias("track"),
            F.when(F.col("turn") == 7, F.lit(None)).otherwise(F.length("text"))
            .cast("bigint").alias("duration"),
            F.col("text").alias("song"),
        )

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in (
            "albums", "artists", "cart", "dispatches", "orders_h", "orders_bridge",
            "purchase_order_lines", "purchase_orders", "songs", "users")}

    def loaded_tables(self) -> dict[str, DataFrame]:
        """The ten tables as a load with faults gives them (input of the audits):
        all their rows, and rows with missing or repeated keys, missing parents,
        values outside their lists and usernames that are taken."""
        def more(table: DataFrame, where: str, **changed: str) -> DataFrame:
            return table.where(where).withColumns({c: F.expr(e).cast(table.schema[c].dataType)
                                                   for c, e in changed.items()})

        t = self.tables()
        faults = {
            "albums": [("album_id % 60 = 11", {"album_id": "null"}), ("album_id % 50 = 7", {}),
                       ("album_id % 40 = 3", {"album_id": "album_id + 10000000", "stock": "-1 - stock",
                                              "artist_id": "artist_id + 1000000"})],
            "users": [("user_id % 30 = 1", {"user_id": "user_id + 10000000", "role": "'owner'"})],
            "cart": [("user_id % 20 = 2", {"user_id": "user_id + 20000000"}), ("album_id % 30 = 4", {})],
            "purchase_orders": [("purchase_order % 70 = 0",
                                 {"purchase_order": "purchase_order + 10000000", "status": "'lost'"})],
            "dispatches": [("purchase_order % 25 = 0",
                            {"dispatch_id": "concat(dispatch_id, '-x')", "status": "'gone'",
                             "purchase_order": "purchase_order + 30000000"})],
            "songs": [("album_id % 45 = 0", {"album_id": "album_id + 30000000"})],
        }
        for name, added in faults.items():
            rows = t[name]
            for where, changed in added:
                rows = rows.unionByName(more(t[name], where, **changed))
            t[name] = rows
        return t

    @cached_property
    def order_headers(self) -> DataFrame:
        """D-16: an edited header for every order: dearer freight, a later receipt."""
        return self.purchase_orders.select(
            "purchase_order", (F.col("shipping_cost") + F.lit("1.50").cast(COST)).cast(COST).alias("shipping_cost"),
            plus_days(F.col("estimated_receipt"), 7).alias("estimated_receipt"))

    # ---- change and message inputs --------------------------------------
    @cached_property
    def new_lines(self) -> DataFrame:
        """D-16 / W-2: edited lines: line 2 dropped, line 1 +1, line 99 added
        to every pending-buyer order."""
        pol = self.purchase_order_lines
        kept = (pol.filter(F.col("line") != 2)
                .withColumn("quantity", F.when(F.col("line") == 1, F.col("quantity") + 1)
                            .otherwise(F.col("quantity"))))
        n_parts = self.raw("part").agg(F.count(F.lit(1))).scalar()
        added = (self.purchase_orders.filter(F.col("status") == "pending-buyer")
                 .select("purchase_order", F.lit(99).cast("bigint").alias("line"),
                         (F.col("purchase_order") % n_parts).cast("bigint")
                         .alias("album_id"),
                         F.lit(1).cast("bigint").alias("quantity"),
                         F.lit(None).cast("bigint").alias("confirmed_quantity"),
                         F.lit(10).cast(LINE_TOTAL).alias("line_total")))
        return kept.unionByName(added)

    @cached_property
    def new_songs(self) -> DataFrame:
        """D-17: track 3 dropped, track 1 renamed, track 20 on even albums."""
        s = self.songs
        kept = (s.filter(F.col("track") != 3)
                .withColumn("song", F.when(F.col("track") == 1,
                                           F.concat(F.col("song"), F.lit(" (live)")))
                            .otherwise(F.col("song"))))
        bonus = (s.filter(F.col("album_id") % 2 == 0).select("album_id").distinct()
                 .select("album_id", F.lit(20).cast("bigint").alias("track"),
                         F.lit(200).cast("bigint").alias("duration"),
                         F.lit("bonus track").alias("song")))
        return kept.unionByName(bonus)

    @cached_property
    def artist_patch(self) -> DataFrame:
        a = self.artists.filter(F.col("artist_id") % 3 == 0)
        turn = (F.col("artist_id") / 3).cast("bigint") % 2
        return a.select(
            "artist_id",
            F.when(turn == 0, F.upper("name")).alias("name"),
            F.when(turn == 1, F.concat("bio", F.lit(" (rev)"))).alias("bio"))

    @cached_property
    def album_patch(self) -> DataFrame:
        a = self.albums.filter(F.col("album_id") % 3 == 0)
        turn = (F.col("album_id") / 3).cast("bigint") % 5
        return a.select(
            "album_id",
            F.when(turn == 0, F.upper("title")).alias("title"),
            F.when(turn == 1, F.col("release_year") + 1).alias("release_year"),
            F.when(turn == 2, (F.col("price") + F.lit(1)).cast(PRICE)).alias("price"),
            F.when(turn == 3, (F.col("artist_id") + 1) % 40).alias("artist_id"),
            F.when(turn == 4, F.concat(F.lit("new-"), F.col("photo"))).alias("photo"))

    @cached_property
    def confirmation_rows(self) -> DataFrame:
        """D-18 flat form: supplier's confirmed quantity per line of every
        pending-supplier order (short by one on every third line)."""
        pol = self.purchase_order_lines
        pend = self.purchase_orders.filter(F.col("status") == "pending-supplier")
        return (pol.join(pend.select("purchase_order"), "purchase_order", "left_semi")
                .select("purchase_order", "line", "album_id",
                        (F.col("quantity") - F.when(F.col("line") % 3 == 0, 1).otherwise(0))
                        .alias("confirmed")))

    @cached_property
    def confirmations(self) -> DataFrame:
        """D-18 message form: one JSON text per order (SRC-4 input)."""
        from ..operators.nesting import nest_children
        rows = self.confirmation_rows
        return (nest_children(rows, ["purchase_order"],
                              F.struct("line", "confirmed", "album_id"), "lines")
                .select(F.to_json(F.struct(
                    F.lit("supplier-1").alias("client_id"),
                    F.col("purchase_order").alias("purchase_order_id"),
                    F.lit("confirmed").alias("status"),
                    F.lit(PATCH_AT).alias("modified"),
                    F.col("lines"))).alias("payload")))

    @cached_property
    def dispatch_msgs(self) -> DataFrame:
        """D-19 messages (``dispatch_messages_of``)."""
        return dispatch_messages_of(self.raw("orders"))

    @cached_property
    def draft_events(self) -> DataFrame:
        return self.cart_events.select("event_id", "ts",
                                       F.col("user_id").alias("purchase_order"),
                                       "album_id", "delta")

    @cached_property
    def receipt_requests(self) -> DataFrame:
        return self.dispatches.filter(F.col("purchase_order") % 2 == 0).select("dispatch_id")

    @cached_property
    def checkout_requests(self) -> DataFrame:
        return self.users.filter(F.col("user_id") % 2 == 0).select("user_id")

    @cached_property
    def ext_albums(self) -> DataFrame:
        """J-15 outside catalogue: every third album, upper-cased, under a new
        id; every sixth album listed twice."""
        a = (self.albums.filter(F.col("album_id") % 3 == 0)
             .join(self.artists.select("artist_id", "name"), "artist_id", "left"))
        one = a.select((F.col("album_id") + EXT_ID_OFFSET).alias("ext_album_id"),
                       F.col("album_id").alias("src_album_id"),
                       F.upper("title").alias("title"), F.upper("name").alias("artist"))
        two = (a.filter(F.col("album_id") % 6 == 0)
               .select((F.col("album_id") + 2 * EXT_ID_OFFSET).alias("ext_album_id"),
                       F.col("album_id").alias("src_album_id"),
                       F.upper("title").alias("title"), F.upper("name").alias("artist")))
        return one.unionByName(two)

    @cached_property
    def ext_tracks(self) -> DataFrame:
        e = self.ext_albums.select("ext_album_id", "src_album_id")
        s = self.songs.select(F.col("album_id").alias("src_album_id"), "track")
        return (e.join(s, "src_album_id")
                .select("ext_album_id", F.col("track").alias("position"),
                        F.concat(F.lit("p-"), F.col("ext_album_id").cast("string"),
                                 F.lit("-"), F.col("track").cast("string")).alias("preview")))

    @cached_property
    def form_fields(self) -> DataFrame:
        """SRC-2 input: (form_id, key, value) pairs, values padded with blanks."""
        # Artists meet the albums, not the lines: few artists hold many lines.
        named = self.albums.select("album_id", "artist_id", "title").join(
            self.artists.select("artist_id", "name"), "artist_id", "left")
        pol = self.purchase_order_lines.join(named, "album_id", "left")
        pad = lambda c: F.concat(F.lit(" "), c.cast("string"), F.lit(" "))
        fid = F.concat(F.lit("po-"), F.col("purchase_order").cast("string"))
        n = F.col("line").cast("string")
        lines = pol.select(fid.alias("form_id"), F.explode(F.array(
            F.struct(F.concat(F.lit("artist_id_"), n).alias("key"),
                     pad(F.col("artist_id")).alias("value")),
            F.struct(F.concat(F.lit("name_"), n).alias("key"),
                     pad(F.col("name")).alias("value")),
            F.struct(F.concat(F.lit("title_"), n).alias("key"),
                     pad(F.col("title")).alias("value")),
            F.struct(F.concat(F.lit("album_id_"), n).alias("key"),
                     pad(F.col("album_id")).alias("value")),
            F.struct(F.concat(F.lit("quantity_"), n).alias("key"),
                     pad(F.col("quantity")).alias("value")),
            F.struct(F.concat(F.lit("line_total_"), n).alias("key"),
                     pad(F.col("line_total")).alias("value")))).alias("kv"))
        s = self.songs
        sid = F.concat(F.lit("album-"), F.col("album_id").cast("string"))
        t = F.col("track").cast("string")
        dur = F.when(F.col("duration").isNull(), F.lit(" ")).otherwise(
            pad(F.format_string("%d:%02d", (F.col("duration") / 60).cast("bigint"),
                                F.col("duration") % 60)))
        songs = s.select(sid.alias("form_id"), F.explode(F.array(
            F.struct(F.concat(F.lit("track_"), t).alias("key"),
                     pad(F.col("track")).alias("value")),
            F.struct(F.concat(F.lit("song_"), t).alias("key"),
                     pad(F.col("song")).alias("value")),
            F.struct(F.concat(F.lit("duration_"), t).alias("key"), dur.alias("value"))))
            .alias("kv"))
        return lines.unionByName(songs).select("form_id", "kv.key", "kv.value")

    @cached_property
    def array_rows(self) -> DataFrame:
        """SRC-3 input: songs per album as parallel arrays; the durations
        array is one shorter for odd albums."""
        from ..operators.changes import rows_to_arrays
        arr = rows_to_arrays(self.songs, ["album_id"],
                             ["track", "duration", "song"], "track")
        return arr.withColumn(
            "duration",
            F.when(F.col("album_id") % 2 == 1,
                   F.slice("duration", 1, F.greatest(F.size("duration") - 1, F.lit(0))))
            .otherwise(F.col("duration")))

    @cached_property
    def allow_list(self) -> DataFrame:
        """SRC-6 input: all users, one text row ``user:role,...`` for every
        hundred ids."""
        hundred = (F.col("user_id") / 100).cast("bigint").alias("_hundred")
        return self.users.groupBy(hundred).agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("user_id", "username", "role"))),
            lambda x: F.concat(x["username"], F.lit(":"), x["role"])), ",").alias("allow")
            ).select("allow")
