"""Change queries: D-1..23, J-9, J-11..14, J-16, A-16, PF-9, SRC-3, SRC-5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import money, ts_text
from ..operators import changes as ch
from ..sources.fixtures import PATCH_AT
from .registry import register

TS = "'%Y-%m-%d %H:%M:%S'"
AT = f"TIMESTAMP '{PATCH_AT}'"


def _money(c: str) -> str:
    return f"CAST(round({c}, 2) AS DOUBLE)"


# ---- cart ledger and stock --------------------------------------------------

@register("fold_cart", """
WITH r AS (SELECT user_id, album_id, delta,
                  sum(delta) OVER (PARTITION BY user_id, album_id ORDER BY ts, event_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
           FROM cart_events)
SELECT user_id, album_id, CAST(sum(delta) - least(0, min(run)) AS BIGINT) AS quantity
FROM r GROUP BY user_id, album_id HAVING sum(delta) - least(0, min(run)) > 0""")
def fold_cart(s):
    empty_start = s.cart.filter(F.lit(False))
    return ch.fold_cart(empty_start, s.cart_events)


@register("fold_cart_on_snapshot", """
WITH ev AS (SELECT user_id, album_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS event_id,
                   quantity AS delta FROM cart
            UNION ALL
            SELECT user_id, album_id, ts, event_id, delta FROM cart_events
            WHERE ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM cart_events)),
r AS (SELECT user_id, album_id, delta,
             sum(delta) OVER (PARTITION BY user_id, album_id
                              ORDER BY ts NULLS FIRST, event_id NULLS FIRST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ev)
SELECT user_id, album_id, CAST(sum(delta) - least(0, min(run)) AS BIGINT) AS quantity
FROM r GROUP BY user_id, album_id HAVING sum(delta) - least(0, min(run)) > 0""")
def fold_cart_on_snapshot(s):
    ev = s.cart_events
    mid = ev.agg(F.min("ts") + (F.max("ts") - F.min("ts")) / 2).scalar()
    return ch.fold_cart(s.cart, ev.filter(F.col("ts") >= mid))


@register("upsert_add", """
SELECT user_id, album_id, CAST(sum(quantity) AS BIGINT) AS quantity FROM (
  SELECT user_id, album_id, quantity FROM cart
  UNION ALL SELECT DISTINCT user_id, album_id, CAST(1 AS BIGINT) FROM cart_events)
GROUP BY user_id, album_id""")
def upsert_add(s):
    delta = s.cart_events.select("user_id", "album_id").distinct() \
        .withColumn("quantity", F.lit(1).cast("bigint"))
    return ch.upsert_add(s.cart, delta, ["user_id", "album_id"], "quantity")


ADMIT = """
admit_ev AS (SELECT album_id, list({'u': user_id, 'd': delta, 'id': event_id}
                                   ORDER BY ts, event_id) AS es
             FROM cart_events GROUP BY album_id),
admit_hold AS (SELECT album_id, map_from_entries(list({'key': user_id, 'value': quantity})) AS h
               FROM cart GROUP BY album_id),
admit_run AS (
  SELECT ev.album_id, list_reduce(ev.es, lambda acc, e: {
      's': (acc.s + CASE WHEN (CASE WHEN e.d > 0 THEN acc.s > 0 ELSE coalesce(acc.h[e.u], 0) > 0 END) THEN -e.d ELSE 0 END),
      'h': map_concat(acc.h, MAP([e.u], [(coalesce(acc.h[e.u], 0) + CASE WHEN (CASE WHEN e.d > 0 THEN acc.s > 0 ELSE coalesce(acc.h[e.u], 0) > 0 END) THEN e.d ELSE 0 END)])),
      'out': list_append(acc.out, {'id': e.id, 'u': e.u, 'd': e.d, 'ok': (CASE WHEN e.d > 0 THEN acc.s > 0 ELSE coalesce(acc.h[e.u], 0) > 0 END),
                                    's': (acc.s + CASE WHEN (CASE WHEN e.d > 0 THEN acc.s > 0 ELSE coalesce(acc.h[e.u], 0) > 0 END) THEN -e.d ELSE 0 END), 'c': (coalesce(acc.h[e.u], 0) + CASE WHEN (CASE WHEN e.d > 0 THEN acc.s > 0 ELSE coalesce(acc.h[e.u], 0) > 0 END) THEN e.d ELSE 0 END)})},
      {'s': coalesce(a.stock, 0), 'h': coalesce(ho.h, MAP([]::BIGINT[], []::BIGINT[])),
       'out': []::STRUCT(id BIGINT, u BIGINT, d BIGINT, ok BOOLEAN, s BIGINT, c BIGINT)[]}) AS r
  FROM admit_ev ev LEFT JOIN albums a ON a.album_id = ev.album_id
  LEFT JOIN admit_hold ho ON ho.album_id = ev.album_id),
adm AS (SELECT o.id AS event_id, o.u AS user_id, album_id, o.d AS delta, o.ok AS accepted,
               o.s AS stock_after, o.c AS cart_after
        FROM admit_run, unnest(admit_run.r.out) AS t(o))"""


@register("admit_cart_events", f"WITH {ADMIT} SELECT * FROM adm")
def admit_cart_events(s):
    return ch.admit_cart_events(s.albums, s.cart, s.cart_events)


@register("move_stock", f"""
WITH {ADMIT}
SELECT a.album_id, CAST(a.stock - coalesce(m.taken, 0) AS BIGINT) AS stock
FROM albums a LEFT JOIN (SELECT album_id, sum(delta) AS taken FROM adm WHERE accepted
                         GROUP BY album_id) m ON m.album_id = a.album_id""")
def move_stock(s):
    adm = ch.admit_cart_events(s.albums, s.cart, s.cart_events)
    return ch.move_stock(s.albums, adm).select("album_id", "stock")


@register("cart_after_admission", f"""
WITH {ADMIT}
SELECT user_id, album_id, CAST(sum(quantity) AS BIGINT) AS quantity FROM (
  SELECT user_id, album_id, quantity FROM cart
  UNION ALL SELECT user_id, album_id, delta FROM adm WHERE accepted)
GROUP BY user_id, album_id HAVING sum(quantity) > 0""")
def cart_after_admission(s):
    adm = ch.admit_cart_events(s.albums, s.cart, s.cart_events)
    return ch.cart_after_admission(s.cart, adm)


@register("remove_cart_items", """
SELECT c.* FROM cart c
WHERE c.user_id NOT IN (SELECT user_id FROM users WHERE role = 'admin')
  AND c.quantity <> 1""")
def remove_cart_items(s):
    # Admins empty their whole cart; every single copy in a cart is taken out.
    whole = s.users.filter(F.col("role") == "admin").select(
        "user_id", F.lit(None).cast("bigint").alias("album_id"))
    one = s.cart.filter(F.col("quantity") == 1).select("user_id", "album_id")
    return ch.remove_cart_items(s.cart, whole.unionByName(one))


# ---- draft lines ------------------------------------------------------------

@register("draft_quantities", """
WITH st AS (SELECT purchase_order, album_id, sum(quantity) AS q FROM purchase_order_lines
            GROUP BY purchase_order, album_id),
ev AS (SELECT purchase_order, album_id,
              list(delta ORDER BY ts, event_id) AS ds FROM draft_events
       GROUP BY purchase_order, album_id),
g AS (SELECT coalesce(st.purchase_order, ev.purchase_order) AS purchase_order,
             coalesce(st.album_id, ev.album_id) AS album_id,
             CAST(coalesce(st.q, 0) AS BIGINT) AS q0, coalesce(ev.ds, []) AS ds
      FROM st FULL OUTER JOIN ev ON st.purchase_order = ev.purchase_order
                                AND st.album_id = ev.album_id)
SELECT g.purchase_order, g.album_id,
       CAST(list_reduce(g.ds, lambda acc, d:
            CASE WHEN d > 0 THEN (CASE WHEN acc = 0 THEN 1
                                       WHEN acc + 1 <= 10 - a.stock THEN acc + 1 ELSE acc END)
                 ELSE greatest(acc - 1, 0) END, g.q0) AS BIGINT) AS quantity
FROM g JOIN albums a ON a.album_id = g.album_id
WHERE list_reduce(g.ds, lambda acc, d:
            CASE WHEN d > 0 THEN (CASE WHEN acc = 0 THEN 1
                                       WHEN acc + 1 <= 10 - a.stock THEN acc + 1 ELSE acc END)
                 ELSE greatest(acc - 1, 0) END, g.q0) > 0""")
def draft_quantities(s):
    from ..operators.folds import fold_draft_quantities
    return fold_draft_quantities(s.purchase_order_lines, s.albums, s.draft_events) \
        .select("purchase_order", "album_id", "quantity")


@register("fold_draft_lines", f"""
WITH st AS (SELECT purchase_order, album_id, sum(quantity) AS q, min(line) AS first_line
            FROM purchase_order_lines GROUP BY purchase_order, album_id),
ev AS (SELECT purchase_order, album_id,
              list({{'d': delta, 'id': event_id}} ORDER BY ts, event_id) AS es
       FROM draft_events GROUP BY purchase_order, album_id),
g AS (SELECT ev.purchase_order, ev.album_id,
             {{'x': CAST(coalesce(st.q, 0) AS BIGINT), 'be': false,
              'b': CAST(st.first_line AS BIGINT)}} AS s0,
             ev.es
      FROM ev LEFT JOIN st ON st.purchase_order = ev.purchase_order
                                AND st.album_id = ev.album_id),
f AS (SELECT g.purchase_order, g.album_id, a.price,
             list_reduce(g.es, lambda acc, e:
                 CASE WHEN e.d > 0 AND acc.x = 0 THEN {{'x': CAST(1 AS BIGINT), 'be': true, 'b': e.id}}
                      WHEN e.d > 0 AND acc.x + 1 <= 10 - a.stock
                           THEN {{'x': acc.x + 1, 'be': acc.be, 'b': acc.b}}
                      WHEN e.d > 0 THEN acc
                      ELSE {{'x': greatest(acc.x - 1, 0), 'be': acc.be, 'b': acc.b}} END,
                 g.s0) AS r
      FROM g JOIN albums a ON a.album_id = g.album_id),
kept AS (
  SELECT purchase_order, album_id, r.x AS quantity, r.be AS be, r.b AS b,
         CAST(round(round(price * r.x * CASE WHEN r.x <= 5 THEN 0.7 ELSE 0.6 END, 2), 2) AS DOUBLE)
         AS line_total
  FROM f WHERE r.x > 0
  UNION ALL
  SELECT purchase_order, album_id, quantity, false, line, {_money('line_total')}
  FROM purchase_order_lines l WHERE NOT EXISTS (
    SELECT 1 FROM draft_events e
    WHERE e.purchase_order = l.purchase_order AND e.album_id = l.album_id))
SELECT purchase_order,
       CAST(CASE WHEN purchase_order IN (SELECT purchase_order FROM draft_events)
            THEN row_number() OVER (PARTITION BY purchase_order ORDER BY be, b, album_id) ELSE b END
            AS BIGINT) AS line,
       album_id, CAST(quantity AS BIGINT) AS quantity, line_total
FROM kept""")
def fold_draft_lines(s):
    out = ch.fold_draft_lines(s.purchase_order_lines, s.albums, s.draft_events)
    return out.withColumn("line_total", money("line_total"))


# ---- appends, ids, arrays ---------------------------------------------------

@register("append_rows", f"""
SELECT artist_id, name, bio, strftime(modified, {TS}) AS modified FROM artists
UNION ALL
SELECT CAST((SELECT max(artist_id) FROM artists)
            + row_number() OVER (ORDER BY username, user_id) AS BIGINT),
       username, 'no biography yet', strftime({AT}, {TS})
FROM users""")
def append_rows(s):
    new = s.users.select(
        F.col("username").alias("name"), "user_id")
    with_ids = ch.assign_ids(new, s.artists, "artist_id",
                             [F.col("name").asc(), F.col("user_id").asc()])
    out = ch.append_rows(s.artists, with_ids.drop("user_id"),
                         {"bio": F.lit("no biography yet"),
                          "modified": F.lit(PATCH_AT).cast("timestamp_ntz")})
    return out.withColumn("modified", ts_text("modified"))


@register("assign_ids", """
SELECT CAST((SELECT max(order_id) FROM orders_h)
            + row_number() OVER (ORDER BY e.ts, e.event_id) AS BIGINT) AS order_id,
       e.event_id, e.user_id
FROM cart_events e WHERE e.delta < 0""")
def assign_ids(s):
    new = s.cart_events.filter(F.col("delta") < 0).select("event_id", "user_id", "ts")
    return ch.assign_ids(new, s.orders_h, "order_id",
                         [F.col("ts").asc(), F.col("event_id").asc()]) \
        .select("order_id", "event_id", "user_id")


ARRAY_LAST = """(SELECT album_id, max(track) AS last FROM songs GROUP BY album_id)"""


@register("arrays_to_rows", f"""
SELECT s.album_id, s.track,
       CASE WHEN s.album_id % 2 = 1 AND s.track = l.last THEN NULL ELSE s.duration END AS duration,
       s.song
FROM songs s JOIN {ARRAY_LAST} l ON l.album_id = s.album_id""")
def arrays_to_rows(s):
    return ch.arrays_to_rows(s.array_rows, ["album_id"], ["track", "duration", "song"])


@register("rows_to_arrays", """
SELECT album_id, string_agg(CAST(track AS VARCHAR), ',' ORDER BY track) AS tracks,
       string_agg(coalesce(CAST(duration AS VARCHAR), '-'), ',' ORDER BY track) AS durations,
       string_agg(song, '|' ORDER BY track) AS songs
FROM songs GROUP BY album_id""")
def rows_to_arrays(s):
    a = ch.rows_to_arrays(s.songs, ["album_id"], ["track", "duration", "song"], "track")
    return a.select(
        "album_id", F.array_join(F.transform("track", lambda x: x.cast("string")), ",")
        .alias("tracks"),
        F.array_join(F.transform("duration", lambda x: F.coalesce(x.cast("string"),
                                                                  F.lit("-"))), ",")
        .alias("durations"),
        F.array_join("song", "|").alias("songs"))


# ---- updates and patches ----------------------------------------------------

@register("patch_rows", f"""
SELECT a.artist_id, coalesce(p.name, a.name) AS name, coalesce(p.bio, a.bio) AS bio,
       strftime(CASE WHEN p.artist_id IS NOT NULL THEN {AT} ELSE a.modified END, {TS})
       AS modified
FROM artists a LEFT JOIN artist_patch p ON p.artist_id = a.artist_id""")
def patch_rows(s):
    out = ch.patch_rows(s.artists, s.artist_patch, "artist_id", "modified", PATCH_AT)
    return out.withColumn("modified", ts_text("modified"))


PATCHED_ALBUMS = f"""(SELECT a.album_id, coalesce(p.title, a.title) AS title,
       coalesce(p.release_year, a.release_year) AS release_year, a.stock,
       coalesce(p.price, a.price) AS price, coalesce(p.photo, a.photo) AS photo,
       coalesce(p.artist_id, a.artist_id) AS artist_id,
       CASE WHEN p.album_id IS NOT NULL THEN {AT} ELSE a.modified END AS modified
FROM albums a LEFT JOIN album_patch p ON p.album_id = a.album_id)"""


@register("patch_albums", f"""
SELECT album_id, title, release_year, stock, {_money('price')} AS price, photo, artist_id,
       strftime(modified, {TS}) AS modified FROM {PATCHED_ALBUMS}""")
def patch_albums(s):
    out = ch.patch_rows(s.albums, s.album_patch, "album_id", "modified", PATCH_AT)
    return out.withColumn("price", money("price")).withColumn("modified", ts_text("modified"))


@register("changed_fields", f"""
SELECT n.album_id,
       CASE WHEN n.title IS DISTINCT FROM o.title THEN n.title END AS title,
       CASE WHEN n.release_year IS DISTINCT FROM o.release_year THEN n.release_year END
       AS release_year,
       {_money('CASE WHEN n.price IS DISTINCT FROM o.price THEN n.price END')} AS price,
       CASE WHEN n.artist_id IS DISTINCT FROM o.artist_id THEN n.artist_id END AS artist_id,
       CASE WHEN n.photo IS DISTINCT FROM o.photo THEN n.photo END AS photo
FROM {PATCHED_ALBUMS} n JOIN albums o ON o.album_id = n.album_id""")
def changed_fields(s):
    new = ch.patch_rows(s.albums, s.album_patch, "album_id", "modified", PATCH_AT)
    out = ch.changed_fields(s.albums, new, ["album_id"],
                            ["title", "release_year", "price", "artist_id", "photo"])
    return out.withColumn("price", money("price"))


@register("touched_albums", """
SELECT a.title, a.album_id FROM albums a JOIN album_patch p ON p.album_id = a.album_id
JOIN artists r ON r.artist_id = a.artist_id""")
def touched_albums(s):
    changed = s.albums.join(s.album_patch.select("album_id"), "album_id", "left_semi")
    return ch.touched_albums(changed, s.artists)


@register("update_by_key", """
SELECT d.dispatch_id, d.purchase_order,
       CASE WHEN r.dispatch_id IS NOT NULL THEN 'received' ELSE d.status END AS status, d.address
FROM dispatches d LEFT JOIN receipt_requests r ON r.dispatch_id = d.dispatch_id""")
def update_by_key(s):
    ch_ = s.receipt_requests.select("dispatch_id", F.lit("received").alias("status"))
    return ch.update_by_key(s.dispatches, ch_, ["dispatch_id"], ["status"])


# ---- deletes ----------------------------------------------------------------

@register("delete_rows", """
SELECT * FROM songs WHERE duration IS NOT NULL""")
def delete_rows(s):
    keys = s.songs.filter(F.col("duration").isNull()).select("album_id", "track")
    left, _gone = ch.delete_rows(s.songs, keys, ["album_id", "track"])
    return left


@register("deleted_names", """
SELECT 'artist' AS kind, artist_id AS id, name FROM artists WHERE artist_id % 7 = 0
UNION ALL SELECT 'album', album_id, title FROM albums WHERE album_id % 7 = 0""")
def deleted_names(s):
    """D-10: the names that deleting artists and albums returns; asked for
    twice, a row is deleted and returned once."""
    out = None
    for kind, table, key, name in (("artist", s.artists, "artist_id", "name"),
                                   ("album", s.albums, "album_id", "title")):
        asked = table.filter(F.col(key) % 7 == 0).select(key)
        _left, gone = ch.delete_rows(table, asked.unionByName(asked), [key])
        names = gone.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(name).alias("name"))
        out = names if out is None else out.unionByName(names)
    return out


@register("rows_in_keys", f"""
SELECT purchase_order, line, album_id, quantity, confirmed_quantity,
       {_money('line_total')} AS line_total
FROM purchase_order_lines
WHERE purchase_order IN (SELECT purchase_order FROM purchase_orders WHERE status = 'pending-buyer')
""")
def rows_in_keys(s):
    keys = s.purchase_orders.filter(F.col("status") == "pending-buyer").select("purchase_order")
    return ch.rows_in_keys(s.purchase_order_lines, keys, ["purchase_order"]).withColumn(
        "line_total", money("line_total"))


@register("delete_parents", """
WITH asked AS (SELECT artist_id FROM artists)
SELECT artist_id, CASE WHEN artist_id IN (SELECT artist_id FROM albums WHERE artist_id IS NOT NULL)
                       THEN 'refused' ELSE 'deleted' END AS outcome
FROM asked""")
def delete_parents(s):
    asked = s.artists.select("artist_id")
    _left, refused, _kids = ch.delete_parents(
        s.artists, asked, "artist_id", [("albums", s.albums, "artist_id", "restrict")])
    return asked.join(refused.withColumn("_r", F.lit(True)), "artist_id", "left").select(
        "artist_id", F.when(F.col("_r"), "refused").otherwise("deleted").alias("outcome"))


@register("delete_albums_cascade", """
WITH asked AS (SELECT album_id FROM albums),
refused AS (SELECT album_id FROM asked WHERE album_id IN (SELECT album_id FROM cart)
            OR album_id IN (SELECT album_id FROM orders_bridge)
            OR album_id IN (SELECT album_id FROM purchase_order_lines)),
gone AS (SELECT album_id FROM asked WHERE album_id NOT IN (SELECT album_id FROM refused))
SELECT * FROM songs WHERE album_id NOT IN (SELECT album_id FROM gone)""")
def delete_albums_cascade(s):
    asked = s.albums.select("album_id")
    _left, _refused, kids = ch.delete_parents(
        s.albums, asked, "album_id",
        [("cart", s.cart, "album_id", "restrict"),
         ("orders_bridge", s.orders_bridge, "album_id", "restrict"),
         ("purchase_order_lines", s.purchase_order_lines, "album_id", "restrict"),
         ("songs", s.songs, "album_id", "cascade")])
    return kids["songs"]


# ---- diffs and merges -------------------------------------------------------

DIFF_LINES = """(
WITH j AS (
  SELECT coalesce(n.purchase_order, o.purchase_order) AS purchase_order,
         coalesce(n.line, o.line) AS line,
         CASE WHEN o.line IS NULL THEN 'add' WHEN n.line IS NULL THEN 'delete'
              WHEN n.album_id IS DISTINCT FROM o.album_id OR n.quantity IS DISTINCT FROM o.quantity
                   OR n.line_total IS DISTINCT FROM o.line_total THEN 'update' END AS op,
         CASE WHEN n.line IS NULL THEN o.album_id ELSE n.album_id END AS album_id,
         CASE WHEN n.line IS NULL THEN o.quantity ELSE n.quantity END AS quantity,
         CASE WHEN n.line IS NULL THEN o.line_total ELSE n.line_total END AS line_total
  FROM purchase_order_lines o FULL OUTER JOIN {new} n
    ON n.purchase_order = o.purchase_order AND n.line = o.line),
first AS (SELECT purchase_order, album_id, arg_min_null(confirmed_quantity, line) AS c
          FROM purchase_order_lines GROUP BY purchase_order, album_id)
SELECT j.purchase_order, j.line, j.op, j.album_id, j.quantity, j.line_total,
       CASE WHEN j.op = 'delete' THEN NULL ELSE f.c END AS confirmed_quantity
FROM j LEFT JOIN first f ON f.purchase_order = j.purchase_order AND f.album_id = j.album_id
WHERE j.op IS NOT NULL)"""


@register("diff_lines", f"""
SELECT purchase_order, line, op, album_id, quantity, {_money('line_total')} AS line_total,
       confirmed_quantity FROM {DIFF_LINES.format(new='new_lines')}""")
def diff_lines(s):
    d = ch.diff_lines(s.purchase_order_lines, s.new_lines)
    return d.withColumn("line_total", money("line_total"))


EDITABLE_NEW = """(SELECT * FROM new_lines WHERE purchase_order IN
   (SELECT purchase_order FROM purchase_orders WHERE status = 'pending-buyer'))"""


@register("merge_lines", f"""
WITH d AS (SELECT * FROM {DIFF_LINES.format(new=EDITABLE_NEW)}
           WHERE purchase_order IN (SELECT purchase_order FROM purchase_orders
                                    WHERE status = 'pending-buyer'))
SELECT l.purchase_order, l.line, l.album_id, l.quantity, l.confirmed_quantity,
       {_money('l.line_total')} AS line_total
FROM purchase_order_lines l LEFT JOIN d ON d.purchase_order = l.purchase_order AND d.line = l.line
WHERE d.line IS NULL
UNION ALL
SELECT purchase_order, line, album_id, quantity, confirmed_quantity, {_money('line_total')}
FROM d WHERE op <> 'delete'""")
def merge_lines(s):
    lines, _pos = ch.merge_lines(s.purchase_order_lines, s.purchase_orders, s.new_lines,
                                 PATCH_AT)
    return lines.withColumn("line_total", money("line_total"))


@register("merge_lines_orders", f"""
WITH d AS (SELECT DISTINCT purchase_order FROM {DIFF_LINES.format(new=EDITABLE_NEW)}
           WHERE purchase_order IN (SELECT purchase_order FROM purchase_orders
                                    WHERE status = 'pending-buyer'))
SELECT p.purchase_order,
       CASE WHEN d.purchase_order IS NOT NULL THEN 'pending-supplier' ELSE p.status END AS status,
       strftime(CASE WHEN d.purchase_order IS NOT NULL THEN {AT} ELSE p.modified END, {TS})
       AS modified
FROM purchase_orders p LEFT JOIN d ON d.purchase_order = p.purchase_order""")
def merge_lines_orders(s):
    _lines, pos = ch.merge_lines(s.purchase_order_lines, s.purchase_orders, s.new_lines,
                                 PATCH_AT)
    return pos.select("purchase_order", "status", ts_text("modified").alias("modified"))


DIFF_SONGS = """(
  SELECT coalesce(n.album_id, o.album_id) AS album_id, coalesce(n.track, o.track) AS track,
         CASE WHEN o.track IS NULL THEN 'add' WHEN n.track IS NULL THEN 'delete'
              WHEN n.duration IS DISTINCT FROM o.duration OR n.song IS DISTINCT FROM o.song
              THEN 'update' END AS op,
         CASE WHEN n.track IS NULL THEN o.duration ELSE n.duration END AS duration,
         CASE WHEN n.track IS NULL THEN o.song ELSE n.song END AS song
  FROM songs o FULL OUTER JOIN new_songs n ON n.album_id = o.album_id AND n.track = o.track)"""


@register("diff_songs", f"SELECT * FROM {DIFF_SONGS} WHERE op IS NOT NULL")
def diff_songs(s):
    return ch.diff_songs(s.songs, s.new_songs)


@register("change_summary", f"""
WITH d AS (SELECT album_id, CAST(count(*) FILTER (WHERE op = 'add') AS BIGINT) AS added,
                  CAST(count(*) FILTER (WHERE op = 'update') AS BIGINT) AS updated,
                  CAST(count(*) FILTER (WHERE op = 'delete') AS BIGINT) AS deleted
           FROM {DIFF_SONGS} WHERE op IS NOT NULL GROUP BY album_id),
h AS (SELECT DISTINCT n.album_id FROM {PATCHED_ALBUMS} n JOIN albums o ON o.album_id = n.album_id
      WHERE n.title IS DISTINCT FROM o.title OR n.release_year IS DISTINCT FROM o.release_year
         OR n.price IS DISTINCT FROM o.price OR n.artist_id IS DISTINCT FROM o.artist_id
         OR n.photo IS DISTINCT FROM o.photo)
SELECT coalesce(d.album_id, h.album_id) AS album_id, coalesce(d.added, 0) AS added,
       coalesce(d.updated, 0) AS updated, coalesce(d.deleted, 0) AS deleted,
       h.album_id IS NOT NULL AS header_changed,
       h.album_id IS NOT NULL OR coalesce(d.added, 0) + coalesce(d.updated, 0)
                                  + coalesce(d.deleted, 0) > 0 AS changed
FROM d FULL OUTER JOIN h ON h.album_id = d.album_id""")
def change_summary(s):
    new = ch.patch_rows(s.albums, s.album_patch, "album_id", "modified", PATCH_AT)
    cf = ch.changed_fields(s.albums, new, ["album_id"],
                           ["title", "release_year", "price", "artist_id", "photo"])
    header = cf.filter(F.col("title").isNotNull() | F.col("release_year").isNotNull()
                       | F.col("price").isNotNull() | F.col("artist_id").isNotNull()
                       | F.col("photo").isNotNull())
    return ch.change_summary(ch.diff_songs(s.songs, s.new_songs), "album_id", header)


@register("line_change_summary", f"""
SELECT purchase_order, CAST(count(*) FILTER (WHERE op = 'add') AS BIGINT) AS added,
       CAST(count(*) FILTER (WHERE op = 'update') AS BIGINT) AS updated,
       CAST(count(*) FILTER (WHERE op = 'delete') AS BIGINT) AS deleted,
       false AS header_changed, true AS changed
FROM {DIFF_LINES.format(new='new_lines')} GROUP BY purchase_order""")
def line_change_summary(s):
    return ch.change_summary(ch.diff_lines(s.purchase_order_lines, s.new_lines),
                             "purchase_order")


@register("merge_songs", "SELECT album_id, track, duration, song FROM new_songs")
def merge_songs(s):
    songs, _albums = ch.merge_songs(s.songs, s.albums, s.new_songs, PATCH_AT)
    return songs


@register("merge_songs_albums", f"""
SELECT a.album_id, strftime(CASE WHEN a.album_id IN (SELECT album_id FROM {DIFF_SONGS}
                                                    WHERE op IS NOT NULL)
                                 THEN {AT} ELSE a.modified END, {TS}) AS modified
FROM albums a""")
def merge_songs_albums(s):
    _songs, albums = ch.merge_songs(s.songs, s.albums, s.new_songs, PATCH_AT)
    return albums.select("album_id", ts_text("modified").alias("modified"))


HALF_LINES = """(SELECT purchase_order, line, album_id, quantity, confirmed_quantity, line_total
    FROM purchase_order_lines WHERE purchase_order % 2 = 1
    UNION ALL SELECT purchase_order, line, album_id, quantity, confirmed_quantity, line_total
    FROM new_lines WHERE purchase_order % 2 = 0)"""


@register("merge_order_edits", f"""
WITH c AS (SELECT DISTINCT purchase_order FROM {DIFF_LINES.format(new=HALF_LINES)}),
e AS (SELECT purchase_order FROM purchase_orders
      WHERE status = 'pending-buyer' AND purchase_order IN (SELECT purchase_order FROM c))
SELECT p.purchase_order,
       CASE WHEN e.purchase_order IS NULL THEN p.status ELSE 'pending-supplier' END AS status,
       strftime(CASE WHEN e.purchase_order IS NULL THEN p.modified ELSE {AT} END, {TS}) AS modified,
       {_money('p.shipping_cost + CASE WHEN e.purchase_order IS NULL THEN 0 ELSE 1.5 END')} AS shipping_cost,
       strftime(p.estimated_receipt + CASE WHEN e.purchase_order IS NULL THEN INTERVAL 0 DAY
                                           ELSE INTERVAL 7 DAY END, {TS}) AS estimated_receipt
FROM purchase_orders p LEFT JOIN e ON e.purchase_order = p.purchase_order""")
def merge_order_edits(s):
    """D-16 with headers: every order's form has a new header, the forms of odd orders
    leave the lines as they are and so change nothing."""
    odd = F.col("purchase_order") % 2 == 1
    new = s.purchase_order_lines.filter(odd).unionByName(s.new_lines.filter(~odd))
    _lines, pos = ch.merge_lines(s.purchase_order_lines, s.purchase_orders, new, PATCH_AT, s.order_headers)
    return pos.select("purchase_order", "status", ts_text("modified").alias("modified"),
                      money("shipping_cost").alias("shipping_cost"),
                      ts_text("estimated_receipt").alias("estimated_receipt"))


@register("merge_album_edits", f"""
WITH d AS (SELECT DISTINCT album_id FROM {DIFF_SONGS} WHERE op IS NOT NULL AND album_id % 2 = 0),
h AS (SELECT n.*, n.title IS DISTINCT FROM o.title OR n.release_year IS DISTINCT FROM o.release_year
         OR n.price IS DISTINCT FROM o.price OR n.artist_id IS DISTINCT FROM o.artist_id
         OR n.photo IS DISTINCT FROM o.photo AS differs, o.modified AS old_stamp
      FROM {PATCHED_ALBUMS} n JOIN albums o ON o.album_id = n.album_id)
SELECT h.album_id, h.title, h.release_year, h.stock, {_money('h.price')} AS price, h.photo, h.artist_id,
       strftime(CASE WHEN differs OR d.album_id IS NOT NULL THEN {AT} ELSE old_stamp END, {TS}) AS modified
FROM h LEFT JOIN d ON d.album_id = h.album_id""")
def merge_album_edits(s):
    """D-17 with headers: album forms of every third album, songs changed on even albums
    only, so that some albums change by their header alone."""
    odd = F.col("album_id") % 2 == 1
    new = s.songs.filter(odd).unionByName(s.new_songs.filter(~odd))
    forms = ch.patch_rows(s.albums, s.album_patch, "album_id", None).select("album_id", *ch.ALBUM_FIELDS)
    _songs, albums = ch.merge_songs(s.songs, s.albums, new, PATCH_AT, forms)
    return albums.withColumn("price", money("price")).withColumn("modified", ts_text("modified"))


@register("zip_join", """
WITH o AS (SELECT album_id, track, song,
                  row_number() OVER (PARTITION BY album_id ORDER BY track) AS n FROM songs),
w AS (SELECT album_id, track, song,
             row_number() OVER (PARTITION BY album_id ORDER BY track) AS n FROM new_songs)
SELECT o.album_id, CAST(o.n AS BIGINT) AS n, o.track AS old_track, w.track AS new_track,
       o.song AS old_song, w.song AS new_song
FROM o JOIN w ON w.album_id = o.album_id AND w.n = o.n""")
def zip_join(s):
    a = s.songs.select("album_id", F.col("track").alias("old_track"),
                       F.col("song").alias("old_song"))
    b = s.new_songs.select("album_id", F.col("track").alias("new_track"),
                           F.col("song").alias("new_song"))
    z = ch.zip_join(a, b, ["album_id"], "old_track", "new_track")
    return z.select("album_id", F.col("_n").cast("bigint").alias("n"), "old_track",
                    "new_track", "old_song", "new_song")


@register("title_conflicts", """
WITH c AS (SELECT album_id, artist_id, upper(title) AS title FROM albums
           UNION ALL
           SELECT NULL, artist_id, title || ' ii' FROM albums)
SELECT c.album_id, c.artist_id, c.title FROM c
WHERE EXISTS (SELECT 1 FROM albums a WHERE a.artist_id = c.artist_id
              AND lower(a.title) = lower(c.title)
              AND (c.album_id IS NULL OR c.album_id <> a.album_id))""")
def title_conflicts(s):
    # Every album re-submitted upper-cased (edit) and as a new "<title> ii".
    edits = s.albums.select("album_id", "artist_id", F.upper("title").alias("title"))
    new = s.albums.select(F.lit(None).cast("bigint").alias("album_id"), "artist_id",
                          F.concat("title", F.lit(" ii")).alias("title"))
    return ch.title_conflicts(s.albums, edits.unionByName(new))


@register("artist_conflicts", """
WITH c AS (SELECT a.artist_id, upper(b.name) AS name FROM artists a
           JOIN artists b ON b.artist_id = a.artist_id + 1
           UNION ALL
           SELECT NULL, name FROM artists
           UNION ALL
           SELECT artist_id, name FROM artists)
SELECT c.artist_id, c.name FROM c
WHERE EXISTS (SELECT 1 FROM artists a WHERE lower(a.name) = lower(c.name)
              AND (c.artist_id IS NULL OR c.artist_id <> a.artist_id))""")
def artist_conflicts(s):
    a = s.artists
    nxt = a.select((F.col("artist_id") - 1).alias("artist_id"), F.upper("name").alias("name"))
    # Each artist renamed to the next one's name, each name sent as a new
    # artist, and each artist re-sent unchanged (no conflict).
    edits = a.select("artist_id").join(nxt, "artist_id")
    new = a.select(F.lit(None).cast("bigint").alias("artist_id"), "name")
    same = a.select("artist_id", "name")
    return ch.artist_conflicts(a, edits.unionByName(new).unionByName(same))


# ---- workflows --------------------------------------------------------------

@register("checkout", """
WITH buyers AS (SELECT r.user_id FROM checkout_requests r
                WHERE r.user_id IN (SELECT user_id FROM users)
                  AND r.user_id IN (SELECT user_id FROM cart)),
ids AS (SELECT user_id, CAST((SELECT max(order_id) FROM orders_h)
                             + row_number() OVER (ORDER BY user_id) AS BIGINT) AS order_id
        FROM buyers)
SELECT i.order_id, i.user_id, c.album_id, c.quantity
FROM ids i JOIN cart c ON c.user_id = i.user_id""")
def checkout(s):
    orders, bridge, _cart, _empty = ch.checkout(s.users, s.cart, s.orders_h, s.orders_bridge,
                                                s.checkout_requests, PATCH_AT)
    new = orders.join(s.orders_h.select("order_id"), "order_id", "left_anti")
    return new.join(bridge, "order_id").select("order_id", "user_id", "album_id", "quantity")


@register("checkout_empty", """
SELECT r.user_id FROM checkout_requests r WHERE r.user_id NOT IN (SELECT user_id FROM cart)""")
def checkout_empty(s):
    *_rest, empty = ch.checkout(s.users, s.cart, s.orders_h, s.orders_bridge,
                                s.checkout_requests, PATCH_AT)
    return empty


@register("apply_confirmations", f"""
WITH nl AS (SELECT l.purchase_order, l.line, l.quantity,
                   CASE WHEN c.line IS NOT NULL THEN c.confirmed ELSE l.confirmed_quantity END AS cq
            FROM purchase_order_lines l LEFT JOIN confirmation_rows c
              ON c.purchase_order = l.purchase_order AND c.line = l.line),
st AS (SELECT purchase_order,
              CASE WHEN coalesce(bool_and(quantity IS NOT DISTINCT FROM cq), true)
                   THEN 'confirmed' ELSE 'pending-buyer' END AS status
       FROM nl WHERE purchase_order IN (SELECT purchase_order FROM confirmation_rows)
       GROUP BY purchase_order)
SELECT p.purchase_order, coalesce(st.status, p.status) AS status,
       strftime(CASE WHEN st.purchase_order IS NOT NULL THEN {AT} ELSE p.modified END, {TS})
       AS modified
FROM purchase_orders p LEFT JOIN st ON st.purchase_order = p.purchase_order""")
def apply_confirmations(s):
    from ..sources.messages import parse_confirmations
    rows = parse_confirmations(s.confirmations)
    _lines, pos = ch.apply_confirmations(s.purchase_orders, s.purchase_order_lines, rows)
    return pos.select("purchase_order", "status", ts_text("modified").alias("modified"))


@register("confirmed_lines", """
SELECT l.purchase_order, l.line, l.album_id, l.quantity,
       CASE WHEN c.line IS NOT NULL THEN c.confirmed ELSE l.confirmed_quantity END
       AS confirmed_quantity
FROM purchase_order_lines l LEFT JOIN confirmation_rows c
  ON c.purchase_order = l.purchase_order AND c.line = l.line""")
def confirmed_lines(s):
    from ..sources.messages import parse_confirmations
    rows = parse_confirmations(s.confirmations)
    lines, _pos = ch.apply_confirmations(s.purchase_orders, s.purchase_order_lines, rows)
    return lines.select("purchase_order", "line", "album_id", "quantity", "confirmed_quantity")


@register("apply_dispatch_updates", """
WITH lastu AS (SELECT dispatch_id, arg_max(status, seq) AS status FROM dispatch_msgs
               WHERE kind = 'update' GROUP BY dispatch_id),
d AS (SELECT dispatch_id, purchase_order, status, address FROM dispatches
      UNION ALL
      SELECT dispatch_id, arg_max(purchase_order, seq), arg_max(status, seq), arg_max(address, seq)
      FROM dispatch_msgs WHERE kind = 'note'
        AND dispatch_id NOT IN (SELECT dispatch_id FROM dispatches) GROUP BY dispatch_id)
SELECT d.dispatch_id, d.purchase_order, coalesce(u.status, d.status) AS status, d.address
FROM d LEFT JOIN lastu u ON u.dispatch_id = d.dispatch_id""")
def apply_dispatch_updates(s):
    d, _pos = ch.apply_dispatch_updates(s.dispatches, s.purchase_orders, s.dispatch_msgs,
                                        PATCH_AT)
    return d


@register("dispatch_update_orders", f"""
WITH mv AS (SELECT d.purchase_order, arg_max(m.estimated_delivery, m.seq) AS er
            FROM dispatch_msgs m JOIN dispatches d ON d.dispatch_id = m.dispatch_id
            WHERE m.kind = 'update' AND m.status = 'rescheduled' GROUP BY d.purchase_order)
SELECT p.purchase_order,
       strftime(CASE WHEN mv.purchase_order IS NOT NULL THEN mv.er ELSE p.estimated_receipt END,
                {TS}) AS estimated_receipt,
       strftime(CASE WHEN mv.purchase_order IS NOT NULL THEN {AT} ELSE p.modified END, {TS})
       AS modified
FROM purchase_orders p LEFT JOIN mv ON mv.purchase_order = p.purchase_order""")
def dispatch_update_orders(s):
    _d, pos = ch.apply_dispatch_updates(s.dispatches, s.purchase_orders, s.dispatch_msgs,
                                        PATCH_AT)
    return pos.select("purchase_order", ts_text("estimated_receipt").alias("estimated_receipt"),
                      ts_text("modified").alias("modified"))


RECEIVED = """(SELECT r.dispatch_id FROM receipt_requests r JOIN dispatches d
               ON d.dispatch_id = r.dispatch_id WHERE d.status = 'shipped')"""


@register("receive_dispatches", f"""
WITH got AS (SELECT l.album_id, sum(l.confirmed_quantity) AS n
             FROM {RECEIVED} ok JOIN dispatches d ON d.dispatch_id = ok.dispatch_id
             JOIN purchase_orders p ON p.purchase_order = d.purchase_order
             JOIN purchase_order_lines l ON l.purchase_order = d.purchase_order
             GROUP BY l.album_id)
SELECT a.album_id, CAST(a.stock + coalesce(g.n, 0) AS BIGINT) AS stock
FROM albums a LEFT JOIN got g ON g.album_id = a.album_id""")
def receive_dispatches(s):
    _d, albums, _gate = ch.receive_dispatches(s.dispatches, s.albums, s.purchase_orders,
                                              s.purchase_order_lines, s.receipt_requests)
    return albums.select("album_id", "stock")


@register("received_dispatches", f"""
SELECT d.dispatch_id, d.purchase_order,
       CASE WHEN d.dispatch_id IN {RECEIVED} THEN 'received' ELSE d.status END AS status,
       d.address FROM dispatches d""")
def received_dispatches(s):
    d, _albums, _gate = ch.receive_dispatches(s.dispatches, s.albums, s.purchase_orders,
                                              s.purchase_order_lines, s.receipt_requests)
    return d


@register("rename_photos", """
WITH ren AS (SELECT a.artist_id, p.name AS new_name FROM artists a
             JOIN artist_patch p ON p.artist_id = a.artist_id
             WHERE coalesce(p.name, a.name) IS DISTINCT FROM a.name)
SELECT b.album_id, b.photo AS old_photo,
       replace(regexp_replace(lower(r.new_name || '-' || b.title), '[^a-z0-9\\s-]', '', 'g'),
               ' ', '-') || '.' || string_split(b.photo, '.')[-1] AS new_photo
FROM albums b JOIN ren r ON r.artist_id = b.artist_id""")
def rename_photos(s):
    new = ch.patch_rows(s.artists, s.artist_patch, "artist_id", "modified", PATCH_AT)
    return ch.rename_photos(s.artists, new, s.albums)


@register("apply_photo_names", f"""
WITH ren AS (SELECT a.artist_id, p.name AS new_name FROM artists a
             JOIN artist_patch p ON p.artist_id = a.artist_id
             WHERE coalesce(p.name, a.name) IS DISTINCT FROM a.name)
SELECT b.album_id,
       CASE WHEN r.artist_id IS NULL THEN b.photo ELSE
         replace(regexp_replace(lower(r.new_name || '-' || b.title), '[^a-z0-9\\s-]', '', 'g'),
                 ' ', '-') || '.' || string_split(b.photo, '.')[-1] END AS photo,
       strftime(CASE WHEN r.artist_id IS NULL THEN b.modified ELSE {AT} END, {TS}) AS modified
FROM albums b LEFT JOIN ren r ON r.artist_id = b.artist_id""")
def apply_photo_names(s):
    new = ch.patch_rows(s.artists, s.artist_patch, "artist_id", "modified", PATCH_AT)
    out = ch.apply_photo_names(s.albums, ch.rename_photos(s.artists, new, s.albums), PATCH_AT)
    return out.select("album_id", "photo", ts_text("modified").alias("modified"))


@register("added_lines", """
SELECT n.purchase_order, n.line, n.album_id, n.quantity FROM new_lines n
WHERE NOT EXISTS (SELECT 1 FROM purchase_order_lines o
                  WHERE o.purchase_order = n.purchase_order AND o.line = n.line)""")
def added_lines(s):
    return ch.added_rows(s.purchase_order_lines, s.new_lines, ["purchase_order", "line"]) \
        .select("purchase_order", "line", "album_id", "quantity")


@register("removed_lines", """
SELECT o.purchase_order, o.line, o.album_id, o.quantity FROM purchase_order_lines o
WHERE NOT EXISTS (SELECT 1 FROM new_lines n
                  WHERE n.purchase_order = o.purchase_order AND n.line = o.line)""")
def removed_lines(s):
    return ch.removed_rows(s.purchase_order_lines, s.new_lines, ["purchase_order", "line"]) \
        .select("purchase_order", "line", "album_id", "quantity")


# ---- bulk changes through parallel arrays (D-2, D-6) -------------------------

def _as_arrays_and_back(df):
    """The reference ships row sets as parallel arrays; do the same trip."""
    arr = ch.rows_to_arrays(df, ["album_id"], ["track", "duration", "song"], "track")
    return ch.arrays_to_rows(arr, ["album_id"], ["track", "duration", "song"])


@register("update_songs", """
SELECT s.album_id, s.track,
       CASE WHEN n.track IS NOT NULL THEN n.duration ELSE s.duration END AS duration,
       CASE WHEN n.track IS NOT NULL THEN n.song ELSE s.song END AS song
FROM songs s LEFT JOIN new_songs n ON n.album_id = s.album_id AND n.track = s.track""")
def update_songs(s):
    rows_ = _as_arrays_and_back(s.new_songs)
    return ch.update_by_key(s.songs, rows_, ["album_id", "track"], ["duration", "song"])


@register("insert_songs", """
SELECT album_id, track, duration, song FROM songs
UNION ALL
SELECT n.album_id, n.track, n.duration, n.song FROM new_songs n
WHERE NOT EXISTS (SELECT 1 FROM songs s WHERE s.album_id = n.album_id AND s.track = n.track)""")
def insert_songs(s):
    added = ch.added_rows(s.songs, s.new_songs, ["album_id", "track"])
    return ch.append_rows(s.songs, _as_arrays_and_back(added))


@register("cart_checkout_cycle", f"""
WITH {ADMIT},
new_cart AS (SELECT user_id, album_id, CAST(sum(quantity) AS BIGINT) AS quantity FROM (
               SELECT user_id, album_id, quantity FROM cart
               UNION ALL SELECT user_id, album_id, delta FROM adm WHERE accepted)
             GROUP BY user_id, album_id HAVING sum(quantity) > 0),
buyers AS (SELECT r.user_id FROM checkout_requests r
           WHERE r.user_id IN (SELECT user_id FROM users)
             AND r.user_id IN (SELECT user_id FROM new_cart)),
ids AS (SELECT user_id, CAST((SELECT max(order_id) FROM orders_h)
                             + row_number() OVER (ORDER BY user_id) AS BIGINT) AS order_id
        FROM buyers)
SELECT i.order_id, i.user_id, c.album_id, c.quantity
FROM ids i JOIN new_cart c ON c.user_id = i.user_id""")
def cart_checkout_cycle(s):
    from ..operators.audits import audit_checks
    albums, _cart, orders, bridge, _adm = ch.cart_checkout_cycle(
        s.albums, s.cart, s.cart_events, s.users, s.orders_h, s.orders_bridge,
        s.checkout_requests, PATCH_AT)
    # C-3 before the snapshot would be written: admission never oversells.
    if not audit_checks({"albums": albums, "dispatches": s.dispatches,
                         "purchase_orders": s.purchase_orders, "users": s.users}) \
            .filter(F.col("column") == "stock").isEmpty():
        raise ValueError("negative stock after admission")
    new = orders.join(s.orders_h.select("order_id"), "order_id", "left_anti")
    return new.join(bridge, "order_id").select("order_id", "user_id", "album_id", "quantity")
