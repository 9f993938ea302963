"""Source and sink queries: SRC-2, SRC-4, SRC-6, SNK-1, SNK-2, F-8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import local_time, money
from ..sinks import po_messages as _po_messages
from ..sinks import to_documents
from ..sources import forms
from ..sources.messages import parse_confirmations
from .registry import register


@register("forms_to_rows", """
SELECT 'album-' || CAST(album_id AS VARCHAR) AS form_id, track AS n, track, trim(song) AS song,
       duration
FROM songs""")
def forms_to_rows(s):
    kv = s.form_fields.filter(F.col("form_id").startswith("album-"))
    return forms.song_form_rows(kv)


@register("form_lines", """
SELECT 'po-' || CAST(l.purchase_order AS VARCHAR) AS form_id, l.line, a.artist_id,
       trim(r.name) AS artist, l.album_id, trim(a.title) AS album, l.quantity,
       CAST(round(l.line_total, 2) AS DOUBLE) AS line_total
FROM purchase_order_lines l LEFT JOIN albums a ON a.album_id = l.album_id
LEFT JOIN artists r ON r.artist_id = a.artist_id""")
def form_lines(s):
    kv = s.form_fields.filter(F.col("form_id").startswith("po-"))
    return forms.line_form_rows(kv).withColumn("line_total", money("line_total"))


ALLOW = """(SELECT split_part(x, ':', 1) AS username, split_part(x, ':', 2) AS role
           FROM (SELECT unnest(string_split(allow, ',')) AS x FROM allow_list))"""


@register("allow_list", f"SELECT username, role FROM {ALLOW}")
def allow_list(s):
    return forms.allow_list(s.allow_list)


@register("admit_users", f"""
SELECT u.username, a.role, a.role IS NOT NULL AS admitted
FROM users u LEFT JOIN {ALLOW} a ON a.username = u.username""")
def admit_users(s):
    return forms.admit_users(s.users, forms.allow_list(s.allow_list))


@register("parse_confirmations", """
SELECT purchase_order, line, confirmed, album_id FROM confirmation_rows""")
def parse_confirmations_q(s):
    return parse_confirmations(s.confirmations).select("purchase_order", "line", "confirmed",
                                                       "album_id")


@register("local_times", """
SELECT order_id, strftime(dispatched, '%-d.%-m.%Y %H:%M') AS local FROM orders_h""")
def local_times(s):
    return s.orders_h.select("order_id", local_time("dispatched", "UTC").alias("local"))


TS = "'%Y-%m-%d %H:%M:%S'"


@register("po_messages", f"""
WITH d AS (SELECT purchase_order,
                  list({{'line': line, 'album_id': album_id, 'quantity': quantity,
                        'line_total': CAST(round(line_total, 2) AS DOUBLE)}} ORDER BY line) AS data
           FROM purchase_order_lines GROUP BY purchase_order)
SELECT p.purchase_order, CAST(CASE
  WHEN p.estimated_receipt IS NULL THEN to_json({{'client_id': 'shop',
       'purchase_order_id': p.purchase_order, 'status': p.status,
       'modified': strftime(p.modified, {TS}), 'data': d.data,
       'dispatch_cost': CAST(round(p.shipping_cost, 2) AS DOUBLE)}})
  ELSE to_json({{'client_id': 'shop', 'purchase_order_id': p.purchase_order,
       'status': p.status, 'modified': strftime(p.modified, {TS}), 'data': d.data,
       'estimated_delivery': strftime(p.estimated_receipt, {TS}),
       'dispatch_cost': CAST(round(p.shipping_cost, 2) AS DOUBLE)}}) END AS VARCHAR) AS payload
FROM purchase_orders p JOIN d ON d.purchase_order = p.purchase_order
WHERE p.status = 'pending-supplier'""")
def po_messages(s):
    pend = s.purchase_orders.filter(F.col("status") == "pending-supplier")
    return _po_messages(pend, s.purchase_order_lines)


ALBUM_DOC = ("STRUCT(album_id BIGINT, artist_id BIGINT, title VARCHAR, name VARCHAR, "
             "release_year BIGINT, photo VARCHAR, stock BIGINT, price DOUBLE)[]")


@register("artist_documents", f"""
WITH al AS (SELECT a.artist_id,
                   list({{'album_id': a.album_id, 'artist_id': a.artist_id, 'title': a.title,
                         'name': r.name, 'release_year': a.release_year, 'photo': a.photo,
                         'stock': a.stock, 'price': CAST(round(a.price, 2) AS DOUBLE)}}
                        ORDER BY a.album_id) AS albums
            FROM albums a JOIN artists r ON r.artist_id = a.artist_id GROUP BY a.artist_id)
SELECT CAST(to_json({{'artist_id': r.artist_id, 'name': r.name, 'bio': r.bio,
                     'albums': coalesce(al.albums, []::{ALBUM_DOC})}}) AS VARCHAR) AS value
FROM artists r LEFT JOIN al ON al.artist_id = r.artist_id""")
def artist_documents(s):
    from ..operators.catalogue import artist_with_albums
    return to_documents(artist_with_albums(s.artists, s.albums), drop_nulls=True)


@register("parse_dispatch_messages", f"""
SELECT dispatch_id, status, strftime(estimated_delivery, {TS}) AS estimated_delivery
FROM dispatch_msgs WHERE kind = 'update'
UNION ALL
SELECT dispatch_id, status, CAST(NULL AS VARCHAR) FROM dispatch_msgs WHERE kind = 'note'""")
def parse_dispatch_messages(s):
    """SRC-4: dispatch notes and updates sent as JSON text, parsed back."""
    from ..sources.messages import parse_dispatch_notes, parse_dispatch_updates
    m = s.dispatch_msgs
    upd = m.filter(F.col("kind") == "update").select(F.to_json(F.struct(
        "dispatch_id", "status",
        F.date_format("estimated_delivery", "yyyy-MM-dd HH:mm:ss").alias("estimated_delivery")))
        .alias("payload"))
    notes = m.filter(F.col("kind") == "note").select(F.to_json(F.struct(
        "dispatch_id", "purchase_order", "status", "address")).alias("payload"))
    u = parse_dispatch_updates(upd).select("dispatch_id", "status", "estimated_delivery")
    n = parse_dispatch_notes(notes).select(
        "dispatch_id", "status", F.lit(None).cast("timestamp_ntz").alias("estimated_delivery"))
    return u.unionByName(n).withColumn(
        "estimated_delivery", F.date_format("estimated_delivery", "yyyy-MM-dd HH:mm:ss"))


@register("snapshot_reload", """
SELECT album_id, track, duration, song FROM new_songs""")
def snapshot_reload(s):
    """SNK-3 and SRC-1: the edited songs written as a new version, read with the declared schema."""
    from ..operators.changes import merge_songs
    from ..sinks import save_snapshot
    from ..sources.fixtures import PATCH_AT
    from ..sources.tables import read_table
    from ..streaming.streams import scratch_root
    songs, _albums = merge_songs(s.songs, s.albums, s.new_songs, PATCH_AT)
    path = save_snapshot(songs, f"{scratch_root(s.spark, 'snapshot')}/songs", 1)
    return read_table(s.spark, path, "songs").select("album_id", "track", "duration", "song")
