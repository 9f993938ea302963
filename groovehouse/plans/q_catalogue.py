"""Catalogue queries: S-1..5, A-2, A-8, A-9, A-13, PF-1..4, PF-8, F-3, F-11, J-15."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import format_duration
from ..operators import catalogue as cat
from .registry import register

TS = "'%Y-%m-%d %H:%M:%S'"
LISTING = f"""a.artist_id, r.name, a.album_id, a.title, a.photo, a.stock, a.release_year,
    CAST(round(a.price, 2) AS DOUBLE) AS price, strftime(a.modified, {TS}) AS modified"""


@register("album_page", f"""
SELECT {LISTING} FROM albums a JOIN artists r ON r.artist_id = a.artist_id
WHERE lower(r.name) LIKE '%ring%' OR lower(a.title) LIKE '%ring%'
ORDER BY price DESC NULLS FIRST, a.album_id DESC LIMIT 8 OFFSET 8""")
def album_page(s):
    return cat.album_page(s.albums, s.artists, page=2, sort="price",
                          direction="descending", q="ring")


@register("album_page_title", f"""
SELECT {LISTING} FROM albums a JOIN artists r ON r.artist_id = a.artist_id
ORDER BY a.title ASC NULLS LAST, a.album_id ASC LIMIT 8 OFFSET 24""")
def album_page_title(s):
    return cat.album_page(s.albums, s.artists, page=4, sort="title", direction="ascending")


@register("search_albums", f"""
SELECT {LISTING} FROM albums a JOIN artists r ON r.artist_id = a.artist_id
WHERE lower(r.name) LIKE '%blue%' OR lower(a.title) LIKE '%blue%'""")
def search_albums(s):
    return cat.search_albums(s.albums, s.artists, "Blue")


@register("search_artists", """
SELECT artist_id, name, bio FROM artists WHERE lower(name) LIKE '%01%'""")
def search_artists(s):
    return cat.search_artists(s.artists, "01").select("artist_id", "name", "bio")


@register("artist_page", f"""
SELECT r.artist_id, r.name, r.bio, strftime(r.modified, {TS}) AS modified,
       CAST(count(a.album_id) AS BIGINT) AS albums
FROM artists r LEFT JOIN albums a ON a.artist_id = r.artist_id
GROUP BY r.artist_id, r.name, r.bio, r.modified
ORDER BY modified DESC NULLS FIRST, r.artist_id DESC LIMIT 8 OFFSET 8""")
def artist_page(s):
    return cat.artist_page(s.artists, s.albums, page=2, sort="modified",
                           direction="descending")


@register("artist_listing", f"""
SELECT r.artist_id, r.name, r.bio, strftime(r.modified, {TS}) AS modified,
       CAST(count(a.album_id) AS BIGINT) AS albums
FROM artists r LEFT JOIN albums a ON a.artist_id = r.artist_id
GROUP BY r.artist_id, r.name, r.bio, r.modified""")
def artist_listing(s):
    return cat.artist_listing(s.artists, s.albums)


@register("artist_index", "SELECT name, artist_id FROM artists ORDER BY name, artist_id")
def artist_index(s):
    return cat.artist_index(s.artists)


@register("page_counts", """
SELECT 'albums' AS scope, '' AS q, CAST(ceil(count(album_id) / 8.0) AS BIGINT) AS pages FROM albums
UNION ALL
SELECT 'albums', 'ring', CAST(ceil(count(a.album_id) / 8.0) AS BIGINT)
FROM albums a JOIN artists r ON r.artist_id = a.artist_id
WHERE lower(r.name) LIKE '%ring%' OR lower(a.title) LIKE '%ring%'
UNION ALL
SELECT 'artists', '', CAST(ceil(count(artist_id) / 8.0) AS BIGINT) FROM artists
UNION ALL
SELECT 'artists', '01', CAST(ceil(count(artist_id) / 8.0) AS BIGINT) FROM artists
WHERE lower(name) LIKE '%01%'""")
def page_counts(s):
    out = None
    for scope, q in (("albums", None), ("albums", "ring"), ("artists", None),
                     ("artists", "01")):
        df = cat.page_count(s.albums, s.artists, scope, q).select(
            F.lit(scope).alias("scope"), F.lit(q or "").alias("q"), "pages")
        out = df if out is None else out.unionByName(df)
    return out


@register("page_manifest", """
SELECT CAST(ceil(pos / 8.0) AS BIGINT) AS page, arg_min(album_id, pos) AS first_id,
       arg_max(album_id, pos) AS last_id, count(*) AS rows
FROM (SELECT a.album_id, row_number() OVER (ORDER BY a.price DESC NULLS FIRST,
             a.album_id DESC) AS pos
      FROM albums a JOIN artists r ON r.artist_id = a.artist_id)
GROUP BY 1""")
def page_manifest(s):
    df = cat.albums_with_artist(s.albums, s.artists).select("album_id", "price")
    return cat.page_manifest(df, [F.col("price").desc_nulls_first(),
                                  F.col("album_id").desc()], "album_id")


@register("artists_by_name", """
SELECT upper(n.name) AS asked, r.artist_id
FROM artists n JOIN artists r ON lower(r.name) = lower(upper(n.name))""")
def artists_by_name(s):
    names = s.artists.select(F.upper("name").alias("name"))
    return cat.artists_by_name(s.artists, names)


@register("artist_short", """
SELECT artist_id, name, bio FROM artists
WHERE artist_id IN (SELECT artist_id FROM albums WHERE stock = 0)""")
def artist_short(s):
    ids = s.albums.filter(F.col("stock") == 0).select("artist_id")
    return cat.artist_short(s.artists, ids)


@register("artist_with_albums", """
SELECT r.artist_id, r.name, r.bio, CAST(count(a.album_id) AS BIGINT) AS n_albums,
       coalesce(string_agg(CAST(a.album_id AS VARCHAR) || ':' || a.title || ':'
                || CAST(CAST(round(a.price, 2) AS DOUBLE) AS VARCHAR), ';'
                ORDER BY a.album_id), '') AS albums_text
FROM artists r LEFT JOIN albums a ON a.artist_id = r.artist_id
GROUP BY r.artist_id, r.name, r.bio""")
def artist_with_albums(s):
    doc = cat.artist_with_albums(s.artists, s.albums)
    return doc.select("artist_id", "name", "bio",
                      F.size("albums").cast("bigint").alias("n_albums"),
                      F.array_join(F.transform("albums", lambda a: F.concat_ws(
                          ":", a["album_id"].cast("string"), a["title"],
                          a["price"].cast("string"))), ";").alias("albums_text"))


@register("album_detail", """
SELECT a.album_id, a.artist_id, r.name, a.title, a.release_year, a.photo, a.stock,
       CAST(round(a.price, 2) AS DOUBLE) AS price, CAST(count(*) AS BIGINT) AS n_songs,
       string_agg(CAST(s.track AS VARCHAR) || ':' || s.song || ':' ||
                  coalesce(printf('%d:%02d', (s.duration % 3600) // 60, s.duration % 60), ''),
                  '|' ORDER BY s.track) AS songs_text
FROM albums a JOIN artists r ON r.artist_id = a.artist_id
JOIN songs s ON s.album_id = a.album_id
GROUP BY a.album_id, a.artist_id, r.name, a.title, a.release_year, a.photo, a.stock, a.price""")
def album_detail(s):
    doc = cat.album_detail(s.albums, s.artists, s.songs)
    return doc.select(
        "album_id", "artist_id", "name", "title", "release_year", "photo", "stock", "price",
        F.size("songs").cast("bigint").alias("n_songs"),
        F.array_join(F.transform("songs", lambda x: F.concat(
            x["track"].cast("string"), F.lit(":"), x["song"], F.lit(":"),
            F.coalesce(F.when(x["duration"].isNotNull(), format_duration(x["duration"])),
                       F.lit("")))), "|").alias("songs_text"))


@register("song_listing", """
SELECT album_id, track, song,
       CASE WHEN duration IS NOT NULL
            THEN printf('%d:%02d', (duration % 3600) // 60, duration % 60) END AS length
FROM songs""")
def song_listing(s):
    return cat.song_listing(s.songs)


def _slug_sql(c: str) -> str:
    out = f"url_encode(regexp_replace(lower({c}), '\\s', '-', 'g'))"
    for code, ch in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = f"replace({out}, '{code}', '{ch}')"
    return out


@register("album_links", f"""
SELECT a.album_id, '/artist/' || {_slug_sql('r.name')} || '/' || {_slug_sql('a.title')} AS link
FROM albums a JOIN artists r ON r.artist_id = a.artist_id""")
def album_links(s):
    return cat.album_links(s.albums, s.artists)


@register("match_previews", """
WITH mine AS (SELECT a.album_id, lower(a.title) AS t, lower(r.name) AS n
              FROM albums a JOIN artists r ON r.artist_id = a.artist_id),
first AS (SELECT m.album_id, min(e.ext_album_id) AS ext_album_id
          FROM mine m JOIN ext_albums e ON lower(e.title) = m.t AND lower(e.artist) = m.n
          GROUP BY m.album_id)
SELECT s.album_id, s.track, s.song, t.preview
FROM songs s LEFT JOIN first f ON f.album_id = s.album_id
LEFT JOIN ext_tracks t ON t.ext_album_id = f.ext_album_id AND t.position = s.track""")
def match_previews(s):
    return cat.match_previews(s.albums, s.artists, s.songs, s.ext_albums, s.ext_tracks)
