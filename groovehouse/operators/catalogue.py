"""Catalogue reads: search, paging, album and artist documents.

IDs: PF-1..4, PF-8, A-2, A-8, A-9, A-13, A-18, S-1..5, J-5, J-15, F-3, F-11.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import PAGE_SIZE
from ..functions.exprs import format_duration, money, search_match, ts_text, url_slug
from .nesting import nest_children
from .positions import global_positions

# Sort columns the reference's pages offer (allow-list, never pasted SQL).
ALBUM_SORTS = ("name", "title", "stock", "price", "release_year", "modified")
ARTIST_SORTS = ("name", "modified")


def _offset(page: int) -> int:
    if page < 1:
        raise ValueError("page numbers start at 1")
    return (page - 1) * PAGE_SIZE


def _order(col: str, key: str, direction: str) -> list[Column]:
    """Sort key plus id tie-break in the same direction; NULL last on
    ascending, first on descending (PostgreSQL's order)."""
    if direction == "ascending":
        return [F.col(col).asc_nulls_last(), F.col(key).asc()]
    if direction == "descending":
        return [F.col(col).desc_nulls_first(), F.col(key).desc()]
    raise ValueError(f"direction must be ascending or descending, not {direction!r}")


def album_listing_columns(df: DataFrame) -> DataFrame:
    """PF-1: listing projection: money to double, timestamp to text."""
    return df.select("artist_id", "name", "album_id", "title", "photo", "stock",
                     "release_year", money("price").alias("price"),
                     ts_text("modified").alias("modified"))


def albums_with_artist(albums: DataFrame, artists: DataFrame, q: str | None = None
                       ) -> DataFrame:
    """Albums inner-joined to their artist, optionally searched (PF-2)."""
    df = albums.join(artists.select("artist_id", "name"), "artist_id")
    if q is not None:
        df = df.filter(search_match(q, "name", "title"))
    return df


def search_albums(albums: DataFrame, artists: DataFrame, q: str) -> DataFrame:
    """PF-2: albums whose artist name or title contains ``q`` (any case)."""
    return album_listing_columns(albums_with_artist(albums, artists, q))


def search_artists(artists: DataFrame, q: str) -> DataFrame:
    """PF-3: artists whose name contains ``q`` (any case)."""
    return artists.filter(search_match(q, "name"))


def album_page(albums: DataFrame, artists: DataFrame, page: int, sort: str,
               direction: str, q: str | None = None) -> DataFrame:
    """S-1: one page of 8 albums; a top-k plan (offset + 8 rows per task)."""
    if sort not in ALBUM_SORTS:
        raise ValueError(f"sort must be one of {ALBUM_SORTS}")
    listing = album_listing_columns(albums_with_artist(albums, artists, q))
    return (listing.orderBy(*_order(sort, "album_id", direction))
            .offset(_offset(page)).limit(PAGE_SIZE))


def album_counts(albums: DataFrame) -> DataFrame:
    """A-13/A-18: album count per artist id, aggregated before any join."""
    return (albums.filter(F.col("artist_id").isNotNull())
            .groupBy("artist_id").agg(F.count("album_id").alias("albums")))


def artist_listing(artists: DataFrame, albums: DataFrame, q: str | None = None
                   ) -> DataFrame:
    """A-13: every artist with its album count, 0 for none."""
    a = artists if q is None else search_artists(artists, q)
    return (a.join(album_counts(albums), "artist_id", "left")
            .select("artist_id", "name", "bio", ts_text("modified").alias("modified"),
                    F.coalesce("albums", F.lit(0)).cast("bigint").alias("albums")))


def artist_page(artists: DataFrame, albums: DataFrame, page: int, sort: str,
                direction: str, q: str | None = None) -> DataFrame:
    """S-2: one page of 8 artists with album counts."""
    if sort not in ARTIST_SORTS:
        raise ValueError(f"sort must be one of {ARTIST_SORTS}")
    return (artist_listing(artists, albums, q)
            .orderBy(*_order(sort, "artist_id", direction))
            .offset(_offset(page)).limit(PAGE_SIZE))


def artist_index(artists: DataFrame) -> DataFrame:
    """S-3: all artists by name, then id (range-partitioned global sort)."""
    return artists.select("name", "artist_id").orderBy(
        F.col("name").asc_nulls_last(), F.col("artist_id").asc())


def page_count(albums: DataFrame, artists: DataFrame, scope: str, q: str | None = None
               ) -> DataFrame:
    """A-2: number of pages of 8, four forms.  Without a search the album
    count covers every album, even one with no artist (as the reference)."""
    if scope == "albums":
        df = albums if q is None else albums_with_artist(albums, artists, q)
        n = F.count("album_id")
    elif scope == "artists":
        df = artists if q is None else search_artists(artists, q)
        n = F.count("artist_id")
    else:
        raise ValueError("scope must be albums or artists")
    return df.agg(F.ceil(n / F.lit(float(PAGE_SIZE))).cast("bigint").alias("pages"))


def page_manifest(df: DataFrame, order: list[Column], id_col: str) -> DataFrame:
    """S-5: page 1..n with the first and last id of each page, positions
    computed without a single-partition window."""
    pos = global_positions(df.select(id_col, *[c for c in df.columns if c != id_col]),
                           order, "pos")
    return (pos.groupBy(F.ceil(F.col("pos") / F.lit(float(PAGE_SIZE))).cast("bigint")
                        .alias("page"))
            .agg(F.min_by(id_col, "pos").alias("first_id"),
                 F.max_by(id_col, "pos").alias("last_id"),
                 F.count(F.lit(1)).alias("rows")))


def artists_by_name(artists: DataFrame, names: DataFrame, name_col: str = "name"
                    ) -> DataFrame:
    """PF-4: artist ids for a table of names, matched case-insensitively."""
    n = names.select(F.lower(F.col(name_col)).alias("_k"), F.col(name_col).alias("asked")) \
        .distinct()
    a = artists.select(F.lower("name").alias("_k"), "artist_id")
    return n.join(a, "_k").select("asked", "artist_id")


def artist_short(artists: DataFrame, ids: DataFrame) -> DataFrame:
    """PF-8: short (admin) record for the requested artist ids."""
    return artists.join(ids.select("artist_id"), "artist_id", "left_semi") \
        .select("artist_id", "name", "bio")


def _album_item() -> Column:
    return F.struct(F.col("album_id"), F.col("artist_id"), F.col("title"),
                    F.col("name"), F.col("release_year"), F.col("photo"),
                    F.col("stock"), money("price").alias("price"))


def artist_with_albums(artists: DataFrame, albums: DataFrame,
                       ids: DataFrame | None = None) -> DataFrame:
    """A-9/J-5: artist document: name, bio and its albums ordered by id,
    ``[]`` for an artist without albums.  Albums are grouped per artist
    first (A-18), then left-joined, so artist rows are never multiplied."""
    a = artists if ids is None else artists.join(ids.select("artist_id"), "artist_id",
                                                 "left_semi")
    names = a.select("artist_id", "name")
    per = nest_children(albums.join(names, "artist_id"), ["artist_id"], _album_item(), "albums")
    return (a.join(per, "artist_id", "left")
            .select("artist_id", "name", "bio",
                    F.coalesce("albums", F.array().cast(per.schema["albums"].dataType))
                    .alias("albums")))


def album_detail(albums: DataFrame, artists: DataFrame, songs: DataFrame,
                 ids: DataFrame | None = None) -> DataFrame:
    """A-8: album document with its songs ordered by track.  An album needs
    an artist and at least one song (inner joins, as the reference)."""
    a = albums if ids is None else albums.join(ids.select("album_id"), "album_id",
                                               "left_semi")
    tracks = nest_children(songs, ["album_id"], F.struct("track", "song", "duration"), "songs")
    return (a.join(artists.select("artist_id", "name"), "artist_id")
            .join(tracks, "album_id")
            .select("album_id", "artist_id", "name", "title", "release_year", "photo",
                    "stock", money("price").alias("price"), "songs"))


def song_listing(songs: DataFrame) -> DataFrame:
    """F-3 job: durations shown as ``m:ss`` / ``mm:ss``."""
    return songs.select("album_id", "track", "song",
                        F.when(F.col("duration").isNotNull(),
                               format_duration("duration")).alias("length"))


def album_links(albums: DataFrame, artists: DataFrame) -> DataFrame:
    """F-11 job: URL slugs of artist and album for every listed album."""
    return (albums.join(artists.select("artist_id", "name"), "artist_id")
            .select("album_id", F.concat(F.lit("/artist/"), url_slug("name"), F.lit("/"),
                                         url_slug("title")).alias("link")))


def match_previews(albums: DataFrame, artists: DataFrame, songs: DataFrame,
                   ext_albums: DataFrame, ext_tracks: DataFrame) -> DataFrame:
    """J-15: previews from an outside catalogue: the first outside album
    (lowest id) equal in lower-case title and artist, then its track at the
    same position; songs keep a NULL preview when nothing matches."""
    mine = (albums.join(artists.select("artist_id", "name"), "artist_id")
            .select("album_id", F.lower("title").alias("_t"), F.lower("name").alias("_a")))
    # First outside album per (title, artist) before the join: one match per
    # album however many outside copies share the key.
    ext = (ext_albums.groupBy(F.lower("title").alias("_t"), F.lower("artist").alias("_a"))
           .agg(F.min("ext_album_id").alias("ext_album_id")))
    first = mine.join(ext, ["_t", "_a"]).select("album_id", "ext_album_id")
    tracks = ext_tracks.select("ext_album_id", F.col("position").alias("track"), "preview")
    return (songs.join(first, "album_id", "left")
            .join(tracks, ["ext_album_id", "track"], "left")
            .select("album_id", "track", "song", "preview"))
