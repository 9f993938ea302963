"""Integrity audits: declared constraints as jobs returning violating rows.

IDs: C-1..C-6.  Every audit is a union of per-table scans and grouped counts
(partial aggregation), returning one row per violation.  Keys are counted as they
are typed: text of every key would make the groups of a task several times larger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import format_duration
from ..schemas import (DISPATCH_STATUSES, FOREIGN_KEYS, ORDER_STATUSES, PRIMARY_KEYS,
                       USER_ROLES)

# Fixed values of the reference's form rules (C-6).
YEAR_MIN, YEAR_MAX = 1970, 2025
PRICE_PATTERN = r"^(?:[0-9]?[0-9].[0-9]{2})$"
DURATION_PATTERN = r"^(?:[0-9]{1,2}:[0-9]{2})$"
TITLE_MIN, ARTIST_MIN, BIO_MIN = 1, 4, 10
USERNAME_MIN, USERNAME_MAX = 5, 20
TRACKS_MIN, TRACKS_MAX = 1, 20


def _key_text(cols: list[str]) -> Column:
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
                              for c in cols])


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def audit_primary_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """C-1: (table, key, problem, rows): NULL key parts or repeated keys.  The rows of
    each table are counted by the typed key, eight bytes a column; only keys with a
    problem are turned to text."""
    found = []
    for name, keys in PRIMARY_KEYS.items():
        null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
        counts = tables[name].groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        found.append(counts.where((F.col("rows") > 1) | null).select(
            F.lit(name).alias("table"), _key_text(keys).alias("key"),
            F.when(null, "null key").otherwise("repeated key").alias("problem"), "rows"))
    return _union(found)


def audit_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """C-2: (child, column, parent, value, rows) for references to a missing
    parent; a NULL reference is allowed.  Per foreign key, the child's references are
    counted by value before they meet the keys of the parent; only values that are
    missing are turned to text."""
    found = []
    for child, cols, parent, pcols, _rule in FOREIGN_KEYS:
        given = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        counts = tables[child].where(given).groupBy(*cols).agg(F.count(F.lit(1)).alias("rows"))
        have = tables[parent].select(*[F.col(p).alias(c) for p, c in zip(pcols, cols, strict=True)])
        found.append(counts.join(have, cols, "left_anti").select(
            F.lit(child).alias("child"), F.lit(",".join(cols)).alias("column"),
            F.lit(parent).alias("parent"), _key_text(cols).alias("value"), "rows"))
    return _union(found)


def audit_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """C-3/C-4: (table, key, column, value): negative stock, statuses and
    roles outside their lists (NULL passes, as a CHECK does)."""
    t = tables

    def bad(name: str, col: str, cond: Column) -> DataFrame:
        keys = PRIMARY_KEYS[name]
        return t[name].filter(cond).select(
            F.lit(name).alias("table"), _key_text(keys).alias("key"),
            F.lit(col).alias("column"), F.col(col).cast("string").alias("value"))

    return _union([
        bad("albums", "stock", F.col("stock") < 0),
        bad("dispatches", "status", ~F.col("status").isin(*DISPATCH_STATUSES)),
        bad("purchase_orders", "status", ~F.col("status").isin(*ORDER_STATUSES)),
        bad("users", "role", ~F.col("role").isin(*USER_ROLES)),
    ])


def audit_unique(users: DataFrame) -> DataFrame:
    """C-5: usernames held by more than one user."""
    return (users.filter(F.col("username").isNotNull()).groupBy("username")
            .agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1))


def audit_input(albums: DataFrame, artists: DataFrame, songs: DataFrame, users: DataFrame
                ) -> DataFrame:
    """C-6: form rules as (entity, id, rule) rows, one per broken rule.  Each
    table is read once: every row gets the array of the rules it breaks,
    which is exploded."""
    def broken(df: DataFrame, entity: str, id_col: Column, rules: list[tuple[str, Column]]
               ) -> DataFrame:
        names = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules])
        return (df.select(F.lit(entity).alias("entity"), id_col.cast("string").alias("id"),
                          F.explode(F.array_compact(names)).alias("rule")))

    tracks = songs.groupBy("album_id").agg(F.count(F.lit(1)).alias("_n"))
    dur = format_duration("duration")
    return _union([
        broken(albums.join(tracks, "album_id", "left"), "album", F.col("album_id"), [
            ("title length", F.coalesce(F.length("title"), F.lit(0)) < TITLE_MIN),
            ("release year", ~F.coalesce(F.col("release_year").between(YEAR_MIN, YEAR_MAX),
                                         F.lit(False))),
            ("price format", ~F.coalesce(F.col("price").cast("string").rlike(PRICE_PATTERN),
                                         F.lit(False))),
            ("track count", ~F.coalesce(F.col("_n"), F.lit(0)).between(TRACKS_MIN, TRACKS_MAX)),
        ]),
        broken(songs.filter(F.col("duration").isNotNull()), "song",
               F.concat_ws(",", F.col("album_id").cast("string"), F.col("track").cast("string")),
               [("duration format", ~dur.rlike(DURATION_PATTERN))]),
        broken(artists, "artist", F.col("artist_id"), [
            ("name length", F.coalesce(F.length("name"), F.lit(0)) < ARTIST_MIN),
            ("bio length", F.coalesce(F.length("bio"), F.lit(0)) < BIO_MIN),
        ]),
        broken(users, "user", F.col("user_id"), [
            ("username length", ~F.coalesce(F.length("username").between(USERNAME_MIN,
                                                                         USERNAME_MAX),
                                            F.lit(False))),
        ]),
    ])
