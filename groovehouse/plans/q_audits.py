"""Audit queries: C-1..C-5 over the ten shop tables as a load with faults gives them, C-6
over the clean tables."""

from __future__ import annotations

from ..operators import audits as au
from .registry import register

PK = {
    "albums": ["album_id"], "artists": ["artist_id"], "cart": ["user_id", "album_id"],
    "dispatches": ["dispatch_id"], "orders_h": ["order_id"],
    "orders_bridge": ["order_id", "album_id"],
    "purchase_order_lines": ["line", "purchase_order"],
    "purchase_orders": ["purchase_order"], "songs": ["track", "album_id"],
    "users": ["user_id"],
}


#: Tables with faults, by their name among the views.
LOADED = {t: f"{t}_in" for t in ("albums", "users", "cart", "purchase_orders", "dispatches", "songs")}


def _in(table: str) -> str:
    return LOADED.get(table, table)


def _key(cols):
    return " || ',' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in cols)


def _pk_sql() -> str:
    parts = []
    for t, keys in PK.items():
        k = ", ".join(keys)
        nul = " OR ".join(f"{c} IS NULL" for c in keys)
        parts.append(f"SELECT '{t}' AS \"table\", {_key(keys)} AS key, 'null key' AS problem, "
                     f"count(*) AS rows FROM {_in(t)} WHERE {nul} GROUP BY {k}")
        parts.append(f"SELECT '{t}', {_key(keys)}, 'repeated key', count(*) FROM {_in(t)} "
                     f"WHERE NOT ({nul}) GROUP BY {k} HAVING count(*) > 1")
    return "\nUNION ALL\n".join(parts)


FK = [("albums", "artist_id", "artists", "artist_id"), ("cart", "user_id", "users", "user_id"),
      ("cart", "album_id", "albums", "album_id"),
      ("dispatches", "purchase_order", "purchase_orders", "purchase_order"),
      ("orders_h", "user_id", "users", "user_id"),
      ("orders_bridge", "order_id", "orders_h", "order_id"),
      ("orders_bridge", "album_id", "albums", "album_id"),
      ("purchase_order_lines", "purchase_order", "purchase_orders", "purchase_order"),
      ("purchase_order_lines", "album_id", "albums", "album_id"),
      ("songs", "album_id", "albums", "album_id")]


def _fk_sql() -> str:
    parts = []
    for child, col, parent, pcol in FK:
        parts.append(
            f"SELECT '{child}' AS child, '{col}' AS \"column\", '{parent}' AS parent, "
            f"CAST({col} AS VARCHAR) AS value, count(*) AS rows FROM {_in(child)} "
            f"WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {pcol} FROM {_in(parent)} "
            f"WHERE {pcol} IS NOT NULL) GROUP BY {col}")
    return "\nUNION ALL\n".join(parts)


@register("audit_primary_keys", _pk_sql())
def audit_primary_keys(s):
    return au.audit_primary_keys(s.loaded_tables())


@register("audit_foreign_keys", _fk_sql())
def audit_foreign_keys(s):
    return au.audit_foreign_keys(s.loaded_tables())


@register("audit_checks", """
SELECT 'albums' AS "table", CAST(album_id AS VARCHAR) AS key, 'stock' AS "column",
       CAST(stock AS VARCHAR) AS value FROM albums_in WHERE stock < 0
UNION ALL
SELECT 'dispatches', dispatch_id, 'status', status FROM dispatches_in
WHERE status NOT IN ('received', 'pending-supplier', 'shipped', 'rescheduled')
UNION ALL
SELECT 'purchase_orders', CAST(purchase_order AS VARCHAR), 'status', status FROM purchase_orders_in
WHERE status NOT IN ('pending-supplier', 'pending-buyer', 'confirmed')
UNION ALL
SELECT 'users', CAST(user_id AS VARCHAR), 'role', role FROM users_in
WHERE role NOT IN ('user', 'admin')""")
def audit_checks(s):
    return au.audit_checks(s.loaded_tables())


@register("audit_unique", """
SELECT username, count(*) AS rows FROM users_in WHERE username IS NOT NULL
GROUP BY username HAVING count(*) > 1""")
def audit_unique(s):
    return au.audit_unique(s.loaded_tables()["users"])


@register("audit_input", """
WITH n AS (SELECT album_id, count(*) AS n FROM songs GROUP BY album_id)
SELECT 'album' AS entity, CAST(album_id AS VARCHAR) AS id, 'title length' AS rule FROM albums
WHERE coalesce(length(title), 0) < 1
UNION ALL SELECT 'album', CAST(album_id AS VARCHAR), 'release year' FROM albums
WHERE NOT coalesce(release_year BETWEEN 1970 AND 2025, false)
UNION ALL SELECT 'album', CAST(album_id AS VARCHAR), 'price format' FROM albums
WHERE NOT coalesce(regexp_full_match(CAST(price AS VARCHAR), '[0-9]?[0-9].[0-9]{2}'), false)
UNION ALL SELECT 'album', CAST(a.album_id AS VARCHAR), 'track count' FROM albums a
LEFT JOIN n ON n.album_id = a.album_id WHERE NOT coalesce(n.n, 0) BETWEEN 1 AND 20
UNION ALL SELECT 'song', CAST(album_id AS VARCHAR) || ',' || CAST(track AS VARCHAR),
       'duration format' FROM songs
WHERE duration IS NOT NULL AND NOT regexp_full_match(
      printf('%d:%02d', (duration % 3600) // 60, duration % 60), '[0-9]{1,2}:[0-9]{2}')
UNION ALL SELECT 'artist', CAST(artist_id AS VARCHAR), 'name length' FROM artists
WHERE coalesce(length(name), 0) < 4
UNION ALL SELECT 'artist', CAST(artist_id AS VARCHAR), 'bio length' FROM artists
WHERE coalesce(length(bio), 0) < 10
UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), 'username length' FROM users
WHERE NOT coalesce(length(username) BETWEEN 5 AND 20, false)""")
def audit_input(s):
    return au.audit_input(s.albums, s.artists, s.songs, s.users)
