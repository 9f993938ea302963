"""DuckDB twins of ``groovehouse.sources.fixtures`` for the oracle SQL.

``with_views(body)`` prepends exactly the CTEs the body references (and
their dependencies), so every oracle query is one self-contained statement
over the driver's pre-registered raw tables.
"""

from __future__ import annotations

import re

D0 = "TIMESTAMP '2024-01-01 00:00:00'"
AT = "TIMESTAMP '2024-06-01 00:00:00'"


def _days(expr: str) -> str:
    return f"to_days(CAST({expr} AS INTEGER))"


VIEWS: dict[str, str] = {
    "artists": f"""SELECT CAST(s_suppkey AS BIGINT) AS artist_id, s_name AS name,
        'nation ' || CAST(s_nationkey AS VARCHAR) AS bio,
        {D0} + {_days('s_suppkey % 50')} AS modified FROM supplier""",
    "albums": f"""SELECT CAST(p_partkey AS BIGINT) AS album_id, p_name AS title,
        CAST(1970 + p_size AS BIGINT) AS release_year, CAST(p_size % 11 AS BIGINT) AS stock,
        CAST(p_retailprice AS DECIMAL(10,2)) AS price,
        replace(p_name, ' ', '-') || '.jpg' AS photo,
        CAST(CASE WHEN p_partkey % 41 = 40 THEN NULL ELSE p_partkey % 41 END AS BIGINT) AS artist_id,
        {D0} + {_days('p_partkey % 365')} AS modified FROM part""",
    "users": f"""SELECT CAST(c_custkey AS BIGINT) AS user_id,
        CASE WHEN c_custkey % 100 = 0 THEN 'admin' ELSE 'user' END AS role,
        c_name AS username, {D0} + {_days('c_custkey % 365')} AS created FROM customer""",
    "orders_h": """SELECT CAST(o_orderkey AS BIGINT) AS order_id, CAST(o_custkey AS BIGINT) AS user_id,
        CAST(o_orderdate AS TIMESTAMP) AS dispatched FROM orders""",
    "orders_bridge": """SELECT l_orderkey AS order_id, l_partkey AS album_id,
        CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "cart_events": """SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS album_id,
        CAST(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS BIGINT) AS delta
        FROM events WHERE event_type IN ('click', 'view', 'error')""",
    "cart": """SELECT user_id, album_id, CAST(sum(delta) AS BIGINT) AS quantity FROM cart_events
        GROUP BY user_id, album_id HAVING sum(delta) > 0""",
    "purchase_orders": """SELECT CAST(o_orderkey AS BIGINT) AS purchase_order,
        CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending-supplier'
             WHEN 'P' THEN 'pending-buyer' END AS status,
        CAST(o_orderdate AS TIMESTAMP) AS modified,
        CAST((o_orderkey % 5000) / 100.0 AS DECIMAL(6,2)) AS shipping_cost,
        CASE WHEN o_orderkey % 50 = 0 THEN NULL
             ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 14 DAY END AS estimated_receipt
        FROM orders""",
    "purchase_order_lines": """SELECT CAST(l_orderkey AS BIGINT) AS purchase_order,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
             l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS line,
        CAST(l_partkey AS BIGINT) AS album_id, CAST(l_quantity AS BIGINT) AS quantity,
        CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL
             WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) - 1
             ELSE CAST(l_quantity AS BIGINT) END AS confirmed_quantity,
        CAST(l_extendedprice AS DECIMAL(12,2)) AS line_total FROM lineitem""",
    "dispatches": """SELECT 'd-' || CAST(o_orderkey AS VARCHAR) AS dispatch_id,
        CAST(o_orderkey AS BIGINT) AS purchase_order,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'received' WHEN '2' THEN 'shipped'
             WHEN '3' THEN 'rescheduled' ELSE 'pending-supplier' END AS status,
        'dock ' || CAST(o_orderkey % 7 AS VARCHAR) AS address
        FROM orders WHERE o_orderstatus = 'F'""",
    "songs": """SELECT CAST(conv_id AS BIGINT) AS album_id, CAST(turn + 1 AS BIGINT) AS track,
        CAST(CASE WHEN turn = 7 THEN NULL ELSE length(text) END AS BIGINT) AS duration,
        text AS song FROM conversations""",
    # ---- change and message inputs
    "new_lines": """SELECT purchase_order, line, album_id,
            CASE WHEN line = 1 THEN quantity + 1 ELSE quantity END AS quantity,
            confirmed_quantity, line_total
        FROM purchase_order_lines WHERE line <> 2
        UNION ALL
        SELECT purchase_order, CAST(99 AS BIGINT) AS line,
            CAST(purchase_order % (SELECT count(*) FROM part) AS BIGINT) AS album_id,
            CAST(1 AS BIGINT) AS quantity, CAST(NULL AS BIGINT) AS confirmed_quantity,
            CAST(10 AS DECIMAL(12,2)) AS line_total
        FROM purchase_orders WHERE status = 'pending-buyer'""",
    "new_songs": """SELECT album_id, track, duration,
            CASE WHEN track = 1 THEN song || ' (live)' ELSE song END AS song
        FROM songs WHERE track <> 3
        UNION ALL
        SELECT DISTINCT album_id, CAST(20 AS BIGINT), CAST(200 AS BIGINT), 'bonus track'
        FROM songs WHERE album_id % 2 = 0""",
    "artist_patch": """SELECT artist_id,
            CASE WHEN (artist_id // 3) % 2 = 0 THEN upper(name) END AS name,
            CASE WHEN (artist_id // 3) % 2 = 1 THEN bio || ' (rev)' END AS bio
        FROM artists WHERE artist_id % 3 = 0""",
    "album_patch": """SELECT album_id,
            CASE WHEN (album_id // 3) % 5 = 0 THEN upper(title) END AS title,
            CASE WHEN (album_id // 3) % 5 = 1 THEN release_year + 1 END AS release_year,
            CASE WHEN (album_id // 3) % 5 = 2 THEN CAST(price + 1 AS DECIMAL(10,2)) END AS price,
            CASE WHEN (album_id // 3) % 5 = 3 THEN (artist_id + 1) % 40 END AS artist_id,
            CASE WHEN (album_id // 3) % 5 = 4 THEN 'new-' || photo END AS photo
        FROM albums WHERE album_id % 3 = 0""",
    "confirmation_rows": """SELECT l.purchase_order, l.line, l.album_id,
            l.quantity - CASE WHEN l.line % 3 = 0 THEN 1 ELSE 0 END AS confirmed
        FROM purchase_order_lines l
        WHERE l.purchase_order IN (SELECT purchase_order FROM purchase_orders
                                   WHERE status = 'pending-supplier')""",
    "dispatch_msgs": """SELECT purchase_order * 3 AS seq, 'note' AS kind,
            'n-' || CAST(purchase_order AS VARCHAR) AS dispatch_id, purchase_order,
            'pending-supplier' AS status, 'dock ' || CAST(purchase_order % 7 AS VARCHAR) AS address,
            CAST(NULL AS TIMESTAMP) AS estimated_delivery
        FROM purchase_orders WHERE status = 'pending-buyer' AND purchase_order % 3 = 0
        UNION ALL
        SELECT d.purchase_order * 3 + 1, 'update', d.dispatch_id, CAST(NULL AS BIGINT), 'shipped',
            CAST(NULL AS VARCHAR), CAST(o.o_orderdate AS TIMESTAMP) + INTERVAL 20 DAY
        FROM dispatches d JOIN orders o ON o.o_orderkey = d.purchase_order
        UNION ALL
        SELECT d.purchase_order * 3 + 2, 'update', d.dispatch_id, CAST(NULL AS BIGINT),
            'rescheduled', CAST(NULL AS VARCHAR), CAST(o.o_orderdate AS TIMESTAMP) + INTERVAL 27 DAY
        FROM dispatches d JOIN orders o ON o.o_orderkey = d.purchase_order
        WHERE d.purchase_order % 4 = 0""",
    "draft_events": """SELECT event_id, ts, user_id AS purchase_order, album_id, delta
        FROM cart_events""",
    "receipt_requests": """SELECT dispatch_id FROM dispatches WHERE purchase_order % 2 = 0""",
    "checkout_requests": """SELECT user_id FROM users WHERE user_id % 2 = 0""",
    "ext_albums": """SELECT a.album_id + 1000000 AS ext_album_id, a.album_id AS src_album_id,
            upper(a.title) AS title, upper(r.name) AS artist
        FROM albums a LEFT JOIN artists r ON r.artist_id = a.artist_id WHERE a.album_id % 3 = 0
        UNION ALL
        SELECT a.album_id + 2000000, a.album_id, upper(a.title), upper(r.name)
        FROM albums a LEFT JOIN artists r ON r.artist_id = a.artist_id WHERE a.album_id % 6 = 0""",
    "ext_tracks": """SELECT e.ext_album_id, s.track AS position,
            'p-' || CAST(e.ext_album_id AS VARCHAR) || '-' || CAST(s.track AS VARCHAR) AS preview
        FROM ext_albums e JOIN songs s ON s.album_id = e.src_album_id""",
    "form_fields": """SELECT 'po-' || CAST(purchase_order AS VARCHAR) AS form_id,
            k.key, k.value
        FROM (SELECT l.*, a.artist_id, a.title, r.name FROM purchase_order_lines l
              LEFT JOIN albums a ON a.album_id = l.album_id
              LEFT JOIN artists r ON r.artist_id = a.artist_id) pl, LATERAL (VALUES
            ('artist_id_' || CAST(line AS VARCHAR), ' ' || CAST(artist_id AS VARCHAR) || ' '),
            ('name_' || CAST(line AS VARCHAR), ' ' || name || ' '),
            ('title_' || CAST(line AS VARCHAR), ' ' || title || ' '),
            ('album_id_' || CAST(line AS VARCHAR), ' ' || CAST(album_id AS VARCHAR) || ' '),
            ('quantity_' || CAST(line AS VARCHAR), ' ' || CAST(quantity AS VARCHAR) || ' '),
            ('line_total_' || CAST(line AS VARCHAR), ' ' || CAST(line_total AS VARCHAR) || ' ')
        ) AS k(key, value)
        UNION ALL
        SELECT 'album-' || CAST(album_id AS VARCHAR), k.key, k.value
        FROM songs, LATERAL (VALUES
            ('track_' || CAST(track AS VARCHAR), ' ' || CAST(track AS VARCHAR) || ' '),
            ('song_' || CAST(track AS VARCHAR), ' ' || song || ' '),
            ('duration_' || CAST(track AS VARCHAR),
             CASE WHEN duration IS NULL THEN ' '
                  ELSE ' ' || printf('%d:%02d', duration // 60, duration % 60) || ' ' END)
        ) AS k(key, value)""",
    "allow_list": """SELECT string_agg(username || ':' || role, ',' ORDER BY user_id) AS allow
        FROM users GROUP BY user_id // 100""",
    "albums_in": """SELECT * FROM albums
        UNION ALL SELECT * REPLACE (CAST(NULL AS BIGINT) AS album_id) FROM albums WHERE album_id % 60 = 11
        UNION ALL SELECT * FROM albums WHERE album_id % 50 = 7
        UNION ALL SELECT * REPLACE (album_id + 10000000 AS album_id, -1 - stock AS stock,
                                    artist_id + 1000000 AS artist_id) FROM albums WHERE album_id % 40 = 3""",
    "users_in": """SELECT * FROM users UNION ALL
        SELECT * REPLACE (user_id + 10000000 AS user_id, 'owner' AS role) FROM users WHERE user_id % 30 = 1""",
    "cart_in": """SELECT * FROM cart
        UNION ALL SELECT * REPLACE (user_id + 20000000 AS user_id) FROM cart WHERE user_id % 20 = 2
        UNION ALL SELECT * FROM cart WHERE album_id % 30 = 4""",
    "purchase_orders_in": """SELECT * FROM purchase_orders UNION ALL
        SELECT * REPLACE (purchase_order + 10000000 AS purchase_order, 'lost' AS status)
        FROM purchase_orders WHERE purchase_order % 70 = 0""",
    "dispatches_in": """SELECT * FROM dispatches UNION ALL
        SELECT * REPLACE (dispatch_id || '-x' AS dispatch_id, purchase_order + 30000000 AS purchase_order,
                          'gone' AS status) FROM dispatches WHERE purchase_order % 25 = 0""",
    "songs_in": """SELECT * FROM songs UNION ALL
        SELECT * REPLACE (album_id + 30000000 AS album_id) FROM songs WHERE album_id % 45 = 0""",
}

_ORDER = list(VIEWS)


def _refs(sql: str) -> set[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
    return {v for v in VIEWS if v in words}


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs it needs, in dependency order."""
    need: set[str] = set()
    todo = list(_refs(body))
    while todo:
        v = todo.pop()
        if v in need:
            continue
        need.add(v)
        todo.extend(_refs(VIEWS[v]) - need - {v})
    if not need:
        return body
    ordered = [v for v in _ORDER if v in need]
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in ordered)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
