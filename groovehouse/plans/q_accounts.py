"""Account queries: PF-6, PF-7, J-3, J-4, J-7, A-4, A-6, A-7, A-10..12, F-6,
F-7, F-13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as acc
from .registry import register

TS = "'%Y-%m-%d %H:%M:%S'"


def _money(c: str) -> str:
    return f"CAST(round({c}, 2) AS DOUBLE)"


def _cents(c):
    return F.round(c * 100).cast("bigint").cast("string")


def _pairs(s):
    return s.cart_events.select("user_id", "album_id").distinct()


ITEMS = """{t} x JOIN albums a ON a.album_id = x.album_id
JOIN artists r ON r.artist_id = a.artist_id"""


@register("user_accounts", f"""
SELECT username, strftime(created, {TS}) AS created, role FROM users""")
def user_accounts(s):
    names = s.users.select("username")
    return acc.user_accounts(s.users, names, "profile")


@register("user_owner", "SELECT username, user_id FROM users")
def user_owner(s):
    names = s.users.select("username")
    return acc.user_accounts(s.users, names, "owner")


@register("cart_presence", """
SELECT p.user_id, p.album_id, CAST(count(c.album_id) AS BIGINT) AS in_cart
FROM (SELECT DISTINCT user_id, album_id FROM cart_events) p
LEFT JOIN cart c ON c.user_id = p.user_id AND c.album_id = p.album_id
GROUP BY p.user_id, p.album_id""")
def cart_presence(s):
    return acc.cart_presence(s.cart, _pairs(s))


@register("cart_count", """
WITH pairs AS (SELECT DISTINCT u.username, e.album_id FROM cart_events e
               JOIN users u ON u.user_id = e.user_id),
c AS (SELECT u.username, c.album_id, c.quantity FROM cart c JOIN users u ON u.user_id = c.user_id)
SELECT p.username, p.album_id, CAST(coalesce(sum(c.quantity), 0) AS BIGINT) AS cart
FROM pairs p LEFT JOIN c ON c.username = p.username AND c.album_id = p.album_id
GROUP BY p.username, p.album_id""")
def cart_count(s):
    pairs = _pairs(s).join(s.users.select("user_id", "username"), "user_id") \
        .select("username", "album_id")
    return acc.cart_count(s.cart, s.users, pairs)


@register("cart_items", f"""
SELECT x.user_id, u.username, a.artist_id, x.album_id, a.photo, a.title, r.name AS artist,
       x.quantity, {_money('a.price')} AS price,
       r.name || ' - ' || a.title || ', ' || CAST(a.price AS VARCHAR) || ' x ' ||
       CAST(x.quantity AS VARCHAR) || ' = ' ||
       CAST(CAST(a.price * x.quantity AS DECIMAL(14,2)) AS VARCHAR) AS label
FROM {ITEMS.format(t='cart')} JOIN users u ON u.user_id = x.user_id""")
def cart_items(s):
    return acc.cart_items(s.cart, s.albums, s.artists, s.users)


@register("cart_balance", f"""
SELECT x.user_id, {_money('sum(x.quantity * a.price)')} AS balance
FROM {ITEMS.format(t='cart')} JOIN users u ON u.user_id = x.user_id GROUP BY x.user_id""")
def cart_balance(s):
    return acc.cart_balance(s.cart, s.albums, s.artists, s.users)


@register("order_history", f"""
SELECT o.user_id, u.username, o.order_id, strftime(o.dispatched, {TS}) AS dispatched,
       a.artist_id, x.album_id, a.photo, a.title, r.name AS artist, x.quantity,
       {_money('a.price')} AS price
FROM {ITEMS.format(t='orders_bridge')} JOIN orders_h o ON o.order_id = x.order_id
JOIN users u ON u.user_id = o.user_id""")
def order_history(s):
    return acc.order_history(s.orders_h, s.orders_bridge, s.albums, s.artists, s.users)


@register("order_balance", f"""
SELECT o.order_id, {_money('sum(x.quantity * a.price)')} AS balance
FROM {ITEMS.format(t='orders_bridge')} JOIN orders_h o ON o.order_id = x.order_id
JOIN users u ON u.user_id = o.user_id GROUP BY o.order_id""")
def order_balance(s):
    return acc.order_balance(s.orders_h, s.orders_bridge, s.albums, s.artists, s.users)


ORDER_DOCS = f"""
per_order AS (
  SELECT o.user_id, o.order_id, o.dispatched, sum(x.quantity * a.price) AS balance,
         count(*) AS n_albums,
         string_agg(CAST(x.album_id AS VARCHAR) || 'x' || CAST(x.quantity AS VARCHAR), ','
                    ORDER BY x.album_id) AS albums_text
  FROM {ITEMS.format(t='orders_bridge')} JOIN orders_h o ON o.order_id = x.order_id
  GROUP BY o.user_id, o.order_id, o.dispatched),
per_user AS (
  SELECT user_id, count(*) AS n_orders,
         string_agg(CAST(order_id AS VARCHAR) || '@' || strftime(dispatched, {TS}) || '$' ||
                    CAST(CAST(round(balance * 100) AS BIGINT) AS VARCHAR) || '[' ||
                    albums_text || ']', ';' ORDER BY order_id) AS orders_text
  FROM per_order GROUP BY user_id)"""


def _orders_text(col):
    return F.array_join(F.transform(col, lambda o: F.concat(
        o["order_id"].cast("string"), F.lit("@"), o["dispatched"], F.lit("$"),
        _cents(o["balance"]), F.lit("["),
        F.array_join(F.transform(o["albums"], lambda a: F.concat(
            a["album_id"].cast("string"), F.lit("x"), a["quantity"].cast("string"))), ","),
        F.lit("]"))), ";")


@register("order_documents", f"""
WITH {ORDER_DOCS}
SELECT u.user_id, u.username, CAST(coalesce(p.n_orders, 0) AS BIGINT) AS n_orders,
       coalesce(p.orders_text, '') AS orders_text
FROM users u LEFT JOIN per_user p ON p.user_id = u.user_id""")
def order_documents(s):
    d = acc.order_documents(s.orders_h, s.orders_bridge, s.albums, s.artists, s.users)
    return d.select("user_id", "username", F.size("orders").cast("bigint").alias("n_orders"),
                    _orders_text("orders").alias("orders_text"))


@register("order_item_rows", f"""
SELECT o.user_id, x.order_id, x.album_id, a.title, r.name AS artist, x.quantity, {_money('a.price')} AS price,
       row_number() OVER (PARTITION BY x.order_id ORDER BY x.album_id) AS item
FROM {ITEMS.format(t='orders_bridge')} JOIN orders_h o ON o.order_id = x.order_id""")
def order_item_rows(s):
    return acc.order_item_rows(s.orders_h, s.orders_bridge, s.albums, s.artists)


@register("account_document", f"""
WITH {ORDER_DOCS},
carts AS (SELECT x.user_id, sum(x.quantity * a.price) AS balance,
                 string_agg(CAST(x.album_id AS VARCHAR) || 'x' || CAST(x.quantity AS VARCHAR),
                            ',' ORDER BY x.album_id) AS cart_text
          FROM {ITEMS.format(t='cart')} GROUP BY x.user_id)
SELECT u.user_id, u.username, {_money('c.balance')} AS cart_balance, c.cart_text,
       CAST(coalesce(p.n_orders, 0) AS BIGINT) AS n_orders,
       coalesce(p.orders_text, '') AS orders_text
FROM users u LEFT JOIN per_user p ON p.user_id = u.user_id
LEFT JOIN carts c ON c.user_id = u.user_id""")
def account_document(s):
    d = acc.account_document(s.users, s.cart, s.orders_h, s.orders_bridge, s.albums,
                             s.artists)
    return d.select(
        "user_id", "username", F.col("cart.balance").alias("cart_balance"),
        F.array_join(F.transform("cart.albums", lambda a: F.concat(
            a["album_id"].cast("string"), F.lit("x"), a["quantity"].cast("string"))), ",")
        .alias("cart_text"),
        F.size("orders").cast("bigint").alias("n_orders"),
        _orders_text("orders").alias("orders_text"))


@register("user_activity", f"""
WITH o AS (SELECT user_id, count(DISTINCT order_id) AS n FROM orders_h GROUP BY user_id),
c AS (SELECT user_id, count(DISTINCT album_id) AS n FROM cart GROUP BY user_id)
SELECT u.user_id, u.username, strftime(u.created, {TS}) AS created,
       CAST(coalesce(o.n, 0) AS BIGINT) AS orders, CAST(coalesce(c.n, 0) AS BIGINT) AS cart,
       concat_ws(' ', CASE WHEN coalesce(o.n, 0) > 0
                           THEN CAST(o.n AS VARCHAR) || ' order(s) dispatched.' END,
                      CASE WHEN coalesce(c.n, 0) > 0
                           THEN CAST(c.n AS VARCHAR) || ' albums in cart.' END) AS summary
FROM users u LEFT JOIN o ON o.user_id = u.user_id LEFT JOIN c ON c.user_id = u.user_id""")
def user_activity(s):
    return acc.user_activity(s.users, s.orders_h, s.cart)


@register("checkout_baskets", """
SELECT c.user_id, CAST(count(*) AS BIGINT) AS n_albums,
       string_agg(CAST(c.album_id AS VARCHAR) || 'x' || CAST(c.quantity AS VARCHAR), ','
                  ORDER BY c.album_id) AS basket
FROM cart c JOIN users u ON u.user_id = c.user_id GROUP BY c.user_id""")
def checkout_baskets(s):
    b = acc.checkout_baskets(s.cart, s.users)
    return b.select("user_id", F.size("albums").cast("bigint").alias("n_albums"),
                    F.array_join(F.transform("albums", lambda a: F.concat(
                        a["album_id"].cast("string"), F.lit("x"),
                        a["quantity"].cast("string"))), ",").alias("basket"))


@register("availability", f"""
WITH views AS (SELECT DISTINCT user_id, album_id FROM cart_events
               UNION ALL SELECT CAST(NULL AS BIGINT), album_id FROM albums)
SELECT v.user_id, v.album_id, a.stock, CAST(coalesce(c.quantity, 0) AS BIGINT) AS cart,
       v.user_id IS NOT NULL AND a.stock > 0 AS can_buy,
       CASE WHEN v.user_id IS NOT NULL AND coalesce(c.quantity, 0) > 0
                THEN CAST(coalesce(c.quantity, 0) AS VARCHAR) || '{acc.MSG_IN_CART}'
            WHEN v.user_id IS NOT NULL AND a.stock = 0 THEN '{acc.MSG_OUT}'
            WHEN v.user_id IS NULL AND a.stock > 0 THEN '{acc.MSG_SIGN_IN}'
            WHEN v.user_id IS NULL AND a.stock = 0 THEN '{acc.MSG_OUT}' END AS message
FROM views v JOIN albums a ON a.album_id = v.album_id
LEFT JOIN cart c ON c.user_id = v.user_id AND c.album_id = v.album_id""")
def availability(s):
    views = _pairs(s).unionByName(
        s.albums.select(F.lit(None).cast("bigint").alias("user_id"), "album_id"))
    return acc.availability(s.albums, s.cart, views)
