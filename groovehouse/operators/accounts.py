"""Accounts: users, carts, orders and the account document.

IDs: PF-6, PF-7, J-3, J-4, J-7, A-4, A-6, A-7, A-10..12, F-6, F-7, F-13.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import activity_text, item_label, money, ts_text
from .nesting import nest_children, number_items

# Fixed texts of the reference's availability messages.
MSG_IN_CART = " of these albums are in your cart."
MSG_OUT = "no albums in stock. we will replenish this soon."
MSG_SIGN_IN = "Sign in to add this album to your cart"


def user_accounts(users: DataFrame, names: DataFrame, shape: str = "owner") -> DataFrame:
    """PF-6: account lookup by username: ``owner`` gives the id, ``profile``
    gives username, created and role (the password is never read)."""
    j = users.join(names.select("username"), "username", "left_semi")
    if shape == "owner":
        return j.select("username", "user_id")
    if shape == "profile":
        return j.select("username", ts_text("created").alias("created"), "role")
    raise ValueError("shape must be owner or profile")


def cart_presence(cart: DataFrame, pairs: DataFrame) -> DataFrame:
    """PF-7: 1 if the (user, album) pair is in the cart, else 0."""
    c = cart.select("user_id", "album_id", F.lit(1).alias("_one"))
    return (pairs.select("user_id", "album_id").join(c, ["user_id", "album_id"], "left")
            .select("user_id", "album_id",
                    F.coalesce("_one", F.lit(0)).cast("bigint").alias("in_cart")))


def _items(lines: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    # Artists meet the albums, not the lines: few artists hold many lines.
    named = albums.select("album_id", "artist_id", "photo", "title", "price").join(
        artists.select("artist_id", F.col("name").alias("artist")), "artist_id")
    return lines.join(named, "album_id")


def cart_items(cart: DataFrame, albums: DataFrame, artists: DataFrame, users: DataFrame
               ) -> DataFrame:
    """J-4 + F-6: cart lines with album, artist and user; item label."""
    j = _items(cart, albums, artists).join(users.select("user_id", "username"), "user_id")
    return j.select("user_id", "username", "artist_id", "album_id", "photo", "title",
                    "artist", "quantity", money("price").alias("price"),
                    item_label("artist", "title", "price", "quantity").alias("label"))


def cart_balance(cart: DataFrame, albums: DataFrame, artists: DataFrame, users: DataFrame
                 ) -> DataFrame:
    """A-6: cart balance per user (sum of quantity x price)."""
    j = _items(cart, albums, artists).join(users.select("user_id"), "user_id")
    return j.groupBy("user_id").agg(money(F.sum(F.col("quantity") * F.col("price")))
                                    .alias("balance"))


def order_history(orders: DataFrame, bridge: DataFrame, albums: DataFrame,
                  artists: DataFrame, users: DataFrame) -> DataFrame:
    """J-3: order items with album, artist and user."""
    j = (_items(bridge, albums, artists).join(orders, "order_id")
         .join(users.select("user_id", "username"), "user_id"))
    return j.select("user_id", "username", "order_id",
                    ts_text("dispatched").alias("dispatched"), "artist_id", "album_id",
                    "photo", "title", "artist", "quantity", money("price").alias("price"))


def order_balance(orders: DataFrame, bridge: DataFrame, albums: DataFrame,
                  artists: DataFrame, users: DataFrame) -> DataFrame:
    """A-6: balance per order."""
    j = (_items(bridge, albums, artists).join(orders, "order_id")
         .join(users.select("user_id"), "user_id"))
    return j.groupBy("order_id").agg(money(F.sum(F.col("quantity") * F.col("price")))
                                     .alias("balance"))


def _album_entry() -> F.Column:
    return F.struct("album_id", "artist_id", "photo", "title", "artist", "quantity",
                    money("price").alias("price"))


def _balance() -> F.Column:
    return money(F.sum(F.col("quantity") * F.col("price"))).alias("balance")


def order_documents(orders: DataFrame, bridge: DataFrame, albums: DataFrame,
                    artists: DataFrame, users: DataFrame) -> DataFrame:
    """A-10: per user an array of orders (by id), each with its balance and
    albums; ``[]`` for a user without orders.  Two nesting stages: items and
    their sum per order, then orders per user."""
    items = _items(bridge, albums, artists).join(orders, "order_id")
    per_order = nest_children(items, ["user_id", "order_id", "dispatched"], _album_entry(), "albums", [_balance()])
    per_user = nest_children(per_order, ["user_id"], F.struct(
        "order_id", ts_text("dispatched").alias("dispatched"), "balance", "albums"), "orders")
    empty = F.array().cast(per_user.schema["orders"].dataType)
    return (users.select("user_id", "username").join(per_user, "user_id", "left")
            .select("user_id", "username", F.coalesce("orders", empty).alias("orders")))


def order_item_rows(orders: DataFrame, bridge: DataFrame, albums: DataFrame,
                    artists: DataFrame) -> DataFrame:
    """A-10 as a flat table: one row per order item with its number in the order (by
    album id), for orders and users of any size."""
    items = _items(bridge, albums, artists).join(orders.select("order_id", "user_id"), "order_id")
    return number_items(items.select("user_id", "order_id", "album_id", "title", "artist", "quantity",
                                     money("price").alias("price")), ["order_id"], ["album_id"], bound=bridge)


def cart_documents(cart: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    """A-11 part: per user with a cart: balance and albums (by album id)."""
    return nest_children(_items(cart, albums, artists), ["user_id"], _album_entry(), "albums", [_balance()])


def account_document(users: DataFrame, cart: DataFrame, orders: DataFrame,
                     bridge: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    """A-11: account document: cart (balance and albums, both NULL for an
    empty cart, as an aggregate over no rows gives) beside the orders."""
    carts = cart_documents(cart, albums, artists)
    docs = order_documents(orders, bridge, albums, artists, users)
    return docs.join(carts, "user_id", "left").select(
        "user_id", "username", F.struct("balance", "albums").alias("cart"), "orders")


def cart_count(cart: DataFrame, users: DataFrame, pairs: DataFrame) -> DataFrame:
    """A-7: cart quantity of an album for a username, 0 if none.
    ``pairs``: (username, album_id)."""
    c = cart.join(users.select("user_id", "username"), "user_id").select(
        "username", "album_id", "quantity")
    return (pairs.select("username", "album_id").join(c, ["username", "album_id"], "left")
            .groupBy("username", "album_id")
            .agg(F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("cart")))


def user_activity(users: DataFrame, orders: DataFrame, cart: DataFrame) -> DataFrame:
    """J-7/A-4 + F-13: distinct orders and cart albums per user.  Each side
    is counted per user first, so the two left joins never multiply rows."""
    o = orders.groupBy("user_id").agg(F.count_distinct("order_id").alias("_o"))
    c = cart.groupBy("user_id").agg(F.count_distinct("album_id").alias("_c"))
    j = users.join(o, "user_id", "left").join(c, "user_id", "left")
    n_o = F.coalesce("_o", F.lit(0)).cast("bigint")
    n_c = F.coalesce("_c", F.lit(0)).cast("bigint")
    return j.select("user_id", "username", ts_text("created").alias("created"),
                    n_o.alias("orders"), n_c.alias("cart"),
                    activity_text(n_o, n_c).alias("summary"))


def checkout_baskets(cart: DataFrame, users: DataFrame) -> DataFrame:
    """A-12: per user with a cart: array of (album_id, quantity)."""
    return nest_children(cart.join(users.select("user_id"), "user_id"), ["user_id"],
                         F.struct("album_id", "quantity"), "albums")


def availability(albums: DataFrame, cart: DataFrame, views: DataFrame) -> DataFrame:
    """F-7: availability message for album views.  ``views``: (user_id,
    album_id) with NULL user for a visitor who is not signed in."""
    c = cart.select("user_id", "album_id", "quantity")
    j = (views.select("user_id", "album_id")
         .join(albums.select("album_id", "stock"), "album_id")
         .join(c, ["user_id", "album_id"], "left"))
    signed = F.col("user_id").isNotNull()
    q = F.coalesce("quantity", F.lit(0))
    msg = (F.when(signed & (q > 0), F.concat(q.cast("string"), F.lit(MSG_IN_CART)))
           .when(signed & (F.col("stock") == 0), F.lit(MSG_OUT))
           .when(~signed & (F.col("stock") > 0), F.lit(MSG_SIGN_IN))
           .when(~signed & (F.col("stock") == 0), F.lit(MSG_OUT)))
    return j.select("user_id", "album_id", "stock", q.cast("bigint").alias("cart"),
                    (signed & (F.col("stock") > 0)).alias("can_buy"), msg.alias("message"))
