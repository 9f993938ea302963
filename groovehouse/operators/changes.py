"""Table changes as snapshot transforms (D-*), diffs and key joins.

Each function takes the current table and a table of changes and returns
the new table (plus, where the reference returns rows, a report).  Nothing
is updated in place: callers write the result as a new snapshot (SNK-3).

IDs: PF-9, J-9, J-11..14, J-16, A-16, D-1..23, SRC-3, SRC-5.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import photo_name, stamp, wholesale_total
from ..session import stored_table
from .folds import admit_cart_events, clamped_ledger, fold_draft_quantities  # noqa: F401
# (admit_cart_events is re-exported: D-22 is one of the change workflows)
from .nesting import nest_children
from .positions import assign_ids, rank_within
from .supply import confirmation_status, dispatch_lines, receipt_gate


# ---- generic ---------------------------------------------------------------

def append_rows(table: DataFrame, new: DataFrame, defaults: dict[str, Column] | None = None
                ) -> DataFrame:
    """D-1: append rows; columns missing or NULL take their default."""
    defaults = defaults or {}
    cols = []
    for f in table.schema.fields:
        if f.name in new.columns:
            c = F.col(f.name)
            if f.name in defaults:
                c = F.coalesce(c, defaults[f.name])
        else:
            c = defaults.get(f.name, F.lit(None))
        cols.append(c.cast(f.dataType).alias(f.name))
    return table.unionByName(new.select(*cols))


def last_per_key(changes: DataFrame, keys: list[str], order_col: str | None) -> DataFrame:
    """One change per key: the last by ``order_col`` (a max_by aggregate with
    partial aggregation, so a hot key does not gather in one task).  Without an
    order column repeats of a key collapse too: the largest row counts."""
    others = [c for c in changes.columns if c not in keys]
    if not others:
        return changes.distinct()
    packed = F.struct(*[F.col(c) for c in others])
    order = packed if order_col is None else F.struct(F.col(order_col), packed)
    return (changes.groupBy(*keys).agg(F.max_by(packed, order).alias("_last"))
            .select(*keys, "_last.*"))


def update_by_key(table: DataFrame, changes: DataFrame, keys: list[str], cols: list[str],
                  order_col: str | None = None) -> DataFrame:
    """D-4/D-6: set ``cols`` from ``changes`` where the key matches.  With a
    repeated key the last change by ``order_col`` wins."""
    ch = last_per_key(changes, keys, order_col)
    ch = ch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols],
                   F.lit(True).alias("_hit"))
    j = table.join(ch, keys, "left")
    out = []
    for f in table.schema.fields:
        if f.name in cols:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{f.name}")).otherwise(F.col(f.name))
                       .cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name))
    return j.select(*out)


def patch_rows(table: DataFrame, patch: DataFrame, key: str, stamp_col: str | None = "modified",
               at: str | None = None, order_col: str | None = None) -> DataFrame:
    """D-5/F-15: partial update: a NULL in the patch leaves the column;
    patched rows get the modified stamp ``at``.  Several patches of a key are
    applied in the order of ``order_col``: of each column the last value that is
    not NULL counts.  Without an order column one whole patch of a key counts (the
    largest row), so that no result mixes patches in an unsaid order."""
    cols = [c for c in patch.columns if c not in (key, order_col)]
    if order_col is None:
        patch = last_per_key(patch, [key], None)
    else:
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(order_col), F.col(c)))).alias(c)
                for c in cols]
        patch = patch.groupBy(key).agg(*last) if cols else patch.select(key).distinct()
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = table.join(p, key, "left")
    out = []
    for f in table.schema.fields:
        if f.name in cols:
            c = F.coalesce(F.col(f"_p_{f.name}"), F.col(f.name))
        elif f.name == stamp_col and at is not None:
            c = F.when(F.col("_hit"), stamp(at).cast(f.dataType)).otherwise(F.col(f.name))
        else:
            c = F.col(f.name)
        out.append(c.cast(f.dataType).alias(f.name))
    return j.select(*out)


def changed_fields(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]
                   ) -> DataFrame:
    """PF-9: per matched key, the new value where it differs, else NULL."""
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols])
    j = new.select(*keys, *cols).join(o, keys)
    return j.select(*keys, *[F.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.col(c))
                             .alias(c) for c in cols])


def rows_in_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """J-9: rows whose key is in the key table (semi join)."""
    return df.join(keys.select(*on), on, "left_semi")


def delete_rows(table: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """D-10/D-11: (remaining rows, deleted rows)."""
    k = keys.select(*on)
    return table.join(k, on, "left_anti"), table.join(k, on, "left_semi")


def remove_cart_items(cart: DataFrame, requests: DataFrame) -> DataFrame:
    """D-12: a request with a NULL album empties the user's cart, else it
    removes that album only."""
    whole = requests.filter(F.col("album_id").isNull()).select("user_id")
    one = requests.filter(F.col("album_id").isNotNull()).select("user_id", "album_id")
    return (cart.join(whole, "user_id", "left_anti")
            .join(one, ["user_id", "album_id"], "left_anti"))


def delete_parents(parents: DataFrame, keys: DataFrame, key: str,
                   children: list[tuple[str, DataFrame, str, str]]
                   ) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """D-13: delete parent keys; a ``restrict`` child refuses the delete of
    its parent, a ``cascade`` child is deleted with it.  ``children``:
    (name, child, fk column, rule).  Returns (parents left, refused keys,
    children left by name)."""
    asked = keys.select(key).distinct()
    refused = None
    for _name, child, fk, rule in children:
        if rule == "restrict":
            r = asked.join(child.select(F.col(fk).alias(key)), key, "left_semi")
            refused = r if refused is None else refused.unionByName(r)
    refused = (refused.distinct() if refused is not None
               else asked.filter(F.lit(False)))
    gone = asked.join(refused, key, "left_anti")
    left = parents.join(gone, key, "left_anti")
    kids = {}
    for name, child, fk, rule in children:
        if rule == "cascade":
            kids[name] = child.join(gone.select(F.col(key).alias(fk)), fk, "left_anti")
        else:
            kids[name] = child
    return left, refused, kids


def upsert_add(table: DataFrame, delta: DataFrame, keys: list[str], col: str) -> DataFrame:
    """D-14: insert-or-increment.  A union and one grouped sum (partial
    aggregation before the shuffle) instead of a full outer join."""
    return (table.select(*keys, col).unionByName(delta.select(*keys, col))
            .groupBy(*keys).agg(F.sum(col).cast("bigint").alias(col)))


def added_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """J-12: rows of ``new`` whose key is not in ``old``."""
    return new.join(old.select(*keys), keys, "left_anti")


def removed_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """J-12: rows of ``old`` whose key is gone from ``new``."""
    return old.join(new.select(*keys), keys, "left_anti")


def first_match(df: DataFrame, lookup: DataFrame, key: list[str], value: str,
                order: str) -> DataFrame:
    """J-13/W-3: attach from ``lookup`` the value of the first row (lowest
    ``order``) with the same key; NULL when none."""
    first = lookup.groupBy(*key).agg(F.min_by(F.col(value), F.col(order)).alias(value))
    return df.join(first, key, "left")


def zip_join(a: DataFrame, b: DataFrame, key: list[str], order_a: str, order_b: str
             ) -> DataFrame:
    """J-14: pair the n-th row of ``a`` with the n-th row of ``b`` per key,
    like Python's ``zip`` (skew-safe numbering on both sides)."""
    an = rank_within(a, key, [F.col(order_a).asc()], "_n")
    bn = rank_within(b, key, [F.col(order_b).asc()], "_n")
    return an.join(bn, [*key, "_n"])


def rows_to_arrays(df: DataFrame, key: list[str], cols: list[str], order: str) -> DataFrame:
    """SRC-5: one set of parallel arrays per key, in ``order``."""
    item = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in cols])
    g = nest_children(df, key, item, "_rows")

    def field(c):
        return lambda r: r[c]
    return g.select(*key, *[F.transform("_rows", field(c)).alias(c) for c in cols])


def arrays_to_rows(df: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """SRC-3: parallel arrays back to rows; a short array pads with NULL."""
    return df.select(*key, F.inline(F.arrays_zip(*[F.col(c) for c in cols])))


def _other_id_exists(cand_id: Column) -> Column:
    """After joining per-key (n, min id, max id): does an existing row with
    another id exist?  For a new form (NULL id) any row counts."""
    return F.when(cand_id.isNull(), F.col("_n") > 0).otherwise(
        (F.col("_lo") != cand_id) | (F.col("_hi") != cand_id))


def title_conflicts(albums: DataFrame, candidates: DataFrame) -> DataFrame:
    """J-11: album forms whose lower-case title already exists under the
    same artist with another id (a new album has a NULL id).  Existing
    titles are reduced to (count, min id, max id) per key first, so a key
    shared by many albums costs one lookup per candidate, not one per pair."""
    have = (albums.groupBy("artist_id", F.lower("title").alias("_t"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("album_id").alias("_lo"),
                 F.max("album_id").alias("_hi")))
    c = candidates.withColumn("_t", F.lower("title"))
    return (c.join(have, ["artist_id", "_t"])
            .filter(_other_id_exists(F.col("album_id")))
            .select(*candidates.columns))


def artist_conflicts(artists: DataFrame, candidates: DataFrame) -> DataFrame:
    """J-11: artist forms whose lower-case name exists with another id."""
    have = (artists.groupBy(F.lower("name").alias("_k"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("artist_id").alias("_lo"),
                 F.max("artist_id").alias("_hi")))
    c = candidates.withColumn("_k", F.lower("name"))
    return (c.join(have, "_k").filter(_other_id_exists(F.col("artist_id")))
            .select(*candidates.columns))


def touched_albums(changed: DataFrame, artists: DataFrame) -> DataFrame:
    """J-16: the rows just written, joined back to their artist."""
    return changed.join(artists.select("artist_id"), "artist_id").select("title", "album_id")


# ---- diffs and merges -------------------------------------------------------

def diff_rows(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]
              ) -> DataFrame:
    """Keyed diff: ``op`` is add, delete or update (values differ, NULL-safe).
    One full outer join on the key."""
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_in_o"))
    n = new.select(*keys, *cols, F.lit(True).alias("_in_n"))
    j = o.join(n, keys, "full_outer")
    differs = None
    for c in cols:
        d = ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        differs = d if differs is None else (differs | d)
    op = (F.when(F.col("_in_o").isNull(), F.lit("add"))
          .when(F.col("_in_n").isNull(), F.lit("delete"))
          .when(differs, F.lit("update")))
    return (j.withColumn("op", op).filter(F.col("op").isNotNull())
            .select(*keys, "op", *[F.when(F.col("op") == "delete", F.col(f"_o_{c}"))
                                   .otherwise(F.col(c)).alias(c) for c in cols]))


LINE_KEYS, LINE_FIELDS = ["purchase_order", "line"], ["album_id", "quantity", "line_total"]


def diff_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """D-16: line diff per purchase order, by line number; added and
    updated lines carry the confirmed quantity of the first old line with
    the same album (J-13)."""
    d = diff_rows(old, new, LINE_KEYS, LINE_FIELDS)
    carried = first_match(d.filter(F.col("op") != "delete"),
                          old.select("purchase_order", "album_id", "confirmed_quantity", "line"),
                          ["purchase_order", "album_id"], "confirmed_quantity", "line")
    dels = d.filter(F.col("op") == "delete").withColumn(
        "confirmed_quantity", F.lit(None).cast("bigint"))
    return carried.unionByName(dels)


def apply_diff(table: DataFrame, diff: DataFrame, keys: list[str]) -> DataFrame:
    """Merge a keyed diff: deletes and updates replace old rows, adds append."""
    cols = table.columns
    kept = table.join(diff.select(*keys), keys, "left_anti")
    put = diff.filter(F.col("op") != "delete").select(*cols)
    return kept.unionByName(put)


def change_set(diff: DataFrame, key: str, parents: DataFrame, headers: DataFrame | None,
               fields: list[str]) -> DataFrame:
    """Parent and children in one set of changes: per parent with any change its child
    counts (``added``, ``updated``, ``deleted``), ``children_changed``, ``header_changed``
    and the values that the edit gives its ``fields`` (null struct without an edit).
    ``headers``: (key, fields), one edited header a parent."""
    counts = diff.groupBy(key).agg(
        *[F.count_if(F.col("op") == op).cast("bigint").alias(name)
          for op, name in (("add", "added"), ("update", "updated"), ("delete", "deleted"))],
        F.lit(True).alias("children_changed"))
    if headers is None:
        none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in parents.schema.fields])
        return counts.withColumns({"header_changed": F.lit(False), "_new": F.when(F.lit(False), none)})
    given = last_per_key(headers.select(key, *fields), [key], None).select(key, F.struct(*fields).alias("_new"))
    old = parents.select(key, F.struct(*fields).alias("_old"))
    differs = reduce(lambda a, b: a | b, [~F.col(f"_new.{c}").eqNullSafe(F.col(f"_old.{c}")) for c in fields])
    edits = given.join(old, key).select(key, "_new", differs.alias("header_changed"))
    j = counts.join(edits, key, "full_outer")
    none = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("added", "updated", "deleted")}
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("children_changed", "header_changed")}
    return j.withColumns({**none, **flags}).where("children_changed or header_changed")


def apply_headers(parents: DataFrame, changes: DataFrame, key: str, fields: list[str],
                  marks: dict[str, Column]) -> DataFrame:
    """Parents of ``changes`` take the ``marks`` (stamp, status) and, where the change holds
    a header (``_new``), its fields; all others stay as they are."""
    ch = changes.select(key, F.lit(True).alias("_hit"), "_new")
    out = []
    for f in parents.schema.fields:
        c = F.col(f.name)
        if f.name in fields:
            c = F.when(F.col("_new").isNotNull(), F.col(f"_new.{f.name}")).otherwise(c)
        elif f.name in marks:
            c = F.when(F.col("_hit"), marks[f.name]).otherwise(c)
        out.append(c.cast(f.dataType).alias(f.name))
    return parents.join(ch, key, "left").select(*out)


ORDER_FIELDS = ["shipping_cost", "estimated_receipt"]


def merge_lines(lines: DataFrame, pos: DataFrame, new: DataFrame, at: str,
                headers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """D-16 merge: only orders the buyer may edit (status pending-buyer,
    PF-11) take the diff; changed orders go back to pending-supplier with
    the modified stamp ``at``.  ``headers`` (purchase_order, shipping_cost,
    estimated_receipt): an edit that changes a line also sets these of its order; one
    that changes no line changes nothing.  Returns (lines, purchase orders)."""
    editable = pos.filter(F.col("status") == "pending-buyer").select("purchase_order")
    # Lines of other orders take no part in the diff.
    old, edited = (x.join(editable, "purchase_order", "left_semi") for x in (lines, new))
    merged = apply_diff(lines, diff_lines(old, edited), LINE_KEYS)
    # The orders need what changed, not the confirmed quantities that the lines carry on.
    ops = diff_rows(old, edited, LINE_KEYS, LINE_FIELDS)
    changes = change_set(ops, "purchase_order", pos, headers, ORDER_FIELDS).where("children_changed")
    marks = {"status": F.lit("pending-supplier"), "modified": stamp(at)}
    return merged, apply_headers(pos, changes, "purchase_order", ORDER_FIELDS, marks)


def diff_songs(old: DataFrame, new: DataFrame) -> DataFrame:
    """D-17: song diff per album by track (by key, not by position)."""
    return diff_rows(old, new, ["album_id", "track"], ["duration", "song"])


def change_summary(diff: DataFrame, key: str, header: DataFrame | None = None) -> DataFrame:
    """A-16: per key, how many child rows were added, updated, deleted, and
    whether the parent's own fields changed (``header``: keys whose header
    changed, e.g. from ``changed_fields``); ``changed`` if anything did."""
    s = diff.groupBy(key).agg(
        F.count_if(F.col("op") == "add").cast("bigint").alias("added"),
        F.count_if(F.col("op") == "update").cast("bigint").alias("updated"),
        F.count_if(F.col("op") == "delete").cast("bigint").alias("deleted"))
    if header is None:
        return s.withColumn("header_changed", F.lit(False)).withColumn("changed", F.lit(True))
    h = header.select(key).distinct().withColumn("_h", F.lit(True))
    j = s.join(h, key, "full_outer")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in
              ("added", "updated", "deleted")]
    hc = F.coalesce("_h", F.lit(False))
    return j.select(key, *counts, hc.alias("header_changed"),
                    (hc | (F.coalesce("added", F.lit(0)) + F.coalesce("updated", F.lit(0))
                           + F.coalesce("deleted", F.lit(0)) > 0)).alias("changed"))


ALBUM_FIELDS = ["title", "release_year", "price", "artist_id", "photo"]


def merge_songs(songs: DataFrame, albums: DataFrame, new: DataFrame, at: str,
                headers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """D-17 merge: apply the song diff; albums with any change get the modified stamp
    ``at``.  ``headers`` (album_id, title, release_year, price, artist_id, photo): the
    album forms of the same edit; a changed field applies and stamps by itself, with or
    without a changed song.  Returns (songs, albums)."""
    d = diff_songs(songs, new)
    changes = change_set(d, "album_id", albums, headers, ALBUM_FIELDS)
    return (apply_diff(songs, d, ["album_id", "track"]),
            apply_headers(albums, changes, "album_id", ALBUM_FIELDS, {"modified": stamp(at)}))


# ---- workflows --------------------------------------------------------------

def apply_receipts(albums: DataFrame, dispatches: DataFrame, pos: DataFrame,
                   lines: DataFrame, ids: DataFrame) -> DataFrame:
    """D-7: add the confirmed quantities of the received dispatches to stock;
    an album on several lines is summed first."""
    got = (dispatch_lines(dispatches.join(ids.select("dispatch_id"), "dispatch_id",
                                          "left_semi"), pos, lines)
           .groupBy("album_id").agg(F.sum("confirmed_quantity").alias("_add")))
    return (albums.join(got, "album_id", "left")
            .withColumn("stock", (F.col("stock") + F.coalesce("_add", F.lit(0))).cast("bigint"))
            .drop("_add"))


def receive_dispatches(dispatches: DataFrame, albums: DataFrame, pos: DataFrame,
                       lines: DataFrame, requests: DataFrame
                       ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """D-20: receipt batch: the gate admits shipped dispatches only, their
    lines restock the albums, and they become ``received``.
    Returns (dispatches, albums, gate report)."""
    gate = receipt_gate(dispatches, requests.select("dispatch_id").distinct())
    ok = gate.filter("allowed").select("dispatch_id")
    new_albums = apply_receipts(albums, dispatches, pos, lines, ok)
    upd = ok.select("dispatch_id", F.lit("received").alias("status"))
    return update_by_key(dispatches, upd, ["dispatch_id"], ["status"]), new_albums, gate


def fold_cart(cart: DataFrame, events: DataFrame) -> DataFrame:
    """D-8: cart after ordered add/remove events per (user, album); a remove
    at 0 is ignored and rows at 0 are dropped; stock is not checked here."""
    q = clamped_ledger(cart, events, ["user_id", "album_id"])
    return q.filter(F.col("quantity") > 0)


def move_stock(albums: DataFrame, admitted: DataFrame) -> DataFrame:
    """D-9: stock moves opposite to the accepted cart events."""
    mv = (admitted.filter("accepted").groupBy("album_id")
          .agg(F.sum("delta").alias("_taken")))
    return (albums.join(mv, "album_id", "left")
            .withColumn("stock", (F.col("stock") - F.coalesce("_taken", F.lit(0)))
                        .cast("bigint"))
            .drop("_taken"))


def cart_after_admission(cart: DataFrame, admitted: DataFrame) -> DataFrame:
    """D-22 + D-8: cart built from the accepted events only."""
    ok = admitted.filter("accepted")
    return upsert_add(cart, ok.select("user_id", "album_id", F.col("delta").alias("quantity")),
                      ["user_id", "album_id"], "quantity").filter(F.col("quantity") > 0)


def checkout(users: DataFrame, cart: DataFrame, orders: DataFrame, bridge: DataFrame,
             requests: DataFrame, at: str
             ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """D-15: checkout for many users: one new order per requesting user with
    a non-empty cart (ids continue the highest order id, in user order),
    the cart lines become order items, the cart is emptied.
    Returns (orders, bridge, cart, users with nothing to check out)."""
    req = requests.select("user_id").distinct().join(users.select("user_id"), "user_id",
                                                     "left_semi")
    buyers = req.join(cart.select("user_id"), "user_id", "left_semi")
    empty = req.join(cart.select("user_id"), "user_id", "left_anti")
    new_orders = assign_ids(buyers, orders, "order_id", [F.col("user_id").asc()])
    new_orders = new_orders.select("order_id", "user_id", stamp(at).alias("dispatched"))
    items = (cart.join(new_orders.select("user_id", "order_id"), "user_id")
             .select("order_id", "album_id", "quantity"))
    return (orders.unionByName(new_orders), bridge.unionByName(items),
            cart.join(buyers, "user_id", "left_anti"), empty)


def apply_confirmations(pos: DataFrame, lines: DataFrame, confirmations: DataFrame
                        ) -> tuple[DataFrame, DataFrame]:
    """D-18: confirmed quantities from supplier rows (purchase_order, line,
    confirmed, modified); each confirmed order becomes ``confirmed`` when
    every line is confirmed in full, else ``pending-buyer``.  A line that is
    confirmed again takes the last message: by ``modified``, then by the
    arrival number ``seq`` where there is one, then the larger quantity.
    Returns (lines, purchase orders)."""
    arrival = [F.col(x) for x in ("modified", "seq") if x in confirmations.columns]
    c = confirmations.select("purchase_order", "line",
                             F.col("confirmed").alias("confirmed_quantity"),
                             F.struct(*arrival).alias("_order"))
    new_lines = update_by_key(lines, c, ["purchase_order", "line"], ["confirmed_quantity"],
                              order_col="_order")
    touched = confirmations.groupBy("purchase_order").agg(F.max("modified").alias("modified"))
    status = confirmation_status(new_lines.join(touched.select("purchase_order"),
                                                "purchase_order", "left_semi"))
    upd = status.join(touched, "purchase_order").select("purchase_order", "status",
                                                        F.col("modified").cast("timestamp_ntz"))
    return new_lines, update_by_key(pos, upd, ["purchase_order"], ["status", "modified"])


def apply_dispatch_updates(dispatches: DataFrame, pos: DataFrame, msgs: DataFrame, at: str
                           ) -> tuple[DataFrame, DataFrame]:
    """D-19: dispatch notes add dispatches (D-1; the first note of a dispatch
    counts, one that exists stays); updates set the status, the last message per
    dispatch (by ``seq``) wins; a ``rescheduled`` update also moves its order's
    estimated receipt and stamps it (J-10).  An update that comes before the note
    of its dispatch changes nothing.
    Returns (dispatches, purchase orders)."""
    notes = msgs.filter(F.col("kind") == "note")
    first = F.min_by(F.struct("seq", "purchase_order", "status", "address"), F.col("seq"))
    new_d = notes.groupBy("dispatch_id").agg(first.alias("_n")).select("dispatch_id", "_n.*")
    new_d = new_d.join(dispatches.select("dispatch_id"), "dispatch_id", "left_anti")
    d = append_rows(dispatches, new_d.drop("seq"))
    known = dispatches.select("dispatch_id", F.lit(None).cast("bigint").alias("_since")).unionByName(
        new_d.select("dispatch_id", F.col("seq").cast("bigint").alias("_since")))
    ups = (msgs.filter(F.col("kind") == "update")
           .select("dispatch_id", "seq", "status", "estimated_delivery")
           .join(known, "dispatch_id")
           .filter(F.col("_since").isNull() | (F.col("seq") > F.col("_since"))).drop("_since"))
    last = last_per_key(ups, ["dispatch_id"], "seq")
    d2 = update_by_key(d, last.select("dispatch_id", "status"), ["dispatch_id"], ["status"])
    resched = (ups.filter(F.col("status") == "rescheduled")
               .join(d.select("dispatch_id", "purchase_order"), "dispatch_id")
               .select("purchase_order", "seq", "estimated_delivery"))
    move = last_per_key(resched, ["purchase_order"], "seq").select(
        "purchase_order", F.col("estimated_delivery").alias("estimated_receipt"),
        stamp(at).alias("modified"))
    return d2, update_by_key(pos, move, ["purchase_order"], ["estimated_receipt", "modified"])


def rename_photos(artists_old: DataFrame, artists_new: DataFrame, albums: DataFrame
                  ) -> DataFrame:
    """D-21: renamed artists give their albums new photo names (F-1);
    returns (album_id, old photo, new photo)."""
    ren = (artists_new.select("artist_id", F.col("name").alias("_new"))
           .join(artists_old.select("artist_id", F.col("name").alias("_old")), "artist_id")
           .filter(~F.col("_new").eqNullSafe(F.col("_old"))))
    return (albums.join(ren, "artist_id")
            .select("album_id", F.col("photo").alias("old_photo"),
                    photo_name("_new", "title", "photo").alias("new_photo")))


def apply_photo_names(albums: DataFrame, renames: DataFrame, at: str) -> DataFrame:
    """D-6/D-21: the albums with the new photo names of ``rename_photos`` and the
    modified stamp ``at``."""
    new = renames.select("album_id", F.col("new_photo").alias("photo"), stamp(at).alias("modified"))
    return update_by_key(albums, new, ["album_id"], ["photo", "modified"])


def fold_draft_lines(lines: DataFrame, albums: DataFrame, events: DataFrame) -> DataFrame:
    """D-23: draft lines after the ordered +1/-1 clicks.  Clicked (order, album)
    pairs are folded and repriced (F-4); all other lines stay as they are.  Orders
    with clicks are renumbered (W-1): lines that were there in their old order,
    then lines opened by clicks in the order they were opened.

    Both click keys and the lines of clicked orders are stored tables: the lines of all
    other orders are read and shuffled once, to be told apart, and not folded at all."""
    pair = ["purchase_order", "album_id"]
    clicked = stored_table(events.select(*pair).distinct(), "clicked")
    orders = clicked.select("purchase_order").distinct()
    cols = ["purchase_order", "line", "album_id", "quantity", "line_total"]
    typed = lines.select(*pair, F.col("line").cast("bigint").alias("line"),
                         F.col("quantity").cast("bigint").alias("quantity"), "line_total")
    same = typed.join(orders, "purchase_order", "left_anti")
    touched = stored_table(typed.join(orders, "purchase_order", "left_semi"), "draft-lines")
    q = fold_draft_quantities(touched.join(clicked, pair, "left_semi"), albums, events)
    folded = (q.join(albums.select("album_id", "price"), "album_id")
              .select(*pair, "quantity", wholesale_total("price", "quantity").alias("line_total"),
                      "born_by_event", "birth"))
    rest = touched.join(clicked, pair, "left_anti").select(
        *pair, "quantity", "line_total", F.lit(False).alias("born_by_event"), F.col("line").alias("birth"))
    moved = rank_within(folded.unionByName(rest), ["purchase_order"],
                        [F.col("born_by_event").asc(), F.col("birth").asc(), F.col("album_id").asc()], "line",
                        bound=touched.select("purchase_order").unionByName(clicked.select("purchase_order")))
    return moved.select(*cols).unionByName(same.select(*cols))


def cart_checkout_cycle(albums: DataFrame, cart: DataFrame, events: DataFrame,
                        users: DataFrame, orders: DataFrame, bridge: DataFrame,
                        requests: DataFrame, at: str | None = None
                        ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """SURVEY §3 flow B over a batch: cart events are admitted in order per
    album (D-22, oversold adds refused), the cart and stock move with the
    accepted ones (D-8, D-9), then the requesting users check out (D-15).
    Returns (albums, cart, orders, bridge, admitted events); callers audit
    the new albums (C-3) before writing them."""
    admitted = admit_cart_events(albums, cart, events)
    new_albums = move_stock(albums, admitted)
    new_cart = cart_after_admission(cart, admitted)
    o, b, c, _empty = checkout(users, new_cart, orders, bridge, requests, at)
    return new_albums, c, o, b, admitted
