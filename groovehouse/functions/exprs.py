"""Scalar rules as native Column expressions (F-1 .. F-15).

All are built-in Spark functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LINE_TOTAL

# Fixed values of the reference's rules.
WHOLESALE_SMALL = 0.7       # factor for quantities up to 5
WHOLESALE_LARGE = 0.6       # factor above 5
WHOLESALE_BREAK = 5
WAREHOUSE_CAP = 10          # stock + ordered may not pass this
TS_TEXT = "yyyy-MM-dd HH:mm:ss"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def photo_name(name, title, file) -> Column:
    """F-1: ``artist-title.ext``: lower case, only a-z 0-9 whitespace and
    ``-`` kept, spaces to ``-``, extension of the uploaded file kept."""
    base = F.lower(F.concat(_c(name), F.lit("-"), _c(title)))
    base = F.regexp_replace(base, r"[^a-z0-9\s-]", "")
    base = F.replace(base, F.lit(" "), F.lit("-"))
    return F.concat(base, F.lit("."), F.substring_index(_c(file), ".", -1))


def parse_duration(c) -> Column:
    """F-2: ``m:ss`` text to seconds; blank gives NULL; bad text gives NULL."""
    t = F.trim(_c(c))
    parts = F.split(t, ":")
    secs = (parts.getItem(0).try_cast("bigint") * 60
            + parts.getItem(1).try_cast("bigint"))
    return F.when(t == "", F.lit(None).cast("bigint")).otherwise(secs)


def format_duration(c) -> Column:
    """F-3: seconds to ``m:ss`` (below ten minutes) or ``mm:ss``; the value
    is taken modulo one hour, as a clock reading would."""
    s = _c(c) % 3600
    return F.format_string("%d:%02d", (s / 60).cast("bigint"), s % 60)


def wholesale_total(price, quantity) -> Column:
    """F-4: price x quantity x (0.7 up to 5, else 0.6), half-up to cents."""
    q = _c(quantity)
    factor = F.when(q <= WHOLESALE_BREAK, F.lit(WHOLESALE_SMALL).cast("decimal(2,1)")) \
        .otherwise(F.lit(WHOLESALE_LARGE).cast("decimal(2,1)"))
    return F.round(_c(price) * q * factor, 2).cast(LINE_TOTAL)


def item_label(artist, title, price, quantity) -> Column:
    """F-6: ``artist - title, price x qty = amount``."""
    amount = (_c(price) * _c(quantity)).cast("decimal(14,2)")
    return F.concat(_c(artist), F.lit(" - "), _c(title), F.lit(", "),
                    _c(price).cast("string"), F.lit(" x "), _c(quantity).cast("string"),
                    F.lit(" = "), amount.cast("string"))


def local_time(c, tz: str) -> Column:
    """F-8: UTC timestamp to local wall clock ``d.M.yyyy HH:mm``."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(c)), "d.M.yyyy HH:mm")


def ts_text(c) -> Column:
    """PF-1: timestamp to its text form (the reference's ``::varchar``)."""
    return F.date_format(_c(c), TS_TEXT)


def to_minutes(c) -> Column:
    """F-9: timestamp text cut to minutes."""
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm")


def short_status(c) -> Column:
    """F-10: part of a status before the first ``-``."""
    return F.substring_index(_c(c), "-", 1)


# Characters the reference's encoder (encodeURIComponent) leaves as they are
# but a form encoder escapes (fixed values).
URI_KEEP = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def status_text(c) -> Column:
    """F-10 variant: the first ``-`` of a status becomes a space."""
    return F.regexp_replace(_c(c), "^([^-]*)-", "$1 ")


def url_slug(c) -> Column:
    """F-11: lower case, each whitespace character to ``-``, percent-encoded
    like ``encodeURIComponent`` (``! ' ( ) ~`` stay as they are)."""
    out = F.url_encode(F.regexp_replace(F.lower(_c(c)), r"\s", "-"))
    for code, ch in URI_KEEP.items():
        out = F.replace(out, F.lit(code), F.lit(ch))
    return out


def activity_text(orders, cart) -> Column:
    """F-13: ``n order(s) dispatched. m albums in cart.``; zero parts left out."""
    o, k = _c(orders), _c(cart)
    part_o = F.when(o > 0, F.concat(o.cast("string"), F.lit(" order(s) dispatched.")))
    part_c = F.when(k > 0, F.concat(k.cast("string"), F.lit(" albums in cart.")))
    return F.concat_ws(" ", part_o, part_c)


def stamp(at: str | None = None) -> Column:
    """F-14: the modified / created stamp: UTC now, or a fixed time ``at``
    so a rerun gives the same table."""
    if at is None:
        return F.convert_timezone(None, F.lit("UTC"), F.current_timestamp())
    return F.lit(at).cast("timestamp_ntz")


def money(c) -> Column:
    """Output form of money: rounded to cents, then double."""
    return F.round(_c(c), 2).cast("double")


def search_match(q: str | None, *cols) -> Column:
    """PF-2/PF-3: case-insensitive substring match; ``%`` and ``_`` in the
    search text act as LIKE wildcards, as in the reference."""
    pat = f"%{q}%".lower()
    cond = None
    for c in cols:
        m = F.lower(_c(c)).like(pat)
        cond = m if cond is None else (cond | m)
    return cond
