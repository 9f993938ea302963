"""Form and list inputs to rows: SRC-2, SRC-6 (SRC-3/SRC-5 live with the
change operators as ``arrays_to_rows`` / ``rows_to_arrays``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import parse_duration

# Row fields of the two forms the reference reads (fixed values).
SONG_FIELDS = ["track", "song", "duration"]
LINE_FIELDS = ["artist_id", "name", "album_id", "title", "quantity", "line_total"]


def forms_to_rows(kv: DataFrame, fields: list[str]) -> DataFrame:
    """SRC-2/A-17/F-12: (form_id, key, value) pairs with keys ``field_n`` to
    one row per (form, n), ordered by n; values trimmed.  The whole trailing
    number is the row index (line 12 stays 12)."""
    alt = "|".join(sorted(fields, key=len, reverse=True))
    pat = rf"^({alt})_([0-9]+)$"
    # One match a pair; the index is what follows the last underscore.
    tail = F.substring_index("key", "_", -1)
    parsed = kv.where(F.col("key").rlike(pat)).select(
        "form_id", F.col("key").substr(F.lit(1), F.length("key") - F.length(tail) - 1).alias("_f"),
        tail.alias("_n"), F.trim("value").alias("value"))
    wide = (parsed.groupBy("form_id", F.col("_n").cast("bigint").alias("n"))
            .pivot("_f", fields).agg(F.first("value")))
    return wide.select("form_id", "n", *fields)


def song_form_rows(kv: DataFrame) -> DataFrame:
    """Song form: track as number, duration ``m:ss`` to seconds (F-2)."""
    r = forms_to_rows(kv, SONG_FIELDS)
    return r.select("form_id", "n", F.col("track").try_cast("bigint").alias("track"),
                    "song", parse_duration("duration").alias("duration"))


def line_form_rows(kv: DataFrame) -> DataFrame:
    """Purchase-order form: album id, quantity and line total as numbers."""
    r = forms_to_rows(kv, LINE_FIELDS)
    return r.select("form_id", F.col("n").alias("line"),
                    F.col("artist_id").try_cast("bigint").alias("artist_id"),
                    F.col("name").alias("artist"),
                    F.col("album_id").try_cast("bigint").alias("album_id"),
                    F.col("title").alias("album"),
                    F.col("quantity").try_cast("bigint").alias("quantity"),
                    F.col("line_total").try_cast("decimal(12,2)").alias("line_total"))


def allow_list(df: DataFrame, col: str = "allow") -> DataFrame:
    """SRC-6: ``user:role,user:role`` text to (username, role) rows."""
    return df.select(F.explode(F.str_to_map(F.col(col), F.lit(","), F.lit(":")))
                     .alias("username", "role"))


def admit_users(requests: DataFrame, allow: DataFrame) -> DataFrame:
    """SRC-6: registrations admitted when the username is on the list, with
    the listed role; others are refused (role NULL)."""
    a = allow.select("username", "role")
    return (requests.select("username").join(a, "username", "left")
            .select("username", "role", F.col("role").isNotNull().alias("admitted")))
