"""Parents with their ordered children: flat at any size, nested as one document.

``number_items`` is the form without a bound: one row per child with its number
inside its parent, so a parent with a third of all children is spread over tasks like
any other rows.  ``nest_children`` gives the document of each parent, one row however
many children it has: a document is by nature one value, so it is for parents whose
children fit in a row, and callers who need some parents' documents pass their ``ids``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import rank_within


def nest_children(children: DataFrame, keys: list[str], item: Column, name: str,
                  also: list[Column] | None = None) -> DataFrame:
    """(keys..., name, also...): the ``item`` structs sorted by their fields, the first of
    which order the children (unique inside a parent), and further aggregates of
    the same rows (sums), all in one grouped aggregate."""
    return children.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias(name), *(also or []))


def number_items(children: DataFrame, keys: list[str], order: list[str], col: str = "item",
                 bound: DataFrame | None = None) -> DataFrame:
    """``children`` with ``col`` = 1..n inside each parent, in ``order`` (unique inside a
    parent): the flat form of a document.  ``bound``: as in ``rank_within``."""
    return rank_within(children, keys, [F.col(c).asc() for c in order], col, bound=bound)
