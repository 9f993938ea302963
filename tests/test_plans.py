"""Plan tests: pushdown and pruning reach the scan, Python runs on workers
only in the admission fold, no single-partition exchange outside
global aggregates and top-k."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL
from groovehouse.plans import registry

# Top-k pages and the bounded 50-user allow list gather into one task by design.
SINGLE_OK = {"album_page", "album_page_title", "artist_page", "allow_list", "admit_users"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_python_in_the_plan(spark, name):
    plan = _plan(registry.queries()[name](spark, SF_SMALL))
    has_py = any(k in plan for k in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas",
                                     "FlatMapGroupsInPandas"))
    # The admission fold sits behind a stored table.
    assert not has_py


def _bad_single_partition(plan: str) -> list[str]:
    """Single-partition exchanges not directly above a global partial
    aggregate (one row per task) or a per-partition count table."""
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = " ".join(lines[i + 1:i + 3])
            if "HashAggregate(keys=[]" in below or "_gh_pid" in below:
                continue
            bad.append(line.strip())
    return bad


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SINGLE_OK))
def test_no_single_partition_exchange(spark, name):
    plan = _plan(registry.queries()[name](spark, SF_SMALL))
    assert _bad_single_partition(plan) == []


def test_album_page_is_top_k_with_pruned_scan(spark):
    df = registry.queries()["album_page"](spark, SF_SMALL)
    plan = _plan(df)
    assert "TakeOrderedAndProject" in plan
    # the part scan reads only the columns the listing needs
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int," \
           "p_retailprice:double>" in plan


def test_key_filters_reach_parquet(spark):
    from groovehouse.sources.fixtures import Shop
    s = Shop(spark, SF_SMALL)
    from pyspark.sql import functions as F
    plan = _plan(s.purchase_orders.filter(F.col("purchase_order") == 7))
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in plan
