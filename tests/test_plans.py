"""Plan shape: pushdown, pruning, no Python in the hot path, no single-task
sorts over base rows, no cartesian products."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kerbside import fixtures as fx
from kerbside.plans import feeds, registry
from kerbside.sources.tables import TableStore
from tests.conftest import SF001

QUERIES = {n: q for n, q in entry.queries().items() if n in registry.QUERIES}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_or_cartesian(spark, name):
    plan = plan_of(QUERIES[name](spark, SF001))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


def test_point_lookup_pushes_down(spark, tmp_dir):
    store = TableStore(spark, tmp_dir)
    store.replace_if_nonempty(fx.load(spark, SF001).premises, "premises")
    q = store.load("premises").where(F.col("search_postcode") == "QX01AB").select("id", "address_street")
    plan = plan_of(q)
    assert "PushedFilters: [IsNotNull(search_postcode), EqualTo(search_postcode,QX01AB)]" in plan
    assert "ReadSchema: struct<id:bigint,address_street:string,search_postcode:string>" in plan


def test_feed_scan_is_pruned(spark):
    t = fx.load(spark, SF001)
    # the plan feeding the (checkpointed) numbering reads only the needed columns
    plan = plan_of(feeds._existing_jobs(t.premises, t.jobs).select("premises_id", "date", "bin", "id"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in plan


def test_sitemap_sort_is_range_partitioned(spark):
    t = fx.load(spark, SF001)
    plan = plan_of(feeds.sitemap_rows(t.premises))
    # ranks come from the staged, range-sorted rows ...
    assert "ReadSchema: struct<id:bigint,updated_at:timestamp,_kb_part:int,_kb_pos:bigint>" in plan
    # ... and the only single-partition step is over the per-partition counts
    single = [i for i, line in enumerate(plan.splitlines()) if "SinglePartition" in line]
    assert len(single) <= 1
    if single:
        below = "\n".join(plan.splitlines()[single[0] : single[0] + 4])
        assert "_kb_part" in below
