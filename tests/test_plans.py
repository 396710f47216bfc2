"""Plan-shape guards for every registered query, planned as at scale
(AQE off, automatic broadcast off): no cartesian or nested-loop joins, no
window over a single partition, explicit broadcasts only of fixed-size
dimensions."""
from __future__ import annotations

import pytest
from conftest import SF_SMALL

from stockgrid.plans import catalog

# queries whose explicit broadcast is a fixed dimension (per-kind column list)
FIXED_DIMENSION_BROADCASTS = {"null_counts", "null_counts_nonzero"}


@pytest.fixture(scope="module")
def at_scale(spark):
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_plan_shape(at_scale, name):
    df = catalog.REGISTRY[name].build(at_scale, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    lines = plan.split("\n")
    for i, line in enumerate(lines[:-1]):
        if "Window [" in line:
            assert "SinglePartition" not in lines[i + 1], line
    if "BroadcastExchange" in plan:
        assert name in FIXED_DIMENSION_BROADCASTS


def test_flagship_shape(at_scale):
    """ordering_grid at scale: map-side partial aggregation before the single
    key exchange of the grid side, and lineitem/orders each shuffled once."""
    plan = catalog.REGISTRY["ordering_grid"].build(at_scale, SF_SMALL)._jdf.queryExecution() \
        .executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    key_exchanges = [line for line in exchanges if "Plant" in line and "Material" in line]
    assert len(key_exchanges) == 2          # grid side + target side, each once
    assert sum("l_orderkey" in line for line in exchanges) == 1
    assert sum("o_orderkey" in line for line in exchanges) == 1
    assert "partial_sum" in plan and "partial_min" in plan
    assert "SortMergeJoin [Plant" in plan   # grid joins the target on the already-partitioned key


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_reports_read_stored_results(at_scale):
    """What is left for the report queries once sources, keys and metrics are there, and the jobs that gave them."""
    from stockgrid.operators import onepass
    from stockgrid.plans.core import load_target
    from stockgrid.plans.reports import REQUIRED
    from stockgrid.sources import testdata as td
    assert exchanges(catalog.REGISTRY["reconciliation_summary"].build(at_scale, SF_SMALL)) <= 6
    assert exchanges(catalog.REGISTRY["audit_lines"].build(at_scale, SF_SMALL)) <= 14   # three of them over the workbook's cells
    assert exchanges(catalog.REGISTRY["reconciliation_report"].build(at_scale, SF_SMALL)) <= 12
    rows = td.rows_with_files(td.lines(at_scale, SF_SMALL))
    assert exchanges(onepass.source_metrics(rows, td.KIND_COLUMNS, REQUIRED)) == 3      # the join, the total
    keys = onepass.key_table(rows, load_target(at_scale, SF_SMALL))
    assert exchanges(keys) == 4      # the join, one aggregation by key on each side; the full join adds none
    assert exchanges(onepass.key_metrics(keys)) == 5


def test_supplier_keys_reduce_the_sources(at_scale):
    """The semi join with the supplier's keys stands below the partial aggregation of the sources and of the override log."""
    for name in ("filter_supplier", "supplier_slice", "supplier_orders"):
        plan = catalog.REGISTRY[name].build(at_scale, SF_SMALL)._jdf.queryExecution().executedPlan().toString().split("\n")
        partial = next(i for i, line in enumerate(plan) if "partial_sum" in line)
        depth = plan[partial].index("HashAggregate")
        below = [line for line in plan[partial + 1:] if "LeftSemi" in line and line.index("SortMergeJoin") > depth]
        assert below, name


def test_supplier_pages_share_one_slice(spark):
    from stockgrid.operators.supplier import supplier_pages
    from stockgrid.plans.views import SUPPLIER, SUPPLIER_PLANTS, _of_suppliers
    pages = supplier_pages(_of_suppliers(spark, SF_SMALL, [SUPPLIER], SUPPLIER_PLANTS))
    assert len(pages) == 7
    for page in pages.values():
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("FileScan") == 1


def longest_method(df) -> int:
    """Bytes of the longest method Spark generates for the plan; from 8,000 on, Java runs it without compiling it."""
    import re
    said = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said))


def test_report_jobs_are_compiled(at_scale):
    from stockgrid.operators import onepass
    from stockgrid.plans.core import load_target
    from stockgrid.plans.reports import REQUIRED
    from stockgrid.sources import testdata as td
    rows = td.rows_with_files(td.lines(at_scale, SF_SMALL))
    assert longest_method(onepass.source_metrics(rows, td.KIND_COLUMNS, REQUIRED)) < 8000
    assert longest_method(onepass.key_table(rows, load_target(at_scale, SF_SMALL))) < 8000


@pytest.mark.parametrize("name", ["projected_position", "risk_status"])
def test_lines_are_not_sorted_for_their_orders(at_scale, name):
    """The task that sums by key holds the narrow orders of its shard beside its sums, no sorted lines."""
    plan = catalog.REGISTRY[name].build(at_scale, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [l_orderkey" in plan and "Sort [l_orderkey" not in plan
