"""Plan-independent invariants on the shared tables."""
from __future__ import annotations

from conftest import SF_SMALL
from pyspark.sql import functions as F

from stockgrid.operators import grid as g
from stockgrid.operators import quality
from stockgrid.plans.core import load_target
from stockgrid.sources import testdata as td


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_grid_unchanged_under_repartition(spark):
    src = td.source_rows(spark, SF_SMALL)
    target = load_target(spark, SF_SMALL)
    a = g.ordering_grid(src, target)
    b = g.ordering_grid(src.repartition(13, "kind").sortWithinPartitions(F.rand(7)), target)
    assert _rows(a) == _rows(b)


def test_variance_is_zero_and_keys_match(spark):
    src = td.source_rows(spark, SF_SMALL)
    grid = g.ordering_grid(src, load_target(spark, SF_SMALL))
    gate = quality.reconciliation_gate(quality.reconciliation_variance(src, grid)).first()
    assert gate.passed
    assert grid.count() == src.select("Plant", "Material").distinct().count()


def test_filter_on_key_pushes_below_aggregate(spark):
    src = td.source_rows(spark, SF_SMALL)
    grid = g.ordering_grid(src, load_target(spark, SF_SMALL)).filter(F.col("Plant") == "2920")
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    agg_at = plan.find("Aggregate")
    # the Plant predicate appears below (after, in tree order) the aggregate
    assert agg_at >= 0 and "2920" in plan[agg_at:]
