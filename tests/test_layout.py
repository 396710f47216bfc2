"""Bucketed storage on the grid key removes every shuffle from the grid."""
from __future__ import annotations

import os

from conftest import SF_SMALL

from stockgrid.operators.grid import ordering_grid
from stockgrid.plans.core import load_grid, load_target
from stockgrid.sources import testdata as td
from stockgrid.sources.layout import store_bucketed


def test_grid_over_bucketed_tables_has_no_exchange(spark, tmp_dir):
    src = store_bucketed(td.source_rows(spark, SF_SMALL), "sg_sources", os.path.join(tmp_dir, "src"), 8)
    tgt = store_bucketed(load_target(spark, SF_SMALL), "sg_target", os.path.join(tmp_dir, "tgt"), 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grid = ordering_grid(src, tgt)
        plan = grid._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(tuple, grid.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in plan, plan
    assert rows == sorted(map(tuple, load_grid(spark, SF_SMALL).collect()), key=repr)
