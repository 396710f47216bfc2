"""Shared-folder handling: a configured spark.checkpoint.dir is used as is."""
from __future__ import annotations

from stockgrid.operators.reports import write_table
from stockgrid.session import ensure_checkpoint_dir, scratch_path


def test_checkpoint_dir_is_shared_folder(spark):
    base = ensure_checkpoint_dir(spark)
    assert base and spark.sparkContext.getCheckpointDir() == base
    assert scratch_path(spark, "x").startswith(base.rstrip("/"))


def test_written_tables_live_under_checkpoint_dir(spark):
    path = write_table(spark, spark.range(3), "t")
    assert path.startswith(ensure_checkpoint_dir(spark).rstrip("/"))
    assert spark.read.parquet(path).count() == 3


def test_checkpoint_cuts_lineage(spark):
    df = spark.range(10).selectExpr("id % 3 as k").groupBy("k").count().checkpoint()
    assert sorted(r["count"] for r in df.collect()) == [3, 3, 4]
