"""Skew-safe ranking helpers agree with plain windows, on a hot group."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockgrid.functions.ranking import row_number_within, top_k_within


def _skewed(spark):
    # group 'hot' holds most rows
    return spark.range(0, 5000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise((F.col("id") % 10).cast("string")).alias("g"),
        ((F.col("id") * 7919) % 5003).alias("k"))


def test_row_number_within_matches_window(spark):
    # large enough that range partitioning samples (not every row is in the sample)
    df = spark.range(0, 120000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise((F.col("id") % 10).cast("string")).alias("g"),
        ((F.col("id") * 7919) % 1000003).alias("k"))
    ours = row_number_within(df, ["g"], ["k"], out_col="rn", num_partitions=7)
    # consumed several times (as a union of branches is): every copy must agree
    ours = ours.unionByName(ours).unionByName(ours).dropDuplicates(["g", "k", "rn"])
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert sorted(map(tuple, ours.select("g", "k", "rn").collect()), key=repr) == \
        sorted(map(tuple, ref.select("g", "k", "rn").collect()), key=repr)


def test_top_k_within_matches_window(spark):
    df = _skewed(spark)
    ours = top_k_within(df, ["g"], ["k"], 3)
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan  # per-task top-k before the shuffle
    ref = (df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("k")))
           .filter("rank <= 3"))
    assert sorted(map(tuple, ours.select("g", "k", "rank").collect())) == \
        sorted(map(tuple, ref.select("g", "k", "rank").collect()))


def test_cells_rows_consistent_across_consumers(spark):
    """cells() consumes the numbering in several union branches; at a size
    where range partitioning samples, every branch must agree."""
    from stockgrid.sources.cells import cells
    c = cells(spark, "/root/testdata/sf0.1")
    got = {r.sheet: (r.m, r.n) for r in c.groupBy("sheet").agg(
        F.max("row_no").alias("m"), F.countDistinct("row_no").alias("n")).collect()}
    part = spark.read.parquet("/root/testdata/sf0.1/part.parquet")
    want = {r.p_brand: (3 + r.c, r.c + 1) for r in part.groupBy("p_brand").agg(F.count("*").alias("c")).collect()}
    assert got == want
