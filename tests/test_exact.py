"""Sums lose nothing, and the gate sees what is not a number."""
from __future__ import annotations

import csv
import glob
import math

import pytest
from pyspark.sql import functions as F

from stockgrid.functions import exact, exact_sum, exact_total
from stockgrid.functions.exact import with_parts
from stockgrid.operators import quality
from stockgrid.sinks.export import CSV_OPTIONS, write_csv


def total(spark, values):
    rows = [(None if v is None else float(v),) for v in values]
    return spark.createDataFrame(rows, "x double").agg(exact_total("x").alias("t")).first()["t"]


def test_small_values_add_up(spark):
    assert spark.range(10 ** 6).select(F.lit(1e-7).alias("x")).agg(exact_sum("x").alias("t")).first()["t"] == 0.1


@pytest.mark.parametrize("values, want", [
    ([8e18, 8e18], 1.6e19), ([9.5e18, 1], 9.5e18), ([1e19, 1], 1e19), ([1e300, 1], 1e300), ([None, float("nan")], None),
    ([float("nan"), 2], 2.0), ([-1.5, -2.25, 0.1], -3.65), ([0.1] * 10, 1.0), ([2.0 ** 59, 1, -2.0 ** 59], 1.0), ([], None)])
def test_totals(spark, values, want):
    assert total(spark, values) == want


def test_far_values_add_up_in_any_order(spark):
    """Totals of values from 2^60 on, with small ones beside them, don't depend on the order of rows or partitions."""
    values = [2.0 ** 61 + 512, -(2.0 ** 61), 0.1, 1e25, -1e25, 3.0 * 2.0 ** 70, 7.0, -3.0 * 2.0 ** 70, 2.0 ** 60, -(2.0 ** 60), 0.2] * 7
    want = total(spark, values)
    assert want == 7 * 512 + 7 * 7 + 2.1
    for seed in range(3):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5).sortWithinPartitions(F.rand(seed))
        assert df.agg(exact_total("x").alias("t")).first()["t"] == want
    states = with_parts(spark.createDataFrame([(v, i % 4) for i, v in enumerate(values)], "x double, g int"), {"t": "x"}).groupBy("g").agg(
        *exact.states(["t"]))
    assert states.agg(*exact.merged(["t"])).selectExpr(exact.total_sql("t") + " AS t").first()["t"] == want


def test_infinite_totals_stay_infinite(spark):
    assert total(spark, [float("inf"), 1]) == math.inf


def test_gate_fails_on_values_that_are_no_number(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0, 0.0), ("b", math.inf, math.inf, math.nan)],
                                 "metric string, source_total double, dashboard_total double, variance double")
    assert not quality.reconciliation_gate(rows).first()["passed"]
    assert quality.reconciliation_gate(rows.where("metric = 'a'")).first()["passed"]
    bad = spark.createDataFrame([("on_hand", math.inf), ("on_hand", math.nan), ("on_hand", None), ("on_hand", 1.0)],
                                "kind string, unrestricted double")
    assert quality.null_counts(spark, bad, {"on_hand": ["unrestricted"]}).first()["null_count"] == 3


def test_duplicates_count_whole_rows(spark):
    df = spark.createDataFrame([("p", "m", 1.0, "b1", 1), ("p", "m", 1.0, "b2", 2), ("p", "m", 1.0, "b2", 3)],
                               "Plant string, Material string, unrestricted double, batch string, _row_id long")
    assert quality.full_row_duplicates(spark, {"on_hand": df}).first()["duplicate_rows"] == 2


def test_csv_round_trip(spark, tmp_dir):
    rows = [('CHEESE 12" WHEEL, AGED', "  lead"), ('say ""hi""', "trail  "), ("plain", ",")]
    path = write_csv(spark.createDataFrame(rows, "a string, b string").coalesce(1), f"{tmp_dir}/out")
    with open(glob.glob(f"{path}/*.csv")[0], newline="") as f:
        assert [tuple(r) for r in csv.reader(f)][1:] == rows
    back = spark.read.schema("a string, b string").options(**CSV_OPTIONS).csv(path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
