"""Semantics a Spark build gets wrong by default (null keys, all-null sums,
dirty text, ties, strict comparisons)."""
from __future__ import annotations

from fixtures import customer_orders, on_hand, open_orders, row, tagged, target
from pyspark.sql import functions as F

from stockgrid.functions import coerce_numeric, coerce_timestamp, normalize_identifier
from stockgrid.operators import grid as g
from stockgrid.operators import quality
from stockgrid.operators.target import master_duplicates, target_lookup


def test_null_plant_from_two_sources_meets_in_one_row(spark):
    co = customer_orders(spark, [(None, "M1", 4.0, None)])
    oh = on_hand(spark, [(None, "M1", 7.0, None, None, None)])
    grid = g.ordering_grid(tagged(spark, co=co, oh=oh, oo=open_orders(spark)), target(spark))
    r = row(grid, None, "M1")
    assert r.Customer_Order_Qty == 4 and r.Unrestricted_On_Hand == 7 and r.Risk_Status == "Review"
    joined = g.grid_join_form(co, oh, open_orders(spark), target(spark))
    assert row(joined, None, "M1").Unrestricted_On_Hand == 7


def test_all_null_confirmations_sum_to_zero(spark):
    co = customer_orders(spark, [("2910", "M2", 6.0, None), ("2910", "M2", 1.0, None)])
    grid = g.ordering_grid(tagged(spark, co=co), target(spark))
    r = row(grid, "2910", "M2")
    assert r.Confirmed_Qty == 0 and r.Unconfirmed_Qty == 7


def test_at_risk_is_strict(spark):
    # balance exactly equal to safety stock is Covered; zero balance with target is At Risk
    co = customer_orders(spark, [("2910", "K1", 40.0, 40.0), ("2910", "K2", 50.0, 50.0)])
    oh = on_hand(spark, [("2910", "K1", 50.0, None, None, None), ("2910", "K2", 50.0, None, None, None)])
    oo = open_orders(spark, [("2910", "K9", 0.0, 0.0, 0.0, None, None)])
    t = target(spark, [("2910", "K1", "S", "1", "A", 50.0), ("2910", "K2", "S", "2", "B", 50.0)])
    grid = g.ordering_grid(tagged(spark, co=co, oh=oh, oo=oo), t)
    assert row(grid, "2910", "K1").Risk_Status == "Covered"   # balance 10 == safety 10
    assert row(grid, "2910", "K2").Risk_Status == "At Risk"   # balance 0 < safety 10


def test_supplier_without_forecast_is_review(spark):
    t = target(spark, [("2910", "10013700", "Alimentias", "13700", "X", None)])
    assert row(g.ordering_grid(tagged(spark), t), "2910", "10013700").Risk_Status == "Review"


def test_text_coercion_rules(spark):
    df = spark.createDataFrame(
        [("\t10013700.0 ", "1d", "2026-02-30"), ("nan", "1,234", "45000"), ("  ", "NaN", "bad"),
         ("PO-2026-001", " 12 ", "2026-09-01"), ("12.05", "1e3", None)], "i string, n string, t string")
    out = df.select(normalize_identifier("i").alias("i"), coerce_numeric("n").alias("n"),
                    coerce_timestamp("t").alias("t")).collect()
    assert [r.i for r in out] == ["10013700", None, None, "PO-2026-001", "12.05"]
    assert [r.n for r in out] == [None, None, None, 12.0, 1000.0]
    assert [r.t for r in out][:3] == [None, None, None] and out[3].t.year == 2026 and out[4].t is None
    us = spark.createDataFrame([("09/01/2026",), ("9/1/2026 13:05",), ("13/01/2026",), ("02/30/2026",)], "t string")
    got = [r.t for r in us.select(coerce_timestamp("t").alias("t")).collect()]
    assert got[0].month == 9 and got[0].day == 1 and got[1].hour == 13 and got[2:] == [None, None]


def test_duplicate_pairs_count_every_member(spark):
    co = customer_orders(spark, [("2910", "A", 1.0, 2.0), ("2910", "A", 1.0, 2.0), ("2910", "B", 3.0, 4.0)])
    t = tagged(spark, co=co)
    cols = {"customer_orders": ["Plant", "Material", "order_qty", "confirmed_qty"]}
    out = {r.kind: r.duplicate_rows for r in quality.duplicate_rows(t, cols).collect()}
    assert out["customer_orders"] == 2


def test_target_tie_break_and_losers(spark):
    m = spark.createDataFrame(
        [("2910", "M", "B", "1", "x", 5.0), ("2910", "M", "A", "1", "x", 5.0), ("2910", "M", "C", "1", "x", None),
         ("2910", "M", "A", "1", "x", 5.0)],
        "Plant string, Material string, Supplier string, TOL_Material string, Description string, "
        "Latest_Forecast_Qty double")
    w = target_lookup(m).collect()[0]
    assert (w.Supplier, w.Target_Stock) == ("A", 5.0)
    losers = sorted((r.Supplier, r.Latest_Forecast_Qty) for r in master_duplicates(m).collect())
    assert losers == [("A", 5.0), ("B", 5.0), ("C", None)]


def test_variance_detects_corruption(spark):
    t = tagged(spark)
    grid = g.ordering_grid(t, target(spark))
    ok = quality.reconciliation_gate(quality.reconciliation_variance(t, grid)).first()
    assert ok.passed and ok.n_metrics == 4
    bad = grid.withColumn("Unrestricted_On_Hand", F.col("Unrestricted_On_Hand") + 1000)
    assert not quality.reconciliation_gate(quality.reconciliation_variance(t, bad)).first().passed


def test_master_key_without_activity(spark):
    t = target(spark).unionByName(target(spark, [("2930", "NEVER-SEEN", "Alimentias", "9", "U", 10.0)]))
    keys = [(r.Plant, r.Material) for r in quality.master_no_activity(tagged(spark), t).collect()]
    assert ("2930", "NEVER-SEEN") in keys


def test_header_validation_cases(spark):
    from stockgrid import config
    from stockgrid.operators.loading import header_validation
    exp = list(config.ON_HAND_HEADERS)
    cases = {1: exp, 2: exp[:-1], 3: exp + ["Some New Column"], 4: ["Material Number"] + exp[1:],
             5: list(reversed(exp)), 6: exp + [exp[0]]}
    rows = [(f, i + 1, n) for f, names in cases.items() for i, n in enumerate(names)]
    h = spark.createDataFrame(rows, "file_id int, ordinal int, name string")
    out = {r.file_id: r for r in header_validation(h, exp).collect()}
    assert out[1].ok and out[1].result == "ok"
    assert out[2].missing_columns == "Shelf Life Expiration Date"
    assert out[3].extra_columns == "Some New Column"
    assert out[4].missing_columns == "Material" and out[4].extra_columns == "Material Number"
    assert out[5].reordered and not out[5].ok
    assert out[6].duplicated_columns == "Material" and not out[6].reordered


def test_exact_sums_do_not_overflow_and_are_order_free(spark):
    from stockgrid.functions import exact_sum
    big = 4.0e12  # 4e12 units: 4e18 millionths would overflow one 64-bit sum after 3 rows
    rows = [(big + 0.123456,), (big,), (big,), (-0.5,), (1.0e-7,), (float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "x double")
    a = df.agg(exact_sum("x").alias("s")).first().s
    b = df.repartition(5).sortWithinPartitions(F.rand(3)).agg(exact_sum("x").alias("s")).first().s
    assert a == b == 3 * big + 0.123456 - 0.5
    empty = spark.createDataFrame([(None,)], "x double").agg(exact_sum("x").alias("s")).first().s
    assert empty == 0.0
