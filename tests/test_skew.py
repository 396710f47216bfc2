"""One key holding a third of the rows: results stay exact and equal across
plans (partial aggregation, map-side combining, AQE skew handling)."""
from __future__ import annotations

from fixtures import CO_SCHEMA, OH_SCHEMA, OO_SCHEMA, TARGET_SCHEMA
from pyspark.sql import functions as F

from stockgrid.operators.aggregate import tag_sources
from stockgrid.operators.grid import grid_join_form, ordering_grid
from stockgrid.operators.overrides import latest_overrides


def _kind(spark, n, schema, extra):
    ids = spark.range(0, n)
    hot = (F.col("id") % 3 == 0)
    plant = F.when(hot, F.lit("2910")).when(F.col("id") % 7 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("29"), (F.col("id") % 3 + 1).cast("string"), F.lit("0")))
    material = F.when(hot, F.lit("HOT")).otherwise(F.concat(F.lit("M"), (F.col("id") % 997).cast("string")))
    cols = [plant.alias("Plant"), material.alias("Material")] + extra
    return ids.select(*cols).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}"
                                          for c in schema.split(", ")])


def test_hot_key_grid(spark):
    q = (F.col("id") % 50).cast("double")
    co = _kind(spark, 60000, CO_SCHEMA, [q.alias("order_qty"), (q / 2).alias("confirmed_qty")])
    oh = _kind(spark, 60000, OH_SCHEMA, [q.alias("unrestricted"), F.lit(None).alias("quality"),
                                         F.lit(1.0).alias("blocked"), F.lit(None).alias("expiry")])
    oo = _kind(spark, 60000, OO_SCHEMA, [q.alias("open_po_qty"), q.alias("po_qty"), (q * 0.75).alias("po_request_qty"),
                                         F.lit(None).alias("inbound_qty"), F.lit(None).alias("delivery_date")])
    target = spark.createDataFrame([("2910", "HOT", "S", "1", "hot", 1.0e6)], TARGET_SCHEMA)
    one = ordering_grid(tag_sources(co, oh, oo), target)
    two = grid_join_form(co, oh, oo, target)
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)
    hot = one.filter("Plant = '2910' and Material = 'HOT'").first()
    # ids 0, 3, ..., 59997: quantities id % 50
    expected = float(sum(i % 50 for i in range(0, 60000, 3)))
    assert hot.Customer_Order_Qty == expected and hot.Unrestricted_On_Hand == expected
    assert hot.Risk_Status in ("Covered", "At Risk", "Critical")


def test_hot_key_latest_override(spark):
    log = spark.range(0, 90000).select(
        F.col("id").alias("event_id"),
        (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_interval(secs=(F.col("id") % 1000).cast("int"))).alias("ts"),
        F.when(F.col("id") % 3 == 0, F.lit("2910")).otherwise(F.lit("2920")).alias("Plant"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 101).cast("string")).alias("Material"),
        (F.col("id") * 1.0).alias("Manual_Override"), F.lit("n").alias("Planner_Note"))
    got = {(r.Plant, r.Material): r.Manual_Override for r in latest_overrides(log).collect()}
    # hot key: ts cycles every 1000 ids, the latest ts is 999 s; ties broken by the largest event_id
    assert got[("2910", "HOT")] == float(max(i for i in range(0, 90000, 3) if i % 1000 == 999))
