"""Golden values of the source application's unit tests, on Spark."""
from __future__ import annotations

import math

from fixtures import customer_orders, d, on_hand, open_orders, row, tagged, target

from stockgrid.operators import aggregate as agg
from stockgrid.operators import grid as g
from stockgrid.operators.overrides import apply_overrides

ALLOC = {"2910": "po_qty", "2920": "po_request_qty"}


def test_on_hand_sums_and_min_expiry(spark):
    out = agg.agg_on_hand(on_hand(spark))
    r = row(out, "2910", "10013700")
    assert r.Unrestricted_On_Hand == 50 and r.Quality_Inspection_Qty == 2 and r.Blocked_Stock_Qty == 1
    assert r.Earliest_Expiry_Date == d("2026-06-01")


def test_composite_key_never_merges_plants(spark):
    assert row(agg.agg_on_hand(on_hand(spark)), "2920", "10013700").Unrestricted_On_Hand == 5


def test_customer_orders_and_unconfirmed(spark):
    out = agg.agg_customer_orders(customer_orders(spark))
    r = row(out, "2910", "10013700")
    assert (r.Customer_Order_Qty, r.Confirmed_Qty, r.Unconfirmed_Qty) == (15, 13, 2)
    assert row(out, "2910", "10099999").Unconfirmed_Qty == 0


def test_open_orders_and_allocation_by_plant(spark):
    out = agg.agg_open_orders(open_orders(spark), ALLOC)
    r = row(out, "2910", "10013700")
    assert r.Open_PO_Qty == 12 and r.Next_PO_Delivery_Date == d("2026-09-01")
    assert r.Allocation_Qty == 12  # PO Quantity at 2910
    r2 = row(out, "2920", "10013700")
    assert r2.Inbound_Delivery_Qty == 2 and r2.Allocation_Qty == 6  # PO Request Quantity at 2920


def test_position_suggestion_and_status(spark):
    grid = g.ordering_grid(tagged(spark), target(spark))
    r = row(grid, "2910", "10013700")
    assert r.Available_Plus_Incoming == 62 and r.Projected_Balance == 47
    assert r.Suggested_Order_Qty == 0 and r.Risk_Status == "Covered"
    assert r.Safety_Stock == 10


def test_no_target_gives_null_suggestion_and_review(spark):
    r = row(g.ordering_grid(tagged(spark), target(spark)), "2910", "10099999")
    assert r.Suggested_Order_Qty is None and r.Risk_Status == "Review" and r.Has_Target is False


def test_suggestion_rounds_up(spark):
    t = target(spark, [("2910", "10013700", "Alimentias", "13700", "TEST", 65.4)])
    assert row(g.ordering_grid(tagged(spark), t), "2910", "10013700").Suggested_Order_Qty == 6


def test_critical_when_balance_negative(spark):
    co = customer_orders(spark, [("2910", "10013700", 9999.0, 8.0)])
    t = target(spark, [("2910", "10013700", "Alimentias", "13700", "TEST", 10.0)])
    assert row(g.ordering_grid(tagged(spark, co=co), t), "2910", "10013700").Risk_Status == "Critical"


def test_override_lowers_suggestion_exactly(spark):
    t = target(spark, [("2910", "10013700", "Alimentias", "13700", "TEST", 100.0)])
    grid = g.ordering_grid(tagged(spark), t)
    base = row(grid, "2910", "10013700").Suggested_Order_Qty
    ov = spark.createDataFrame([("2910", "10013700", -20.0, "test")],
                               "Plant string, Material string, Manual_Override double, Planner_Note string")
    r = row(apply_overrides(grid, ov), "2910", "10013700")
    assert r.Suggested_Order_Qty == base - 20 and r.Planner_Note == "test"


def test_one_shuffle_grid_equals_join_form(spark):
    one = g.ordering_grid(tagged(spark), target(spark))
    two = g.grid_join_form(customer_orders(spark), on_hand(spark), open_orders(spark), target(spark))
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)


def test_grid_rows_equal_distinct_keys(spark):
    grid = g.ordering_grid(tagged(spark), target(spark))
    assert grid.count() == tagged(spark).select("Plant", "Material").distinct().count()
    assert not any(math.isnan(x) for x in [r.Projected_Balance for r in grid.collect()])
