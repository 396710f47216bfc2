"""Grid, aggregates and target lookup over the shared tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockgrid.operators import aggregate as agg
from stockgrid.operators import grid as g
from stockgrid.operators import target as t
from stockgrid.plans.oracle_base import with_views, xsum
from stockgrid.plans.registry import query
from stockgrid.sources import testdata as td

GRID_COLS = ", ".join(g.GRID_COLUMNS)


def load_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.target_lookup(td.product_master(spark, sf_dir))


def load_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship grid (one scan, one join to orders, one key shuffle)."""
    return g.ordering_grid(td.source_rows(spark, sf_dir), load_target(spark, sf_dir))


@query("ordering_grid", "E9/C2/C3", with_views(f"select {GRID_COLS} from grid", "grid"))
def q_ordering_grid(spark, sf_dir):
    return load_grid(spark, sf_dir)


@query("grid_join_form", "C1", with_views(f"select {GRID_COLS} from grid", "grid"))
def q_grid_join_form(spark, sf_dir):
    return g.grid_join_form(td.customer_orders(spark, sf_dir), td.on_hand(spark, sf_dir),
                            td.open_orders(spark, sf_dir), load_target(spark, sf_dir))


@query("agg_on_hand", "D1", with_views("select * from oh_agg", "oh_agg"))
def q_agg_on_hand(spark, sf_dir):
    return agg.agg_on_hand(td.on_hand(spark, sf_dir))


@query("agg_customer_orders", "D2", with_views("select * from co_agg", "co_agg"))
def q_agg_customer_orders(spark, sf_dir):
    return agg.agg_customer_orders(td.customer_orders(spark, sf_dir))


@query("agg_open_orders", "D3", with_views("select * from oo_agg", "oo_agg"))
def q_agg_open_orders(spark, sf_dir):
    return agg.agg_open_orders(td.open_orders(spark, sf_dir))


@query("agg_allocation", "D4", with_views("select * from alloc", "alloc"))
def q_agg_allocation(spark, sf_dir):
    return agg.agg_allocation(td.open_orders(spark, sf_dir))


@query("target_lookup", "F1", with_views("select * from target", "target"))
def q_target_lookup(spark, sf_dir):
    return load_target(spark, sf_dir)


@query("master_duplicates", "F3", with_views(
    "select Plant, Material, Supplier, TOL_Material, Description, Latest_Forecast_Qty "
    "from master_ranked where rn > 1", "master_ranked"))
def q_master_duplicates(spark, sf_dir):
    return t.master_duplicates(td.product_master(spark, sf_dir))


@query("product_master_clean", "A10", with_views(
    "select Plant, Material, Supplier, TOL_Material, Description, Latest_Forecast_Qty from product_master "
    "where Plant is not null and Material is not null", "product_master"))
def q_product_master_clean(spark, sf_dir):
    return t.clean_master(td.product_master(spark, sf_dir))


@query("active_keys", "F2", with_views("select Plant, Material from grid_keys", "grid_keys"))
def q_active_keys(spark, sf_dir):
    src = td.source_rows(spark, sf_dir)
    return src.select("Plant", "Material").distinct()


@query("projected_position", "E1-E3", with_views(
    "select Plant, Material, Unrestricted_On_Hand, Open_PO_Qty, Customer_Order_Qty, "
    "Available_Plus_Incoming, Projected_Balance from grid_pos", "grid_pos"))
def q_projected_position(spark, sf_dir):
    return load_grid(spark, sf_dir).select(
        "Plant", "Material", "Unrestricted_On_Hand", "Open_PO_Qty", "Customer_Order_Qty",
        "Available_Plus_Incoming", "Projected_Balance")


@query("suggested_orders", "E4-E6", with_views(
    "select Plant, Material, Target_Stock, Available_Plus_Incoming, Unconfirmed_Qty, Manual_Override, "
    "Has_Target, Suggested_Order_Qty, Safety_Stock from grid", "grid"))
def q_suggested_orders(spark, sf_dir):
    return load_grid(spark, sf_dir).select(
        "Plant", "Material", "Target_Stock", "Available_Plus_Incoming", "Unconfirmed_Qty",
        "Manual_Override", "Has_Target", "Suggested_Order_Qty", "Safety_Stock")


@query("risk_status", "E7", with_views(
    "select Plant, Material, Supplier, Target_Stock, Projected_Balance, Safety_Stock, Risk_Status from grid",
    "grid"))
def q_risk_status(spark, sf_dir):
    return load_grid(spark, sf_dir).select(
        "Plant", "Material", "Supplier", "Target_Stock", "Projected_Balance", "Safety_Stock", "Risk_Status")


@query("combined_rows", "H1", with_views(
    "select 'customer_orders' as kind, Plant, count(*) as n_rows, "
    f"{xsum('order_qty')} as qty from customer_orders group by Plant "
    "union all select 'on_hand', Plant, count(*), "
    f"{xsum('unrestricted')} from on_hand group by Plant "
    "union all select 'open_orders', Plant, count(*), "
    f"{xsum('open_po_qty')} from open_orders group by Plant",
    "customer_orders", "on_hand", "open_orders"))
def q_combined_rows(spark, sf_dir):
    """H1: the union-all of the kinds keeps every row (per-plant files
    concatenated, duplicates kept); checked through per-plant counts."""
    from stockgrid.functions import grouped
    src = td.source_rows(spark, sf_dir)
    qty = ("CASE kind WHEN 'customer_orders' THEN order_qty WHEN 'on_hand' THEN unrestricted ELSE open_po_qty END")
    return grouped(src, ["kind", "Plant"], {"qty": qty}, {"n_rows": "count(1)"})

