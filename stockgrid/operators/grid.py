"""The ordering grid: one row per active (Plant, Material).

``ordering_grid`` is the flagship plan. The three source kinds arrive as one
tagged frame, so the key union and the three null-safe left joins of the
classic formulation collapse into a single ``groupBy``: one shuffle,
partial aggregation before it, every key active by construction, and null
keys grouped naturally. The grid then meets the target lookup in one left
join on the same key (both sides already hash-partitioned on it).

``grid_join_form`` keeps the classic formulation (three aggregates, key
union, three ``<=>`` joins) as an independent cross-check.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.functions import grouped
from stockgrid.operators.aggregate import (
    CUSTOMER_ORDER_SUMS, KEY, ON_HAND_DATES, ON_HAND_SUMS, OPEN_ORDER_DATES, agg_customer_orders, agg_on_hand,
    agg_open_orders, open_order_sums, unconfirmed,
)
from stockgrid.operators.target import TARGET_COLUMNS

# FIXED VALUES: quantity columns and the grid's columns in order
QTY_COLUMNS = [
    "Unrestricted_On_Hand", "Quality_Inspection_Qty", "Blocked_Stock_Qty",
    "Customer_Order_Qty", "Confirmed_Qty", "Unconfirmed_Qty",
    "Open_PO_Qty", "PO_Request_Qty", "Inbound_Delivery_Qty", "Allocation_Qty",
]

GRID_COLUMNS = [
    "Plant", "Material", "Unrestricted_On_Hand", "Quality_Inspection_Qty", "Blocked_Stock_Qty",
    "Earliest_Expiry_Date", "Customer_Order_Qty", "Confirmed_Qty", "Unconfirmed_Qty",
    "Open_PO_Qty", "PO_Request_Qty", "Inbound_Delivery_Qty", "Next_PO_Delivery_Date",
    "Allocation_Qty", "Supplier", "TOL_Material", "Description", "Target_Stock",
    "Available_Plus_Incoming", "Projected_Balance", "Manual_Override", "Planner_Note",
    "Has_Target", "Suggested_Order_Qty", "Safety_Stock", "Risk_Status",
]


def with_position(grid: DataFrame) -> DataFrame:
    """Quantities default to 0; available + incoming; balance."""
    qty = {c: f"COALESCE(CAST(`{c}` AS DOUBLE), 0.0D)" for c in QTY_COLUMNS}
    available = f"({qty['Unrestricted_On_Hand']} + {qty['Open_PO_Qty']})"
    others = [f"`{c}`" for c in grid.columns
              if c not in qty and c not in ("Available_Plus_Incoming", "Projected_Balance")]
    return grid.selectExpr(*others, *[f"{e} AS `{c}`" for c, e in qty.items()],
                           f"{available} AS Available_Plus_Incoming",
                           f"{available} - {qty['Customer_Order_Qty']} AS Projected_Balance")


def recommendation_sql(pct: float = config.SAFETY_STOCK_PCT) -> list[str]:
    """E4-E7 over Target_Stock, position, Unconfirmed_Qty, Manual_Override
    and Supplier.

    Suggested = ceil(max(target - available + unconfirmed + override, 0)),
    null without a target; safety = target * pct; status tested in the
    order Review, Critical, At Risk, Covered.
    """
    p = f"{float(pct)!r}D"
    has_target = "`Target_Stock` IS NOT NULL"
    raw = "`Target_Stock` - `Available_Plus_Incoming` + `Unconfirmed_Qty` + `Manual_Override`"
    return [
        f"({has_target}) AS Has_Target",
        f"CASE WHEN {has_target} THEN CAST(CEIL(GREATEST({raw}, 0.0D)) AS DOUBLE) END AS Suggested_Order_Qty",
        f"CASE WHEN {has_target} THEN `Target_Stock` * {p} END AS Safety_Stock",
        f"CASE WHEN `Supplier` IS NULL OR NOT ({has_target}) THEN '{config.RISK_REVIEW}'"
        f" WHEN `Projected_Balance` < 0 THEN '{config.RISK_CRITICAL}'"
        f" WHEN `Projected_Balance` < `Target_Stock` * {p} THEN '{config.RISK_AT_RISK}'"
        f" ELSE '{config.RISK_COVERED}' END AS Risk_Status",
    ]


def with_recommendation(grid: DataFrame, pct: float = config.SAFETY_STOCK_PCT) -> DataFrame:
    """E4-E7 appended to (or replacing) the grid's recommendation columns."""
    derived = {"Has_Target", "Suggested_Order_Qty", "Safety_Stock", "Risk_Status"}
    return grid.selectExpr(*[f"`{c}`" for c in grid.columns if c not in derived], *recommendation_sql(pct))


def finished(joined: DataFrame, pct: float = config.SAFETY_STOCK_PCT, extra: Sequence[Column] = ()) -> DataFrame:
    """The grid's columns from measures joined with the target, and ``extra`` columns."""
    grid = with_position(joined)
    grid = grid.select("*", F.lit(0.0).alias("Manual_Override"), F.lit("").alias("Planner_Note"))
    return with_recommendation(grid, pct).select(*GRID_COLUMNS, *extra)


def _finish(keyed: DataFrame, target: DataFrame, pct: float) -> DataFrame:
    return finished(keyed.join(target.select(*TARGET_COLUMNS), on=KEY, how="left"), pct)


def key_measures(tagged: DataFrame, field_by_plant: dict[str, str] | None = None) -> DataFrame:
    """All per-key measures of the three kinds in one aggregation."""
    sums = ON_HAND_SUMS | CUSTOMER_ORDER_SUMS | open_order_sums(field_by_plant)
    return grouped(tagged, KEY, sums, ON_HAND_DATES | OPEN_ORDER_DATES).withColumn("Unconfirmed_Qty", unconfirmed())


def ordering_grid(tagged: DataFrame, target: DataFrame,
                  field_by_plant: dict[str, str] | None = None,
                  pct: float = config.SAFETY_STOCK_PCT) -> DataFrame:
    """The full grid from the tagged sources and the target lookup."""
    return _finish(key_measures(tagged, field_by_plant), target, pct)


def _null_safe_left(left: DataFrame, right: DataFrame) -> DataFrame:
    r = right.withColumnRenamed("Plant", "_rp").withColumnRenamed("Material", "_rm")
    cond = left.Plant.eqNullSafe(r._rp) & left.Material.eqNullSafe(r._rm)
    return left.join(r, cond, "left").drop("_rp", "_rm")


def grid_join_form(customer_orders: DataFrame, on_hand: DataFrame, open_orders: DataFrame,
                   target: DataFrame, field_by_plant: dict[str, str] | None = None,
                   pct: float = config.SAFETY_STOCK_PCT) -> DataFrame:
    """Three aggregates, distinct key union, three null-safe left joins."""
    oh = agg_on_hand(on_hand)
    co = agg_customer_orders(customer_orders)
    oo = agg_open_orders(open_orders, field_by_plant)
    keys = oh.select(*KEY).unionByName(co.select(*KEY)).unionByName(oo.select(*KEY)).distinct()
    keyed = _null_safe_left(_null_safe_left(_null_safe_left(keys, oh), co), oo)
    return _finish(keyed, target, pct)


def recompute(grid: DataFrame, pct: float = config.SAFETY_STOCK_PCT) -> DataFrame:
    """Re-derive Has_Target, suggestion, safety and status on a stored
    grid (e.g. after overrides) without re-aggregating."""
    return with_recommendation(grid, pct).select(*GRID_COLUMNS)
