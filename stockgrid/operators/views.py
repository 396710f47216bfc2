"""Dashboard consumption: filters, facets, KPIs, chart tables, top-k,
display projections and supplier views over the (overridden) grid."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.functions import grouped

KEY = ["Plant", "Material"]

# display labels of the dashboard grid, in display order (fixed values)
DISPLAY_LABELS = (
    ("Supplier", "Supplier/brand"), ("Plant", "Plant"), ("Material", "SAP Material"),
    ("TOL_Material", "TOL Material"), ("Description", "Product"),
    ("Target_Stock", "Forecast (Target Stock)"), ("Customer_Order_Qty", "Customer Order Qty"),
    ("Confirmed_Qty", "Confirmed Qty"), ("Unconfirmed_Qty", "Unconfirmed Qty"),
    ("Unrestricted_On_Hand", "Unrestricted On Hand"), ("Open_PO_Qty", "Open PO Qty"),
    ("Inbound_Delivery_Qty", "Inbound Delivery Qty"), ("Available_Plus_Incoming", "Available + Incoming"),
    ("Projected_Balance", "Projected Balance"), ("Suggested_Order_Qty", "Suggested Order Qty"),
    ("Risk_Status", "Risk/Status"), ("Next_PO_Delivery_Date", "Next PO Delivery Date"),
    ("Earliest_Expiry_Date", "Earliest Expiry Date"),
)

# FIXED VALUES: totals among the dashboard's KPIs
KPI_SUMS = {
    "total_unrestricted_on_hand": "Unrestricted_On_Hand", "total_open_po_qty": "Open_PO_Qty",
    "total_customer_order_qty": "Customer_Order_Qty", "total_confirmed_qty": "Confirmed_Qty",
    "total_unconfirmed_qty": "Unconfirmed_Qty", "total_suggested_order_qty": "Suggested_Order_Qty",
}

# FIXED VALUES: supplier detail tabs, id columns + the tab's measures
SUPPLIER_VIEWS = {
    "identification": ["Plant", "Material", "TOL_Material", "Description"],
    "forecast": ["Plant", "Material", "Target_Stock", "Safety_Stock"],
    "orders": ["Plant", "Material", "Customer_Order_Qty", "Confirmed_Qty", "Unconfirmed_Qty"],
    "on_hand": ["Plant", "Material", "Unrestricted_On_Hand", "Quality_Inspection_Qty",
                "Blocked_Stock_Qty", "Earliest_Expiry_Date"],
    "open_pos": ["Plant", "Material", "Open_PO_Qty", "Allocation_Qty", "Inbound_Delivery_Qty",
                 "Next_PO_Delivery_Date"],
    "position": ["Plant", "Material", "Available_Plus_Incoming", "Projected_Balance"],
}


def plant_name(plant: Column) -> Column:
    """Configured plant name, '' when unknown (a CASE over the fixed map)."""
    expr = None
    for code, name in config.PLANT_NAMES.items():
        expr = F.when(plant == code, F.lit(name)) if expr is None else expr.when(plant == code, F.lit(name))
    return expr.otherwise(F.lit(""))


def plant_label(plant: Column) -> Column:
    """B2: '<code> <name>'."""
    return F.concat(plant, F.lit(" "), plant_name(plant))


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def regex_search(c: Column, pattern: str) -> Column:
    """Case-insensitive regex search; null text never matches."""
    return F.coalesce(c.cast("string").rlike(f"(?i){pattern}"), F.lit(False))


def filter_grid(grid: DataFrame, plant: str | None = None, suppliers: Sequence[str] | None = None,
                material_pattern: str | None = None, description_pattern: str | None = None,
                action_only: bool = False, months: Sequence[str] | None = None) -> DataFrame:
    """Every filter optional, all combined with AND. Plant and
    Material are grouping keys of the grid, so their predicates are pushed
    below the aggregation by Catalyst."""
    conds = []
    if plant:
        conds.append(F.col("Plant") == plant)
    if suppliers:
        conds.append(F.col("Supplier").isin(*suppliers))
    if material_pattern:
        conds.append(regex_search(F.col("Material"), material_pattern))
    if description_pattern:
        conds.append(regex_search(F.col("Description"), description_pattern))
    if action_only:
        conds.append(F.col("Risk_Status").isin(*config.ACTION_STATUSES))
    if months:
        conds.append(F.coalesce(month_of(F.col("Next_PO_Delivery_Date")).isin(*months), F.lit(False)))
    out = grid
    for c in conds:
        out = out.filter(c)
    return out


def facets(grid: DataFrame) -> DataFrame:
    """Distinct non-null suppliers, plants and delivery months, from
    one pass over the grid (each row yields its three (facet, value) pairs)."""
    pairs = F.array(
        F.struct(F.lit("supplier").alias("facet"), F.col("Supplier").alias("value")),
        F.struct(F.lit("plant").alias("facet"), F.col("Plant").alias("value")),
        F.struct(F.lit("month").alias("facet"), month_of(F.col("Next_PO_Delivery_Date")).alias("value")))
    return (grid.select(F.explode(pairs).alias("p")).select("p.facet", "p.value")
            .filter(F.col("value").isNotNull()).distinct().orderBy("facet", "value"))


def kpis(grid: DataFrame) -> DataFrame:
    """The eight dashboard KPIs in one global aggregate. The grid has one row per key, so keys are counted as rows."""
    at_risk = "Risk_Status IN (" + ", ".join(f"'{x}'" for x in config.AT_RISK_STATUSES) + ")"
    totals = grouped(grid, [], KPI_SUMS, {"active_materials": "count(1)", "materials_at_risk": f"count_if({at_risk})"})
    return totals.select("active_materials", *list(KPI_SUMS)[:5], "materials_at_risk", "total_suggested_order_qty")


def plant_metrics(grid: DataFrame) -> DataFrame:
    """On hand vs customer demand per plant (null plant is a group)."""
    return grouped(grid, ["Plant"], {"On_Hand": "Unrestricted_On_Hand", "Customer_Demand": "Customer_Order_Qty"})


def plant_metrics_long(grid: DataFrame) -> DataFrame:
    """Wide -> long (Plant label, Metric, Qty)."""
    wide = plant_metrics(grid).withColumn("Plant", plant_label(F.col("Plant")))
    return wide.unpivot("Plant", ["On_Hand", "Customer_Demand"], "Metric", "Qty")


def open_po_by_month(grid: DataFrame) -> DataFrame:
    """Open PO quantity by month of each key's next delivery."""
    dated = grid.filter(F.col("Next_PO_Delivery_Date").isNotNull())
    dated = dated.withColumn("Month", month_of(F.col("Next_PO_Delivery_Date")))
    return grouped(dated, ["Month"], {"Open_PO_Qty": "Open_PO_Qty"}).orderBy("Month")


def suggested_by_supplier(grid: DataFrame) -> DataFrame:
    """Suggested quantity per supplier, kept when > 0, largest first."""
    return (grouped(grid, ["Supplier"], {"Suggested_Order_Qty": "Suggested_Order_Qty"})
            .filter(F.col("Suggested_Order_Qty") > 0)
            .orderBy(F.col("Suggested_Order_Qty").desc(), F.col("Supplier").asc_nulls_first()))


def status_counts(grid: DataFrame) -> DataFrame:
    """Rows per risk status, most frequent first."""
    return (grid.groupBy("Risk_Status").agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(F.col("n_rows").desc(), "Risk_Status"))


def top_at_risk(grid: DataFrame, k: int = 10) -> DataFrame:
    """G1: the k Critical / At Risk keys with the lowest projected balance
    (a top-k: TakeOrderedAndProject, no full sort)."""
    return (grid.filter(F.col("Risk_Status").isin(*config.AT_RISK_STATUSES))
            .orderBy("Projected_Balance", "Plant", "Material")
            .select("Plant", "Material", "Description", "Projected_Balance", "Risk_Status")
            .limit(k))


def grid_display(grid: DataFrame) -> DataFrame:
    """B1 + B2: the 18 display columns with their labels, plant labelled."""
    cols = []
    for c, label in DISPLAY_LABELS:
        expr = plant_label(F.col("Plant")) if c == "Plant" else F.col(c)
        cols.append(expr.alias(label))
    return grid.select(*cols)


def supplier_slice(grid: DataFrame, supplier: str, plants: Sequence[str] | None = None) -> DataFrame:
    """One supplier's keys, optionally restricted to plants."""
    out = grid.filter(F.col("Supplier") == supplier)
    if plants:
        out = out.filter(F.col("Plant").isin(*plants))
    return out


def supplier_view(slice_: DataFrame, view: str) -> DataFrame:
    """One of the supplier tabs (column subsets)."""
    return slice_.select(*SUPPLIER_VIEWS[view])


def supplier_recommendation(slice_: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """B12 recommendation tab: suggestion and status with the key's saved
    override and note (0 and '' when none). A slice of the dashboard grid
    already carries the merged override and note; ``overrides`` is only
    needed for a slice of a grid without them."""
    if overrides is None:
        return slice_.select(*KEY, "Suggested_Order_Qty", "Risk_Status", "Manual_Override", "Planner_Note")
    o = overrides.select(*KEY, F.col("Manual_Override").alias("_o"), F.col("Planner_Note").alias("_n"))
    j = slice_.select(*KEY, "Suggested_Order_Qty", "Risk_Status").join(o, KEY, "left")
    return j.select(*KEY, "Suggested_Order_Qty", "Risk_Status",
                    F.coalesce(F.col("_o"), F.lit(0.0)).alias("Manual_Override"),
                    F.coalesce(F.col("_n"), F.lit("")).alias("Planner_Note"))


def raw_by_plant(kind_rows: DataFrame, plant: str) -> DataFrame:
    """One kind's raw rows of one plant (null / other plants excluded)."""
    return kind_rows.filter(F.col("Plant") == plant)


def raw_slices(tagged: DataFrame, plants: Sequence[str] = config.PLANTS) -> DataFrame:
    """B14 for every kind and configured plant at once: the slices are told apart by ``kind`` and ``Plant``."""
    return tagged.filter(F.col("Plant").isin(*plants))
