"""Per-kind aggregates by the composite key (Plant, Material).

Null keys are real groups (``groupBy`` keeps them). Sums are exact
(``functions.exact``), so a key whose values are all missing sums to 0 and totals do
not depend on partitioning. Every aggregate here is partial/final: rows are
combined map-side before the shuffle, so a hot key costs one row per
partition on the wire.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.functions import grouped

KEY = ["Plant", "Material"]


def allocation_source_sql(field_by_plant: dict[str, str] | None = None) -> str:
    """The plant's configured open-order field (null for other plants), as
    SQL text so the exact sum over it is built in one call."""
    field_by_plant = field_by_plant or config.ALLOCATION_FIELD_BY_PLANT
    if not field_by_plant:
        return "CAST(NULL AS DOUBLE)"
    arms = " ".join(f"WHEN `Plant` = '{p}' THEN `{f}`" for p, f in field_by_plant.items())
    return f"CASE {arms} END"


# totals and earliest dates of each kind, by output column
ON_HAND_SUMS = {"Unrestricted_On_Hand": "unrestricted", "Quality_Inspection_Qty": "quality", "Blocked_Stock_Qty": "blocked"}
ON_HAND_DATES = {"Earliest_Expiry_Date": "min(expiry)"}
CUSTOMER_ORDER_SUMS = {"Customer_Order_Qty": "order_qty", "Confirmed_Qty": "confirmed_qty"}
OPEN_ORDER_DATES = {"Next_PO_Delivery_Date": "min(delivery_date)"}


def open_order_sums(field_by_plant: dict[str, str] | None = None) -> dict[str, str]:
    return {"Open_PO_Qty": "open_po_qty", "PO_Request_Qty": "po_request_qty", "Inbound_Delivery_Qty": "inbound_qty",
            "Allocation_Qty": allocation_source_sql(field_by_plant)}


def unconfirmed() -> Column:
    """Unconfirmed = max(ordered - confirmed, 0) after summing."""
    return F.greatest(F.col("Customer_Order_Qty") - F.col("Confirmed_Qty"), F.lit(0.0))


def agg_on_hand(on_hand: DataFrame) -> DataFrame:
    return grouped(on_hand, KEY, ON_HAND_SUMS, ON_HAND_DATES)


def agg_customer_orders(customer_orders: DataFrame) -> DataFrame:
    return grouped(customer_orders, KEY, CUSTOMER_ORDER_SUMS).withColumn("Unconfirmed_Qty", unconfirmed())


def agg_open_orders(open_orders: DataFrame, field_by_plant: dict[str, str] | None = None) -> DataFrame:
    """Open-order sums; Allocation_Qty is null for a plant without a
    configured field (the grid turns it into 0)."""
    field_by_plant = field_by_plant or config.ALLOCATION_FIELD_BY_PLANT
    configured = F.col("Plant").isin(*field_by_plant.keys())
    out = grouped(open_orders, KEY, open_order_sums(field_by_plant), OPEN_ORDER_DATES)
    return out.withColumn("Allocation_Qty", F.when(configured, F.col("Allocation_Qty")))


def agg_allocation(open_orders: DataFrame, field_by_plant: dict[str, str] | None = None) -> DataFrame:
    """Allocation per key of configured plants only, one pass."""
    field_by_plant = field_by_plant or config.ALLOCATION_FIELD_BY_PLANT
    return grouped(open_orders.filter(F.col("Plant").isin(*field_by_plant.keys())), KEY,
                   {"Allocation_Qty": allocation_source_sql(field_by_plant)})


def tag_sources(customer_orders: DataFrame | None, on_hand: DataFrame | None,
                open_orders: DataFrame | None) -> DataFrame:
    """Union separately loaded kinds into the tagged shape ``ordering_grid``
    reads (kind + every kind's columns, missing ones null)."""
    parts = []
    for kind, df in (("customer_orders", customer_orders), ("on_hand", on_hand),
                     ("open_orders", open_orders)):
        if df is not None:
            parts.append(df.withColumn("kind", F.lit(kind)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for c in config.QUANTITY_FIELDS_BY_KIND["customer_orders"] + config.QUANTITY_FIELDS_BY_KIND["on_hand"] \
            + config.QUANTITY_FIELDS_BY_KIND["open_orders"]:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    for c in ("expiry", "delivery_date"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    return out
