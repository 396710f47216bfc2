"""Report tables behind the exports: export grid, executive summary,
supplier sections, unmatched report, reconciliation summary and the audit
text as ordered lines. Each is a small DataFrame built from the grid and
the quality results; nothing is assembled on the driver.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.functions.exact import states, total_sql, with_parts
from stockgrid.operators import quality
from stockgrid.operators.views import KPI_SUMS
from stockgrid.session import scratch_path

KEY = ["Plant", "Material"]

# FIXED VALUES: export column order and header labels
EXPORT_COLUMNS = (
    ("Supplier", "Supplier"), ("Plant", "Plant"), ("Material", "SAP Material"),
    ("TOL_Material", "TOL Material"), ("Description", "Description"),
    ("Target_Stock", "Target Stock (Forecast Baseline)"), ("Customer_Order_Qty", "Customer Order Qty"),
    ("Confirmed_Qty", "Confirmed Qty"), ("Unconfirmed_Qty", "Unconfirmed Qty"),
    ("Unrestricted_On_Hand", "Unrestricted On Hand"), ("Open_PO_Qty", "Open PO Qty"),
    ("Allocation_Qty", "Allocation Qty (plant policy)"), ("Inbound_Delivery_Qty", "Inbound Delivery Qty"),
    ("Available_Plus_Incoming", "Available + Incoming"), ("Projected_Balance", "Projected Balance"),
    ("Suggested_Order_Qty", "Suggested Order Qty"), ("Risk_Status", "Risk / Status"),
    ("Next_PO_Delivery_Date", "Next PO Delivery Date"), ("Earliest_Expiry_Date", "Earliest Expiry Date"),
)

# FIXED VALUES: executive-summary KPI labels, in order
KPI_LABELS = (
    ("active_materials", "Active materials"),
    ("total_unrestricted_on_hand", "Total unrestricted on-hand"),
    ("total_open_po_qty", "Total open PO quantity"),
    ("total_customer_order_qty", "Total customer-order quantity"),
    ("total_confirmed_qty", "Total confirmed customer-order quantity"),
    ("total_unconfirmed_qty", "Unconfirmed quantity"),
    ("materials_at_risk", "Materials at risk (Critical + At Risk)"),
    ("total_suggested_order_qty", "Suggested order quantity (total)"),
)
STATUS_SECTION = "Materials by Risk / Status"

# FIXED VALUES: unmatched-report reasons and audit report text
REASON_SOURCE = "In SAP source, not in product master"
REASON_MASTER = "In product master, no current SAP activity"
AUDIT_TITLE = "ORDERING DASHBOARD -- AUDIT REPORT"
AUDIT_VARIANCES = "-- Grand total variances --"
AUDIT_DUPLICATES = "-- Duplicate row counts (preserved, not deleted) --"
AUDIT_FILES = "-- File / schema validation --"
AUDIT_UNMATCHED = "-- Unmatched materials --"
AUDIT_WORKBOOK = "-- Reference workbook audit --"
AUDIT_WB_SHEETS = "  Sheets: "
AUDIT_WB_FORMULAS = "  Formulas: "
AUDIT_WB_REF = "  #REF! error formulas (never translated into dashboard logic): "
AUDIT_REFRESHED = "Refreshed: "
AUDIT_RECONCILIATION = "Reconciliation: "
AUDIT_PASS = "PASS"
AUDIT_FAIL = "FAIL"
AUDIT_UNMATCHED_LINE = " material(s) in source not in product master"
AUDIT_NO_ACTIVITY_HEAD = "  product_master: "
AUDIT_NO_ACTIVITY_LINE = " material(s) with no current SAP activity"


def write_table(spark: SparkSession, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return the path."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def materialize(spark: SparkSession, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives executor
    loss, and later readers get column pruning and partition pruning."""
    return spark.read.parquet(write_table(spark, df, name, partition_by))


def export_grid(grid: DataFrame) -> DataFrame:
    """L3: the 19 export columns under their labels (raw plant code)."""
    return grid.select(*[F.col(c).alias(label) for c, label in EXPORT_COLUMNS])


def executive_summary(grid: DataFrame) -> DataFrame:
    """L4: KPI (label, value) rows, then rows per risk status.

    One pass over the grid: ``rollup(Risk_Status)`` gives the per-status
    rows and the grand-total row in one aggregation; the total row expands
    to the eight KPI rows and each status row to its count row."""
    at_risk = F.col("Risk_Status").isin(*config.AT_RISK_STATUSES)
    agg = with_parts(grid, KPI_SUMS).rollup("Risk_Status").agg(
        F.grouping_id().alias("_total"), F.count(F.lit(1)).alias("_n"), F.count_if(at_risk).alias("materials_at_risk"),
        *states(KPI_SUMS))
    agg = agg.selectExpr("Risk_Status", "_total", "_n", "_n AS active_materials", "materials_at_risk",
                         *[f"{total_sql(c)} AS `{c}`" for c in KPI_SUMS])  # one row per key

    def row(section, ordinal, label, value):
        return F.struct(F.lit(section).alias("section"), F.lit(ordinal).alias("ordinal"),
                        label.alias("label"), value.cast("double").alias("value"))

    kpi_rows = F.array(*[row("KPI", i, F.lit(label), F.col(c)) for i, (c, label) in enumerate(KPI_LABELS)])
    status_row = F.array(row(STATUS_SECTION, 0, F.col("Risk_Status"), F.col("_n")))
    out = agg.select(F.explode(F.when(F.col("_total") == 1, kpi_rows).otherwise(status_row)).alias("r"))
    return out.select("r.section", "r.ordinal", "r.label", "r.value")


def supplier_sections(spark: SparkSession, grid: DataFrame, suppliers: Sequence[str]) -> DataFrame:
    """One section per configured supplier, in configured order, with
    its row count (0 when it has no rows); unknown suppliers get none."""
    dim = spark.createDataFrame([(i + 1, s) for i, s in enumerate(suppliers)], "ordinal int, supplier string")
    counts = (grid.filter(F.col("Supplier").isin(*suppliers))
              .groupBy(F.col("Supplier").alias("supplier")).agg(F.count(F.lit(1)).alias("n_rows")))
    # both sides are bounded by the configured list (a left join keeps every section)
    return (dim.join(counts, "supplier", "left")
            .select("ordinal", "supplier", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows")))


def unmatched_report(tagged: DataFrame, target: DataFrame) -> DataFrame:
    """Unmatched source keys per kind plus master keys without
    activity, one row each with its reason."""
    src = quality.unmatched_by_source(tagged, target).select(
        F.col("kind").alias("Source"), *KEY, F.lit(REASON_SOURCE).alias("Reason"))
    master = quality.master_no_activity(tagged, target).select(
        F.lit("product_master").alias("Source"), *KEY, F.lit(REASON_MASTER).alias("Reason"))
    return src.unionByName(master)


def _file_name(kind: Column, plant: Column) -> Column:
    """Configured upload file name of a (kind, plant)."""
    expr = None
    for fname, (k, p) in config.UPLOAD_FILE_MAP.items():
        cond = (kind == k) & (plant == p)
        expr = F.when(cond, F.lit(fname)) if expr is None else expr.when(cond, F.lit(fname))
    return expr.otherwise(F.concat_ws(" ", kind, plant))


def _lines(df: DataFrame, section_no: int, line_no: Column, line: Column) -> DataFrame:
    return df.select(F.lit(section_no).alias("section_no"), line_no.cast("int").alias("line_no"),
                     line.alias("line"))


def audit_lines(spark: SparkSession, variances: DataFrame, duplicates: DataFrame, status: DataFrame,
                unmatched_counts: DataFrame, no_activity_count: DataFrame, refreshed: str,
                workbook_totals: DataFrame | None = None) -> DataFrame:
    """The audit report as ordered (section_no, line_no, line) rows.
    ``status`` has kind, plant, status and error text of every file.
    ``workbook_totals`` (one row: sheets, formulas, ref_errors) adds the
    workbook-audit section."""
    gate = quality.reconciliation_gate(variances)
    head = spark.createDataFrame([(0, 0, AUDIT_TITLE), (0, 1, AUDIT_REFRESHED + refreshed)],
                                 "section_no int, line_no int, line string")
    verdict = _lines(gate, 0, F.lit(2), F.concat(F.lit(AUDIT_RECONCILIATION),
                                                F.when(F.col("passed"), AUDIT_PASS).otherwise(AUDIT_FAIL)))
    fixed = spark.createDataFrame(
        [(0, 3, ""), (1, 0, AUDIT_VARIANCES), (2, 0, ""), (2, 1, AUDIT_DUPLICATES),
         (3, 0, ""), (3, 1, AUDIT_FILES), (4, 0, ""), (4, 1, AUDIT_UNMATCHED)],
        "section_no int, line_no int, line string")
    metric_no = F.lit(None)
    for i, (m, _, _) in enumerate(quality.RECONCILED_METRICS):
        metric_no = F.when(F.col("metric") == m, F.lit(i + 1)) if i == 0 else metric_no.when(
            F.col("metric") == m, F.lit(i + 1))
    var_lines = _lines(variances, 1, metric_no, F.concat(
        F.lit("  "), F.col("metric"), F.lit(": source="), F.format_number("source_total", 2),
        F.lit(" dashboard="), F.format_number("dashboard_total", 2),
        F.lit(" variance="), F.format_number("variance", 2)))
    kind_no = F.when(F.col("kind") == "customer_orders", 1).when(F.col("kind") == "on_hand", 2).otherwise(3)
    dup_lines = _lines(duplicates, 2, kind_no + 1, F.concat(
        F.lit("  "), F.col("kind"), F.lit(": "), F.col("duplicate_rows").cast("string")))
    plant_no = F.when(F.col("plant") == "2910", 1).when(F.col("plant") == "2920", 2).otherwise(3)
    error = F.coalesce(F.concat(F.lit(" -- "), F.col("error")), F.lit(""))
    file_lines = _lines(status, 3, kind_no * 3 + plant_no - 2, F.concat(
        F.lit("  "), _file_name(F.col("kind"), F.col("plant")), F.lit(": "), F.col("status"), error))
    unm_lines = _lines(unmatched_counts, 4, kind_no + 1, F.concat(
        F.lit("  "), F.col("kind"), F.lit(": "), F.col("n").cast("string"),
        F.lit(AUDIT_UNMATCHED_LINE)))
    master_line = _lines(no_activity_count, 4, F.lit(5), F.concat(
        F.lit(AUDIT_NO_ACTIVITY_HEAD), F.col("n").cast("string"), F.lit(AUDIT_NO_ACTIVITY_LINE)))
    parts = [verdict, fixed, var_lines, dup_lines, file_lines, unm_lines, master_line]
    if workbook_totals is not None:
        wb = workbook_totals
        parts += [
            spark.createDataFrame([(5, 0, ""), (5, 1, AUDIT_WORKBOOK)], "section_no int, line_no int, line string"),
            _lines(wb, 5, F.lit(2), F.concat(F.lit(AUDIT_WB_SHEETS), F.col("sheets").cast("string"))),
            _lines(wb, 5, F.lit(3), F.concat(F.lit(AUDIT_WB_FORMULAS), F.col("formulas").cast("string"))),
            _lines(wb, 5, F.lit(4), F.concat(F.lit(AUDIT_WB_REF), F.col("ref_errors").cast("string"))),
        ]
    out = head
    for p in parts:
        out = out.unionByName(p)
    return out
