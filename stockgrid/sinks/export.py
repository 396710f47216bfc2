"""Sinks: CSV of a view (L1) and the gated multi-section export (L2).

An export is a run: every section is written below ``<out>/run=<n>`` and the run's manifest, the list of its sections, comes
last. Readers go by the newest manifest (``current_export``), so a run that fails part-way changes nothing, and its folder
is overwritten by the next try. Nothing is written unless the reconciliation gate passes.

Raw sections carry the source's headers and all its columns, and their rows in the order of the source: ranges of (file,
block, row) are sorted by tasks, and part files follow that order. A supplier or a kind and plant without rows has a section
with just its header.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stockgrid import config
from stockgrid.operators import onepass, reports
from stockgrid.sources.snapshots import read_or_empty


class ExportBlocked(RuntimeError):
    """Raised when a reconciliation variance is non-zero."""


# standard CSV: quotes doubled inside quoted fields, blanks kept
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
SOURCE_ORDER = ["_source_file", "_block", "_row_id"]
_MANIFEST = StructType([StructField("section", StringType()), StructField("path", StringType()), StructField("run", LongType())])
# FIXED VALUES: section names of the raw kinds
RAW_LABELS = {"customer_orders": "Customer Orders", "on_hand": "On Hand", "open_orders": "Open Orders"}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """L1: a view as CSV with a header line (one file per partition)."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return path


def folder_name(value: str) -> str:
    """A partition value as Spark writes it in a folder name."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in '"#%\'*/:=?\\\x7f{[]^' else c for c in value)


def current_run(spark: SparkSession, out_dir: str) -> int:
    """The number of the newest whole export; 0 if there is none."""
    newest = read_or_empty(spark, f"{out_dir.rstrip('/')}/manifests", _MANIFEST).agg(F.max("run").alias("n")).first()["n"]
    return newest or 0


def current_export(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """Sections of the newest whole export: name -> folder. As many as kinds, plants and configured suppliers ask for."""
    rows = read_or_empty(spark, f"{out_dir.rstrip('/')}/manifests", _MANIFEST)
    run = current_run(spark, out_dir)
    return {r["section"]: r["path"] for r in rows.where(F.col("run") == run).collect()}


def raw_columns(kind: str) -> list[Column]:
    """A kind's columns under the headers of its source, in their order."""
    return [F.col(config.physical_name(h)).alias(h) for h in config.HEADERS_BY_KIND[kind]]


def _write_split(df: DataFrame, section: Column, names: Sequence[str], order: Sequence[str], columns: Sequence[Column],
                 path: str) -> dict[str, str]:
    """Rows of each section as CSV in ``order``, in a folder of its own, also where there are none."""
    split = df.withColumn("section", section).where(F.col("section").isin(*names))
    # ranges of the section and the order; the sort begins with the partition column, so the writer adds no other
    ordered = split.repartitionByRange("section", *order).sortWithinPartitions("section", *order).select(*columns, "section")
    ordered.write.mode("overwrite").options(**CSV_OPTIONS).partitionBy("section").csv(path)
    found = {r["section"] for r in split.select("section").distinct().collect()}    # of ``names`` at most
    empty = df.sparkSession.createDataFrame([], ordered.drop("section").schema).coalesce(1)
    for name in names:
        if name not in found:
            write_csv(empty, f"{path}/section={folder_name(name)}")
    return {name: f"{path}/section={folder_name(name)}" for name in names}


def export_bundle(out_dir: str, stored: onepass.Stored, dashboard: DataFrame, duplicates: DataFrame,
                  files: DataFrame | None = None, audit: DataFrame | None = None, refreshed: str = "",
                  suppliers: Sequence[str] = config.SUPPLIERS, plants: Sequence[str] = config.PLANTS) -> dict[str, str]:
    """L2: summary, grid, one section a supplier, reconciliation with duplicates and file checks, unmatched materials, raw
    rows of kind and plant, the whole report and the audit. The gate reconciles the stored grid; ``dashboard`` (overrides
    applied) is what is exported; ``files`` is the upload manifest. Returns name -> folder, as ``current_export`` does."""
    spark = dashboard.sparkSession
    verdict = onepass.gate(stored).first()    # one row
    if not verdict["passed"]:
        raise ExportBlocked("reconciliation variances are non-zero; export blocked")
    run = current_run(spark, out_dir) + 1
    base = f"{out_dir.rstrip('/')}/run={run}"
    dash = reports.materialize(spark, dashboard, "export-grid")
    written: dict[str, str] = {}

    def put(name: str, df: DataFrame) -> None:
        written[name] = write_csv(df, f"{base}/{name}")

    put("stamp", spark.createDataFrame([(refreshed, "PASS -- all variances zero", verdict["n_metrics"])],
                                       "refreshed string, reconciliation string, metrics long"))
    put("executive_summary", reports.executive_summary(dash))
    put("ordering_dashboard", reports.export_grid(dash.orderBy("Plant", "Material")))
    put("supplier_sections", reports.supplier_sections(spark, dash, suppliers))
    labelled = [F.col(c).alias(label) for c, label in reports.EXPORT_COLUMNS]
    written |= _write_split(dash, F.col("Supplier"), list(suppliers), ["Plant", "Material"], labelled, f"{base}/suppliers")
    put("reconciliation", onepass.variances(stored))
    put("duplicate_rows", duplicates)
    if files is not None:
        put("file_validation", files.select("file_name", "kind", "plant", "status", "row_count", "error"))
    put("unmatched_materials", onepass.unmatched_report(stored).orderBy("Source", "Plant", "Material"))
    put("reconciliation_report", onepass.report(stored, duplicates))
    for kind, label in RAW_LABELS.items():
        if kind in stored.columns_by_kind and set(SOURCE_ORDER) <= set(stored.rows.columns):
            names = {p: f"{label} {p}" for p in plants}
            written |= _write_split(stored.rows.where(F.col("kind") == kind), F.concat(F.lit(f"{label} "), F.col("Plant")),
                                    list(names.values()), SOURCE_ORDER, raw_columns(kind), f"{base}/raw_{kind}")
    if audit is not None:
        # the audit text has one line per kind, file and metric: a bounded, tiny output
        audit.orderBy("section_no", "line_no").select("line").coalesce(1).write.mode("overwrite").text(f"{base}/audit")
        written["audit"] = f"{base}/audit"
    pointer = spark.createDataFrame(list(written.items()), "section string, path string")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/manifests/run={run}")
    return written
