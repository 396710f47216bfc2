"""Supplier sheets as a long ``cells`` table built from ``part``.

cells(sheet, row_no, col_no, value, formula): one row per non-empty cell,
one sheet per brand, header labels on row 3, one data row per part from
row 4 in part-key order. ``value`` is the cell's value, ``formula`` its
formula text when it has one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockgrid.functions.ranking import row_number_within
from stockgrid.session import app_id
from stockgrid.sources.testdata import read_table

# header labels of the generated sheets (col_no, label)
HEADER = ((1, "Plant #"), (2, "SAP #"), (3, "TOL #"), (4, "Product"), (5, "Forecast AS400"),
          (6, "2024 Forecast"), (7, "Current Month"), (9, "SAP #"))
NO_SAP_SHEETS = ("Brand#2", "Brand#5")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("sheet"), "p_partkey", "p_name", "p_size")
    r = row_number_within(part, ["sheet"], ["p_partkey"], out_col="_rn")
    r = r.withColumn("row_no", (F.col("_rn") + 3).cast("int")).drop("_rn")
    pk, size = F.col("p_partkey"), F.col("p_size")
    pks = pk.cast("string")
    no_sap = F.col("sheet").isin(*NO_SAP_SHEETS)
    null_s = F.lit(None).cast("string")

    sheets = part.select("sheet").distinct()
    hdr = F.array(*[F.struct(F.lit(c).alias("col_no"), F.lit(v).alias("label")) for c, v in HEADER])
    header = (sheets.select("sheet", F.explode(hdr).alias("h"))
              .select("sheet", F.lit(3).alias("row_no"), F.col("h.col_no").alias("col_no"),
                      F.col("h.label").alias("value"), null_s.alias("formula"))
              .filter(~((F.col("col_no") == 2) & no_sap)))

    def cell(df, col_no, value, formula=null_s):
        return df.select("sheet", "row_no", F.lit(col_no).alias("col_no"), value.alias("value"),
                         formula.alias("formula"))

    plant = (F.when(pk % 3 == 0, F.lit("2910")).when(pk % 3 == 1, F.lit("2920.0")).otherwise(F.lit("2930")))
    c1 = cell(r.filter(pk % 11 != 0), 1, plant)
    c2 = cell(r.filter(~no_sap & (pk % 17 != 0)), 2, F.concat(F.lit("100"), pks, F.lit(".0")),
              F.concat(F.lit("=100&C"), F.col("row_no").cast("string")))
    c3 = cell(r.filter(pk % 13 != 0), 3, pks)
    c4 = cell(r, 4, F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    c5 = cell(r.filter(size % 5 != 0), 5, size.cast("string"))
    c6 = cell(r, 6, F.when(size % 4 == 0, F.lit("#REF!")).when(size % 4 == 1, F.lit("n/a"))
              .when(size % 4 == 2, F.lit(" ")).otherwise((size * 2).cast("string")))
    c7 = cell(r.filter(pk % 3 == 0), 7, F.lit("#REF!"), F.lit("=XLOOKUP(#REF!,A1)"))
    out = header
    for c in (c1, c2, c3, c4, c5, c6, c7):
        out = out.unionByName(c)
    return out


_WRITTEN: dict[tuple[str, str], str] = {}


def cells_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cells`` written once per application and input folder as Parquet
    under the shared checkpoint folder, then read back: the profiling and
    master-build jobs read a stored table, as they would in production,
    instead of regenerating it in every plan."""
    from stockgrid.operators.reports import write_table
    key = (app_id(spark), sf_dir.rstrip("/"))
    if key not in _WRITTEN:
        _WRITTEN[key] = write_table(spark, cells(spark, sf_dir), "cells")
    return spark.read.parquet(_WRITTEN[key])
