"""Product-master build and sheet profiling over a long ``cells`` table.

Instead of walking spreadsheets cell by cell, every step is a set-based
job over cells(sheet, row_no, col_no, value, formula) for any number of
sheets: label columns come from one aggregation of the header row, rows
are pivoted with conditional aggregates per (sheet, row) — a group bounded
by the sheet's width — and the right-most valid forecast is a ``max_by``
over already-filtered cells.

``value`` is what a cell shows; the "formula view" of a cell (its formula
text when it has one, else its value) is what headers and the formula
survey read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.functions import coerce_numeric, strip_ws
from stockgrid.functions.ranking import top_k_within

SHEET_COLUMNS = ["sheet", "plant_col", "sap_col", "tol_col", "desc_col",
                 "reconstructed_material_from_tol", "forecast_col_count"]
SLICE_ROWS = 20_000  # rows of a sheet that one task groups
MASTER_OUT = ["Supplier", "Plant", "Material", "TOL_Material", "Description",
              "Latest_Forecast_Qty", "Forecast_Source_Column"]


def shown() -> Column:
    """Formula view of a cell."""
    return F.coalesce(F.col("formula"), F.col("value"))


def clean_id(c: Column) -> Column:
    """Trimmed text; a trailing '.0' is cut when the text is digits once
    every '.0' is removed; blank -> null."""
    s = strip_ws(c)
    cut_tail = s.endswith(".0") & F.regexp_replace(s, r"\.0", "").rlike("^[0-9]+$")
    out = F.when(cut_tail, F.regexp_replace(s, r"\.0$", "")).otherwise(s)
    return F.when(out == "", F.lit(None).cast("string")).otherwise(out)


def with_sheet(cells: DataFrame, dim: DataFrame) -> DataFrame:
    """Join cells to ``dim``, a row per sheet with its ``max_row``. A sheet's rows are cut into slices of ``SLICE_ROWS`` rows and
    ``dim`` is repeated for as many slices as the sheet was measured to have, so a sheet with most of the cells is split over
    many tasks and a small one is not. The slice stays as ``_slice``: grouping by (sheet, _slice, row_no) then needs no
    further shuffle."""
    sliced = cells.withColumn("_slice", (F.col("row_no") / SLICE_ROWS).cast("int"))
    copies = dim.withColumn("_slice", F.explode(F.sequence(F.lit(0), (F.col("max_row") / SLICE_ROWS).cast("int"))))
    return sliced.join(copies, ["sheet", "_slice"])


def header_cells(cells: DataFrame, header_row: int = config.MASTER_HEADER_ROW) -> DataFrame:
    return cells.filter(F.col("row_no") == header_row).select(
        "sheet", "col_no", strip_ws(shown()).alias("label"))


def sheet_columns(cells: DataFrame, header_row: int = config.MASTER_HEADER_ROW) -> DataFrame:
    """M1-M3: first Plant # / SAP # / TOL # column, first Product/Item
    column after TOL #, SAP # ignored when more than 3 columns from TOL #,
    and the number of forecast-like headers."""
    h = header_cells(cells, header_row)
    lab = F.col("label")
    first = h.groupBy("sheet").agg(
        F.min(F.when(lab == config.LABEL_PLANT, F.col("col_no"))).alias("plant_col"),
        F.min(F.when(lab == config.LABEL_SAP, F.col("col_no"))).alias("sap_col"),
        F.min(F.when(lab == config.LABEL_TOL, F.col("col_no"))).alias("tol_col"),
        F.count_if(lab.rlike(config.FORECAST_HEADER_PATTERN)).cast("int").alias("forecast_col_count"))
    desc = (h.join(first.select("sheet", "tol_col"), "sheet")
            .filter(lab.isin(*config.LABELS_DESCRIPTION) & (F.col("col_no") > F.col("tol_col")))
            .groupBy("sheet").agg(F.min("col_no").alias("desc_col")))
    out = first.join(desc, "sheet", "left")
    far = F.abs(F.col("sap_col") - F.col("tol_col")) > config.SAP_MAX_DISTANCE_FROM_TOL
    out = out.withColumn("sap_col", F.when(F.col("tol_col").isNotNull() & far, F.lit(None).cast("int"))
                         .otherwise(F.col("sap_col")))
    out = out.withColumn("reconstructed_material_from_tol", F.col("sap_col").isNull())
    return out.select(*SHEET_COLUMNS)


def sheet_roles(cells: DataFrame, header_row: int = config.MASTER_HEADER_ROW) -> DataFrame:
    """``sheet_columns`` with the sheet's last row and its forecast columns as an array of (col_no, header), which is as long as
    its header is wide."""
    forecasts = forecast_columns(cells, header_row).groupBy("sheet").agg(
        F.array_sort(F.collect_list(F.struct("col_no", "header"))).alias("forecasts"))
    extent = cells.groupBy("sheet").agg(F.max("row_no").alias("max_row"))
    return sheet_columns(cells, header_row).join(extent, "sheet").join(forecasts, "sheet", "left")


def row_profile(cells: DataFrame, header_row: int = config.MASTER_HEADER_ROW, only_used: bool = False) -> DataFrame:
    """What every data row says, from one shuffle of the cells: raw plant, SAP, TOL and description cells and the right-most
    forecast cell that holds a number, with its header. All outputs of the master build read it. ``only_used`` leaves out cells
    in no used column before the grouping, and with them rows that have nothing else."""
    data = with_sheet(cells.filter(F.col("row_no") > header_row).select("sheet", "row_no", "col_no", "value"),
                      sheet_roles(cells, header_row))
    data = data.withColumn("_f", F.expr("get(filter(forecasts, f -> f.col_no = col_no), 0).header"))
    if only_used:
        data = data.filter("col_no IN (plant_col, sap_col, tol_col, desc_col) OR _f IS NOT NULL")
    number = F.when(F.col("_f").isNotNull() & ~strip_ws("value").isin(*config.ERROR_STRINGS), coerce_numeric("value"))
    data = data.withColumn("_num", number)
    picked = [F.expr(f"max(CASE WHEN col_no = {c}_col THEN value END)").alias(f"{c}_raw") for c in ("plant", "sap", "tol", "desc")]
    return data.groupBy("sheet", "_slice", "row_no").agg(
        *picked, F.first("reconstructed_material_from_tol").alias("reconstruct"),
        F.expr("max(CASE WHEN _num IS NOT NULL THEN struct(col_no, _num AS num, _f AS header) END)").alias("forecast"))


def _classified(rows: DataFrame) -> DataFrame:
    """M4/M6 over ``row_profile``: cleaned fields and the class of each row."""
    tol = clean_id(F.col("tol_raw"))
    fields = rows.select("sheet", "row_no", "forecast", "plant_raw", "tol_raw", "desc_raw", "sap_raw", "reconstruct", tol.alias("TOL_Material"))
    material = F.when(F.col("reconstruct"), F.concat(F.lit("100"), F.col("TOL_Material"))).otherwise(clean_id(F.col("sap_raw")))
    fields = fields.withColumn("Material", material)
    desc = strip_ws("desc_raw")
    return fields.select(
        "sheet", "row_no", F.expr("CASE WHEN plant_raw IS NULL AND tol_raw IS NULL AND desc_raw IS NULL THEN 'blank' "
                                  "WHEN plant_raw IS NULL THEN 'no_plant' WHEN Material IS NULL THEN 'missing_material' "
                                  "ELSE 'extracted' END").alias("row_class"),
        clean_id(F.col("plant_raw")).alias("Plant"), "Material", "TOL_Material", F.coalesce(desc, F.lit("")).alias("Description"),
        F.col("forecast.num").alias("Latest_Forecast_Qty"),
        F.coalesce(F.col("forecast.header"), F.lit("")).alias("Forecast_Source_Column"))


def classify_rows(cells: DataFrame, header_row: int = config.MASTER_HEADER_ROW) -> DataFrame:
    """M4/M6: per data row (that has any cell): cleaned fields and class
    blank / no_plant / missing_material / extracted."""
    return _classified(row_profile(cells, header_row)).select(
        "sheet", "row_no", "row_class", "Plant", "Material", "TOL_Material", "Description")


def forecast_columns(cells: DataFrame, header_row: int = config.MASTER_HEADER_ROW) -> DataFrame:
    h = header_cells(cells, header_row)
    return h.filter(F.col("label").rlike(config.FORECAST_HEADER_PATTERN)).select(
        "sheet", "col_no", F.col("label").alias("header"))


def rightmost_forecast(cells: DataFrame, header_row: int = config.MASTER_HEADER_ROW) -> DataFrame:
    """M5: per data row, the right-most forecast cell holding a number
    (blank, error strings and other text skipped) and its header."""
    rows = row_profile(cells, header_row, only_used=True).filter("forecast IS NOT NULL")
    return rows.select("sheet", "row_no", F.col("forecast.num").alias("Latest_Forecast_Qty"),
                       F.col("forecast.header").alias("Forecast_Source_Column"))


def build_master(cells: DataFrame, header_row: int = config.MASTER_HEADER_ROW) -> DataFrame:
    """M7: product-master rows (Supplier = sheet)."""
    rows = _classified(row_profile(cells, header_row, only_used=True)).filter("row_class = 'extracted'")
    return rows.select(F.col("sheet").alias("Supplier"), *MASTER_OUT[1:])


def extraction_audit(cells: DataFrame, header_row: int = config.MASTER_HEADER_ROW) -> DataFrame:
    """M8: per sheet, located columns and row counts. Rows between the
    header and the last used row that carry no plant are 'skipped blank',
    whether or not they have any cell."""
    cols = sheet_roles(cells, header_row).drop("forecasts")
    classes = _classified(row_profile(cells, header_row, only_used=True)).groupBy("sheet").agg(
        F.count_if(F.col("row_class") == "extracted").alias("rows_extracted"),
        F.count_if(F.col("row_class") == "missing_material").alias("rows_skipped_missing_material"))
    out = cols.join(classes, "sheet", "left").fillna(0, ["rows_extracted", "rows_skipped_missing_material"])
    blank = (F.greatest(F.col("max_row") - header_row, F.lit(0)) - F.col("rows_extracted")
             - F.col("rows_skipped_missing_material"))
    return out.select(*SHEET_COLUMNS, F.lit(header_row).alias("header_row"), "rows_extracted",
                      blank.cast("long").alias("rows_skipped_blank"), "rows_skipped_missing_material")


def forecast_source_distribution(cells: DataFrame, header_row: int = config.MASTER_HEADER_ROW) -> DataFrame:
    """M8: how many extracted rows took their forecast from each header."""
    m = build_master(cells, header_row).filter(F.col("Forecast_Source_Column") != "")
    return m.groupBy(F.col("Supplier").alias("sheet"), F.col("Forecast_Source_Column")).agg(
        F.count(F.lit(1)).alias("n_rows"))


def formula_survey(cells: DataFrame) -> DataFrame:
    """M9: per sheet extent, formula and '#REF!' formula counts; the
    rollup row (sheet null) carries the totals."""
    f = shown()
    is_formula = f.startswith("=")
    return cells.rollup("sheet").agg(
        F.max("row_no").alias("max_row"), F.max("col_no").alias("max_col"),
        F.count_if(is_formula).alias("formula_count"),
        F.count_if(is_formula & f.contains("#REF!")).alias("ref_error_count"))


def workbook_totals(cells: DataFrame) -> DataFrame:
    """M9 totals in one row: sheets, formulas and '#REF!' formulas."""
    f = shown()
    is_formula = f.startswith("=")
    return cells.agg(F.count_distinct("sheet").alias("sheets"), F.count_if(is_formula).alias("formulas"),
                     F.count_if(is_formula & f.contains("#REF!")).alias("ref_errors"))


def broken_formula_samples(cells: DataFrame, k: int = config.BROKEN_FORMULA_SAMPLES,
                           chars: int = config.BROKEN_FORMULA_CHARS) -> DataFrame:
    """The first k '#REF!' formulas of each sheet in row, column order
    (a per-task group limit before the shuffle, no whole-sheet window), whole
    and as ``shown``, their first ``chars`` characters."""
    f = shown()
    broken = cells.filter(f.startswith("=") & f.contains("#REF!")).select(
        "sheet", "row_no", "col_no", f.alias("formula"))
    return top_k_within(broken, ["sheet"], ["row_no", "col_no"], k).select(
        "sheet", "rank", "row_no", "col_no", "formula", F.substring("formula", 1, chars).alias("shown"))


def _is_text(c: Column) -> Column:
    s = strip_ws(c)
    return c.isNotNull() & (s != "") & ~c.startswith("=") & coerce_numeric(c).isNull()


def header_row(cells: DataFrame, max_row: int = config.HEADER_SCAN_MAX_ROW,
               max_col: int | None = None) -> DataFrame:
    """The row (<= max_row) with the most text cells (of all columns, or
    those <= max_col); smallest row on ties; row 1 when no row has text."""
    scan = cells.filter(F.col("row_no") <= max_row)
    if max_col is not None:
        scan = scan.filter(F.col("col_no") <= max_col)
    counts = scan.filter(_is_text(shown())).groupBy("sheet", "row_no").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("sheet").agg(
        F.max_by(F.struct("row_no", "n"), F.struct(F.col("n"), -F.col("row_no"))).alias("b"))
    sheets = cells.select("sheet").distinct()
    j = sheets.join(best, "sheet", "left")
    return j.select("sheet", F.coalesce(F.col("b.row_no"), F.lit(1)).alias("header_row"),
                    F.coalesce(F.col("b.n"), F.lit(0).cast("long")).alias("text_cells"))


def tag_expr(header: Column) -> Column:
    """Comma-joined tags of a header, in pattern order ('' when none)."""
    tags = F.array(*[F.when(header.rlike(p), F.lit(t)) for t, p in config.HEADER_TAG_PATTERNS])
    return F.array_join(F.array_compact(tags), ",")


def header_tags(cells: DataFrame, max_row: int = config.HEADER_SCAN_MAX_ROW, max_col: int | None = None) -> DataFrame:
    """Every non-blank cell of the detected header row (of all columns,
    or those <= max_col) with its keyword tags."""
    hr = header_row(cells, max_row, max_col).select("sheet", F.col("header_row").alias("row_no"))
    # a header row is among the first max_row: no other cell is shuffled
    h = cells.filter(F.col("row_no") <= max_row)
    if max_col is not None:
        h = h.filter(F.col("col_no") <= max_col)
    h = h.join(hr, ["sheet", "row_no"])
    h = h.withColumn("header", shown()).filter(strip_ws("header") != "")
    return h.select("sheet", "col_no", "header", tag_expr(F.col("header")).alias("tags"))


def tagged_samples(cells: DataFrame, n_rows: int = config.TAG_SAMPLE_ROWS,
                   max_row: int = config.HEADER_SCAN_MAX_ROW) -> DataFrame:
    """For the next n_rows rows after the header, the value under each
    tagged header (a repeated header text keeps its right-most column);
    rows with no value in any tagged column are dropped."""
    tags = header_tags(cells, max_row).filter(F.col("tags") != "")
    hr = header_row(cells, max_row).select("sheet", "header_row")
    # a header row is among the first max_row, so every sample row is among the first max_row + n_rows
    window = (cells.filter(F.col("row_no") <= max_row + n_rows).join(hr, "sheet")
              .filter((F.col("row_no") > F.col("header_row"))
                      & (F.col("row_no") <= F.col("header_row") + n_rows)))
    tagged_vals = window.join(tags.select("sheet", "col_no"), ["sheet", "col_no"])
    rows = tagged_vals.filter(F.col("value").isNotNull()).select("sheet", "row_no").distinct()
    last = tags.groupBy("sheet", "header").agg(F.max("col_no").alias("col_no"))
    # bounded per sheet: n_rows sample rows x the sheet's tagged headers
    grid = rows.join(last, "sheet")
    vals = window.select("sheet", "row_no", "col_no", "value")
    return grid.join(vals, ["sheet", "row_no", "col_no"], "left").select("sheet", "row_no", "header", "value")
