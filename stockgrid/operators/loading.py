"""File-level checks: header validation, plant values, load status.

Inputs are set-shaped: header rows as (file, ordinal, name), data rows as
(file / kind, expected plant, observed plant). Per-file work is bounded by
a file's header width or by the number of distinct plant values.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: load status labels
STATUS_MISSING = "Missing"
STATUS_VALID = "Valid"
STATUS_ERROR = "Error"

# FIXED VALUES: header check messages
MESSAGE_MISMATCH = "Schema mismatch -- "
MESSAGE_REORDERED = "Columns present but reordered relative to the expected schema."
MESSAGE_OK = "Schema OK."

# error texts of a load, beside the header messages; the plant text is a fixed value
ERROR_UNREADABLE = "The file has no header line."
ERROR_PLANT_HEAD = "Plant column contains unexpected value(s) ["
ERROR_PLANT_TAIL = "] for a file mapped to plant "
ERROR_MALFORMED = " row(s) have more or fewer fields than the header."


def _joined(arr) -> F.Column:
    return F.array_join(F.array_sort(arr), ",")


def header_message(bad: F.Column) -> F.Column:
    def part(label: str, c: str) -> F.Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(f"{label} columns: ['"), F.array_join(c, "', '"), F.lit("']")))

    parts = F.concat_ws("; ", part("missing", "_missing"), part("unexpected", "_surplus"), part("duplicated", "_dup"))
    return F.when(bad, F.concat(F.lit(MESSAGE_MISMATCH), parts)).when(~F.col("_same"), MESSAGE_REORDERED).otherwise(MESSAGE_OK)


def header_validation(headers: DataFrame, expected: list[str] | tuple[str, ...],
                      file_col: str = "file_id") -> DataFrame:
    """A4: per file, missing / extra / duplicated names, reordered flag.

    Missing, extra or duplicated is reported before (and instead of) a
    reorder, which is only flagged when the name sets agree. ``message`` says
    what differs, naming columns in header order; ``received`` and ``expected``
    list both headers for a side-by-side view.
    """
    exp = F.array(*[F.lit(n) for n in expected])
    per_file = headers.groupBy(file_col).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("_cols"))
    received = F.transform(F.col("_cols"), lambda x: x["name"])
    missing = F.array_except(exp, received)
    extra = F.array_except(received, exp)
    surplus = F.filter(received, lambda x: ~F.array_contains(exp, x))  # repeats kept
    dup = F.array_distinct(F.filter(received, lambda x: F.size(F.filter(received, lambda y: y == x)) > 1))
    out = per_file.select(
        file_col,
        missing.alias("_missing"), extra.alias("_extra"), F.array_sort(dup).alias("_dup"), surplus.alias("_surplus"),
        received.alias("received"), (received == exp).alias("_same"))
    bad = (F.size("_missing") > 0) | (F.size("_extra") > 0) | (F.size("_dup") > 0)
    return out.select(
        file_col,
        _joined(F.col("_missing")).alias("missing_columns"),
        _joined(F.col("_extra")).alias("extra_columns"),
        _joined(F.col("_dup")).alias("duplicated_columns"),
        (~bad & ~F.col("_same")).alias("reordered"),
        (~bad & F.col("_same")).alias("ok"),
        F.when(bad, F.lit("mismatch")).when(~F.col("_same"), F.lit("reordered")).otherwise(F.lit("ok"))
         .alias("result"),
        header_message(bad).alias("message"), "received", exp.alias("expected"))


def violation_rows(file_rows: DataFrame, by: Sequence[str] = ("kind", "expected_plant")) -> DataFrame:
    """A8 as rows: each wrong plant value of a file with the rows that carry it. Values are free text, so they stay rows
    that are combined before the shuffle, not a set in one row."""
    wrong = file_rows.filter(F.col("observed_plant").isNotNull() & (F.col("observed_plant") != F.col("expected_plant")))
    return wrong.groupBy(*by, "observed_plant").agg(F.count(F.lit(1)).alias("n_rows"))


def plant_violations(file_rows: DataFrame) -> DataFrame:
    """Per arriving file, sorted distinct non-null plants that differ
    from the file's plant, and how many rows carry them."""
    wrong = F.col("observed_plant").isNotNull() & (F.col("observed_plant") != F.col("expected_plant"))
    return file_rows.groupBy("kind", "expected_plant").agg(
        F.count(F.lit(1)).alias("row_count"),
        _joined(F.collect_set(F.when(wrong, F.col("observed_plant")))).alias("violations"),
        F.count_if(wrong).alias("violating_rows"))


def load_status(required: DataFrame, file_rows: DataFrame | None = None,
                per_file: DataFrame | None = None) -> DataFrame:
    """Status of every required (kind, plant) file: Missing, Error
    (plant values of another plant) or Valid. ``per_file`` may be a stored
    ``plant_violations`` result."""
    per_file = per_file if per_file is not None else plant_violations(file_rows)
    per_file = per_file.withColumnRenamed("expected_plant", "plant")
    j = required.join(per_file, ["kind", "plant"], "left")
    status = (F.when(F.col("row_count").isNull(), F.lit(STATUS_MISSING))
              .when(F.col("violations") != "", F.lit(STATUS_ERROR))
              .otherwise(F.lit(STATUS_VALID)))
    return j.select("kind", "plant", status.alias("status"),
                    F.coalesce(F.col("row_count"), F.lit(0).cast("long")).alias("row_count"),
                    F.coalesce(F.col("violations"), F.lit("")).alias("violations"))


def load_gate(status: DataFrame) -> DataFrame:
    """A9 gate: every required upload valid (a missing one is not)."""
    valid = F.col("status") == STATUS_VALID
    return status.agg(F.count(F.lit(1)).alias("n_required"), F.count_if(valid).alias("n_valid"),
                      F.coalesce(F.bool_and(valid), F.lit(False)).alias("all_valid"))
