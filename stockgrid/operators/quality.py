"""Data quality and reconciliation as DataFrame jobs.

Every check is an aggregate or a key-level set operation, so none of them
gathers a group's rows in one task: duplicate counting groups by the full
row (combined map-side), key sets are distinct + anti joins, grand totals
are global exact sums.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockgrid import config
from stockgrid.functions import grouped

KEY = ["Plant", "Material"]

# FIXED VALUES: reconciled metrics, in report order: (metric, kind, source column)
RECONCILED_METRICS = (
    ("Unrestricted_On_Hand", "on_hand", "unrestricted"),
    ("Customer_Order_Qty", "customer_orders", "order_qty"),
    ("Confirmed_Qty", "customer_orders", "confirmed_qty"),
    ("Open_PO_Qty", "open_orders", "open_po_qty"),
)


def row_hash(columns: Sequence[str], schema: StructType) -> Column:
    """A 64-bit hash of a row. Spark's hash skips nulls, so it also reads which columns are null; -0.0 counts as 0.0, as it
    does in a grouping."""
    numbers = {f.name for f in schema.fields if f.dataType.typeName() in ("double", "float")}
    values = [f"`{c}` + 0.0D" if c in numbers else f"`{c}`" for c in columns]
    nulls = [" + ".join(f"IF(`{c}` IS NULL, {1 << i}L, 0L)" for i, c in enumerate(columns[at:at + 60]))
             for at in range(0, len(columns), 60)]
    return F.expr(f"xxhash64({', '.join(values + nulls)})")


def duplicate_rows(tagged: DataFrame, columns_by_kind: Mapping[str, Sequence[str]],
                   hashed_by: Callable[[Sequence[str], StructType], Column] = row_hash) -> DataFrame:
    """Per kind, rows that have at least one twin in every column of the kind (every member of a duplicate group
    counts; other kinds' columns are null on its rows).

    First, rows are counted by a hash: only hashes and counts are shuffled, combined before it. Then just the rows whose
    hash repeats are compared whole, so equal hashes of different rows count for nothing. The repeating hashes are written
    to the shared scratch folder, from where Spark decides by their size how the rows meet them."""
    from stockgrid.operators.reports import materialize
    spark = tagged.sparkSession
    cols = sorted({c for cs in columns_by_kind.values() for c in cs})
    hashed = tagged.select("kind", *cols, hashed_by(["kind", *cols], tagged.schema).alias("_h"))
    repeating = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    repeating = materialize(spark, repeating, "repeating-hashes")
    groups = hashed.join(repeating, "_h", "left_semi").groupBy("kind", *cols).agg(F.count(F.lit(1)).alias("_n"))
    # one row a kind of the contracts, also without twins; the arrays are as long as the contracts
    found = groups.where("_n > 1").groupBy("kind").agg(F.sum("_n").alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("found"))
    kinds = F.array(*[F.lit(k) for k in columns_by_kind])
    return found.select(F.explode(kinds).alias("kind"), "found").select(
        "kind", F.coalesce(F.col("found")[F.col("kind")], F.lit(0)).cast("long").alias("duplicate_rows"))


def full_row_duplicates(spark: SparkSession, kinds: dict[str, DataFrame]) -> DataFrame:
    """D11 over loaded files: per kind, rows with at least one twin in *every* source column (lineage columns, which start
    with an underscore, are not part of a row)."""
    out = None
    for kind, df in kinds.items():
        columns = [c for c in df.columns if not c.startswith("_")]
        one = duplicate_rows(df.withColumn("kind", F.lit(kind)), {kind: columns})
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "kind string, duplicate_rows long")


def missing(c: str, number: bool) -> Column:
    """A value is missing or invalid: null, or a number that is NaN or infinite."""
    null = F.col(c).isNull()
    return null | F.isnan(c) | (F.abs(c) == float("inf")) if number else null


def null_counts(spark: SparkSession, tagged: DataFrame, columns_by_kind: dict[str, list[str]]) -> DataFrame:
    """missing/invalid values per kind and column, one pass. A number that is NaN or infinite is invalid."""
    numbers = {f.name for f in tagged.schema.fields if f.dataType.typeName() in ("double", "float")}

    cols = sorted({c for cs in columns_by_kind.values() for c in cs})
    wide = tagged.groupBy("kind").agg(*[F.count_if(missing(c, c in numbers)).alias(c) for c in cols])
    long = wide.unpivot("kind", cols, "column", "null_count")
    # keep each kind's own columns: a fixed dimension sized by the schemas
    own = spark.createDataFrame([(k, c, i) for k, cs in columns_by_kind.items() for i, c in enumerate(cs)],
                                "kind string, column string, ordinal int")
    return long.join(F.broadcast(own), ["kind", "column"]).select(
        "kind", "column", F.col("null_count").cast("long").alias("null_count"))


def source_keys(tagged: DataFrame) -> DataFrame:
    return tagged.select(*KEY).distinct()


def unmatched_by_source(tagged: DataFrame, target: DataFrame) -> DataFrame:
    """Distinct (kind, key) of each source without a master row. A null
    key never matches, so it is always reported."""
    keys = tagged.select("kind", *KEY).distinct()
    return keys.join(target.select(*KEY), KEY, "left_anti")


def sources_not_in_master(tagged: DataFrame, target: DataFrame) -> DataFrame:
    """H2: source keys EXCEPT master keys (set semantics, null-safe)."""
    return source_keys(tagged).subtract(target.select(*KEY))


def master_no_activity(tagged: DataFrame, target: DataFrame) -> DataFrame:
    """H3: master keys EXCEPT source keys."""
    return target.select(*KEY).subtract(source_keys(tagged))


def source_totals(tagged: DataFrame) -> DataFrame:
    """D10 (source side): grand totals of the reconciled metrics, one row."""
    return grouped(tagged, [], {metric: f"CASE WHEN kind = '{kind}' THEN {col} END" for metric, kind, col in RECONCILED_METRICS})


def grid_totals(grid: DataFrame) -> DataFrame:
    """D10 (grid side): the same metrics summed over the grid, one row."""
    return grouped(grid, [], {metric: metric for metric, _, _ in RECONCILED_METRICS})


def _long(totals: DataFrame, value_name: str) -> DataFrame:
    metrics = [m for m, _, _ in RECONCILED_METRICS]
    return totals.unpivot([], metrics, "metric", value_name)


def reconciliation_variance(tagged: DataFrame, grid: DataFrame) -> DataFrame:
    """Metric, source total, grid total, variance rounded to 6."""
    s = _long(source_totals(tagged), "source_total")
    d = _long(grid_totals(grid), "dashboard_total")
    out = s.join(d, "metric")
    return out.withColumn("variance", F.round(F.col("dashboard_total") - F.col("source_total"), 6))


def reconciliation_gate(variances: DataFrame) -> DataFrame:
    """K2: passes when every |variance| < tolerance (vacuously with none). A variance that is missing or no number, as
    infinite quantities make it, fails."""
    ok = F.coalesce(F.abs(F.col("variance")) < F.lit(config.VARIANCE_TOLERANCE), F.lit(False))
    return variances.agg(
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("passed"),
        F.count(F.lit(1)).alias("n_metrics"),
        F.count_if(~ok).alias("n_failing"))


def sorted_keys(keys: DataFrame) -> DataFrame:
    """Key list in report order, null keys first."""
    return keys.orderBy(F.col("Plant").asc_nulls_first(), F.col("Material").asc_nulls_first())
