"""The ordering grid from stored key states: a new file costs its own keys, not a pass over all rows.

Every batch of a kind's rows is reduced to one state per (file, key): the fixed-width sums of ``functions.exact``, earliest
dates and the row count. States of parts add up to the state of the whole, exactly and in any order, so the grid merged from
states is the grid of all rows. Files keep their own states, as earliest dates can't be taken back from a merged one: a file
is withdrawn by a row that names it, and its states up to that batch are no longer read.

``update_grid`` keeps a stored grid up to date: it is partitioned by a hash bucket of the key, and only buckets that hold a
changed key are read and replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

from stockgrid import config
from stockgrid.functions.exact import merged, state_names, states, total_sql, with_parts
from stockgrid.operators.aggregate import (
    CUSTOMER_ORDER_SUMS, KEY, ON_HAND_DATES, ON_HAND_SUMS, OPEN_ORDER_DATES, open_order_sums, unconfirmed,
)
from stockgrid.operators.grid import GRID_COLUMNS, finished
from stockgrid.operators.target import TARGET_COLUMNS
from stockgrid.sources import snapshots

BUCKETS = 256
SUMS = [*ON_HAND_SUMS, *CUSTOMER_ORDER_SUMS, *open_order_sums()]
DATES = [*ON_HAND_DATES, *OPEN_ORDER_DATES]
STATE_SCHEMA = StructType(
    [StructField("Plant", StringType()), StructField("Material", StringType()), StructField("bucket", IntegerType()),
     StructField("file", StringType()), StructField("n_rows", LongType())]
    + [StructField(n, DoubleType() if n.endswith("__far") else LongType()) for s in SUMS for n in state_names(s)]
    + [StructField(d, TimestampNTZType()) for d in DATES] + [StructField("kind", StringType()), StructField("batch_id", LongType())])
_WITHDRAWN = StructType([StructField("file", StringType()), StructField("through", LongType()), StructField("kind", StringType())])


def bucket_of(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col("Plant").isNull(), F.coalesce("Plant", F.lit("")), F.coalesce("Material", F.lit(""))),
                  F.lit(buckets)).cast("int")


def key_states(rows: DataFrame, kind: str, file_col: str = "_source_file", field_by_plant: dict[str, str] | None = None,
               buckets: int = BUCKETS) -> DataFrame:
    """States of one kind's rows per (file, key), in the columns of ``STATE_SCHEMA`` but the batch."""
    sums, dates = {"on_hand": (ON_HAND_SUMS, ON_HAND_DATES), "customer_orders": (CUSTOMER_ORDER_SUMS, {}),
                   "open_orders": (open_order_sums(field_by_plant), OPEN_ORDER_DATES)}[kind]
    agg = with_parts(rows.withColumn("file", F.col(file_col)), sums).groupBy(*KEY, "file").agg(
        F.count(F.lit(1)).alias("n_rows"), *states(sums), *[F.expr(e).alias(n) for n, e in dates.items()])
    agg = agg.withColumn("kind", F.lit(kind)).withColumn("bucket", bucket_of(buckets))
    have = set(agg.columns)
    return agg.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
                        for f in STATE_SCHEMA.fields if f.name != "batch_id"])


def write_states(rows: DataFrame, kind: str, batch_id: int, path: str, **how) -> None:
    """Store the states of one batch; the same batch again replaces them. Rows are sorted by bucket, so that readers of few
    buckets skip most row groups."""
    out = key_states(rows, kind, **how).withColumn("batch_id", F.lit(batch_id).cast("long"))
    snapshots.write_batch(out.sortWithinPartitions("kind", "batch_id", "bucket", *KEY), path, ["kind", "batch_id"])


def withdraw(spark: SparkSession, path: str, kind: str, file: str, through_batch: int) -> None:
    """Take back what a file gave in batches up to ``through_batch``; the same file may come again later."""
    row = spark.createDataFrame([(file, through_batch, kind)], _WITHDRAWN)
    row.coalesce(1).write.mode("append").partitionBy("kind").parquet(f"{path.rstrip('/')}_withdrawn")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """All states that count: snapshot and later batches, without withdrawn files."""
    all_states = snapshots.read(spark, path, STATE_SCHEMA, "batch_id", "kind")
    gone = snapshots.read_or_empty(spark, f"{path.rstrip('/')}_withdrawn", _WITHDRAWN).groupBy(
        F.col("kind").alias("_kind"), F.col("file").alias("_file")).agg(F.max("through").alias("_through"))
    return all_states.join(gone, (F.col("kind") == F.col("_kind")) & (F.col("file") == F.col("_file"))
                           & (F.col("batch_id") <= F.col("_through")), "left_anti")


def compact_states(spark: SparkSession, path: str) -> int:
    """A new snapshot without withdrawn files, sorted by bucket; files keep their own states and batches."""
    def combine(rows: DataFrame) -> DataFrame:
        gone = snapshots.read_or_empty(spark, f"{path.rstrip('/')}_withdrawn", _WITHDRAWN).groupBy("kind", "file").agg(
            F.max("through").alias("through"))
        kept = rows.alias("r").join(gone.alias("g"), F.expr("r.kind = g.kind AND r.file = g.file AND r.batch_id <= g.through"),
                                    "left_anti")
        return kept.repartition("bucket").sortWithinPartitions("bucket", *KEY)
    return snapshots.compact(spark, path, STATE_SCHEMA, "batch_id", combine, "kind")


def grid_of_states(found: DataFrame, target: DataFrame, pct: float = config.SAFETY_STOCK_PCT) -> DataFrame:
    """E9 from states, in any mix of batches and snapshots."""
    agg = found.groupBy(*KEY).agg(*merged(SUMS), *[F.min(d).alias(d) for d in DATES])
    keyed = agg.selectExpr(*KEY, *[f"{total_sql(s)} AS `{s}`" for s in SUMS], *DATES).withColumn("Unconfirmed_Qty", unconfirmed())
    return finished(keyed.join(target.select(*TARGET_COLUMNS), KEY, "left"), pct)


def incremental_grid(spark: SparkSession, path: str, target: DataFrame, pct: float = config.SAFETY_STOCK_PCT) -> DataFrame:
    return grid_of_states(read_states(spark, path), target, pct)


def changed_keys(spark: SparkSession, path: str, kind: str, batch_ids: list[int] | None = None,
                 files: list[str] | None = None) -> DataFrame:
    """Keys (with bucket) that given batches or files of a kind touch, withdrawn files included."""
    rows = snapshots.read_or_empty(spark, path, STATE_SCHEMA).where(F.col("kind") == kind)
    if batch_ids is not None:
        rows = rows.where(F.col("batch_id").isin(batch_ids))
    if files is not None:
        rows = rows.where(F.col("file").isin(files))
    return rows.select(*KEY, "bucket").distinct()


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["Plant"].eqNullSafe(b["_Plant"]) & a["Material"].eqNullSafe(b["_Material"])


def write_grid(grid: DataFrame, grid_path: str, buckets: int = BUCKETS) -> None:
    """Store a whole grid by bucket."""
    grid.withColumn("bucket", bucket_of(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(grid_path)


def read_grid(spark: SparkSession, grid_path: str, like: DataFrame) -> DataFrame:
    """A stored grid with the column types of ``like`` (a plant stays text)."""
    schema = StructType([*like.select(*GRID_COLUMNS).schema.fields, StructField("bucket", IntegerType())])
    return snapshots.read_or_empty(spark, grid_path, schema)


def update_grid(spark: SparkSession, path: str, grid_path: str, target: DataFrame, changed: DataFrame,
                pct: float = config.SAFETY_STOCK_PCT, buckets: int = BUCKETS) -> int:
    """Bring the stored grid up to date for ``changed`` keys and return how many buckets were replaced.

    Bucket numbers reach the driver (``BUCKETS`` at most) and prune states and grid. Unchanged keys of those buckets are
    carried over; a key without states any more goes. The new rows are written to the shared scratch folder first, as they
    are read from the partitions that they replace."""
    from stockgrid.operators.reports import materialize
    changed = materialize(spark, changed.select(F.col("Plant").alias("_Plant"), F.col("Material").alias("_Material"), "bucket").distinct(),
                          "changed-keys")
    touched = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())
    if not touched:
        return 0
    found = read_states(spark, path).where(F.col("bucket").isin(touched))
    keys = changed.select("_Plant", "_Material")
    fresh = grid_of_states(found.join(keys, _same_key(found, keys), "left_semi"), target, pct)
    old = read_grid(spark, grid_path, fresh).where(F.col("bucket").isin(touched))
    kept = old.join(keys, _same_key(old, keys), "left_anti")
    both = fresh.withColumn("bucket", bucket_of(buckets)).unionByName(kept)
    both = materialize(spark, both, "grid-buckets")
    # a bucket whose last key went has no row to replace it with: it is overwritten by itself, empty
    left = {r["bucket"] for r in both.select("bucket").distinct().collect()}
    snapshots.write_batch(both.repartition("bucket"), grid_path, ["bucket"])
    for b in touched:
        if b not in left:
            both.where("false").drop("bucket").write.mode("overwrite").parquet(f"{grid_path.rstrip('/')}/bucket={b}")
    return len(touched)
