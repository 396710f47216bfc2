"""Ranking within groups without sending a whole group to one task.

A ``Window.partitionBy(group)`` puts every row of a group in one task; a
group holding a third of the data would then be one task's work. These
helpers keep each window partition bounded:

* ``row_number_within`` range-partitions on (group, order), checkpoints the
  slice assignment, numbers rows locally per (slice, group), and adds each
  slice's offset from a small per-slice count table (its size is bounded by
  partitions + groups).
* ``top_k_within`` is ``row_number() <= k``, which Spark plans with a
  partial per-task group limit before the shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_number_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                      out_col: str = "row_number", num_partitions: int | None = None) -> DataFrame:
    """Dense 1-based row number per group, ordered by ``order_cols``
    (which must make the order total within a group)."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds come from sampling, and each evaluation of the exchange
    # samples anew, so a row's slice is only stable within one evaluation.
    # The slice-tagged rows are checkpointed once (to the shared checkpoint
    # folder); local ranks and slice offsets both read that stored
    # assignment, however many times the result is consumed.
    ranged = (df.repartitionByRange(n, *group_cols, *order_cols)
              .withColumn("_slice", F.spark_partition_id())
              .checkpoint(eager=True))
    local_w = Window.partitionBy("_slice", *group_cols).orderBy(*order_cols)
    local = ranged.withColumn("_local", F.row_number().over(local_w))
    sizes = ranged.groupBy("_slice", *group_cols).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        F.col("_slice").alias("_of"), *[F.col(c).alias(f"_of_{c}") for c in group_cols], "_offset")
    same = F.col("_slice") == F.col("_of")
    for c in group_cols:  # a null group is a group
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = local.join(offsets, same)
    return out.select(*df.columns, (F.col("_offset") + F.col("_local")).cast("int").alias(out_col))


def top_k_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows of each group by ``order_cols`` (total order),
    with a ``rank`` column 1..k.

    Written as ``row_number() <= k``: Spark's optimizer turns this into a
    WindowGroupLimit that keeps the top ``k`` per group inside every map task
    before the shuffle (and again after it), so a group ships at most ``k``
    rows per task however large it is. ``k`` must stay within
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by default), as
    Spark would ship whole groups beyond it; a larger ``k`` raises.
    """
    most = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > most:
        raise ValueError(f"k = {k} is above spark.sql.optimizer.windowGroupLimitThreshold = {most}")
    order_exprs = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    w = Window.partitionBy(*group_cols).orderBy(*order_exprs)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
