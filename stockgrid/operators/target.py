"""Product master: cleaning, one target per key, losing duplicates.

The winner per (Plant, Material) is chosen with ``min_by`` over a ranking
struct instead of a ``row_number`` window: an aggregate combines map-side,
so a key carrying a third of the master never lands whole in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from stockgrid.functions import coerce_numeric

KEY = ["Plant", "Material"]
MASTER_COLUMNS = ["Plant", "Material", "Supplier", "TOL_Material", "Description", "Latest_Forecast_Qty"]
TARGET_COLUMNS = ["Plant", "Material", "Supplier", "TOL_Material", "Description", "Target_Stock"]


def clean_master(master: DataFrame) -> DataFrame:
    """Keys as text, rows without a full key dropped, forecast coerced."""
    fc = F.col("Latest_Forecast_Qty")
    fc = coerce_numeric(fc) if isinstance(master.schema["Latest_Forecast_Qty"].dataType, StringType) \
        else fc.cast(DoubleType())
    fc = F.nanvl(fc, F.lit(None).cast(DoubleType()))  # NaN is no forecast
    out = master.withColumn("Plant", F.col("Plant").cast("string")) \
        .withColumn("Material", F.col("Material").cast("string")) \
        .withColumn("Latest_Forecast_Qty", fc)
    return out.dropna(subset=KEY)


def _rank() -> Column:
    """Ascending order = preference: forecast present, highest forecast,
    then Supplier, TOL_Material, Description as tie-breaks."""
    fc = F.col("Latest_Forecast_Qty")
    return F.struct(fc.isNull().alias("no_forecast"), (-fc).alias("neg_forecast"),
                    F.col("Supplier"), F.col("TOL_Material"), F.col("Description"))


def _payload() -> Column:
    return F.struct(*[F.col(c) for c in MASTER_COLUMNS[2:]])


def target_lookup(master: DataFrame, cleaned: bool = False) -> DataFrame:
    """One row per key: the master row with the highest forecast."""
    m = master if cleaned else clean_master(master)
    best = m.groupBy(*KEY).agg(F.min_by(_payload(), _rank()).alias("w"))
    return best.select(*KEY, "w.Supplier", "w.TOL_Material", "w.Description",
                       F.col("w.Latest_Forecast_Qty").alias("Target_Stock"))


def master_duplicates(master: DataFrame, cleaned: bool = False) -> DataFrame:
    """master rows that lose the per-key ranking (every row but one
    winner per key, identical copies included).

    Each row gets an identity (``monotonically_increasing_id``), and the
    tagged rows are written once as Parquet so both consumers below see the same
    identities even if the input came through a shuffle or a task is
    retried. The winner per key is the ``min_by`` of that identity over
    (rank, identity); the losers are the rows joined to their key's winner
    with a different identity. Copies of a row stay where they were read:
    nothing is re-expanded from a count.
    """
    from stockgrid.operators.reports import materialize
    m = (master if cleaned else clean_master(master)).withColumn("_rid", F.monotonically_increasing_id())
    m = materialize(m.sparkSession, m, "master-rows")
    winners = m.groupBy(*KEY).agg(F.min_by("_rid", F.struct(_rank(), F.col("_rid"))).alias("_win"))
    return m.join(winners, KEY, "inner").filter(F.col("_rid") != F.col("_win")).select(*MASTER_COLUMNS)

