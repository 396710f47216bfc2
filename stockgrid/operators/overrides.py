"""Planner overrides: latest edit per key, merged into the grid.

The log is append-only (event_id, ts, Plant, Material, Manual_Override,
Planner_Note); the latest edit per key wins. It is picked with ``max_by``
over (ts, event_id) so a heavily edited key is combined map-side instead of
being ranked whole in one window partition.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.operators.grid import GRID_COLUMNS, recompute

KEY = ["Plant", "Material"]
OVERRIDE_COLUMNS = ["Plant", "Material", "Manual_Override", "Planner_Note"]


def latest_overrides(log: DataFrame) -> DataFrame:
    """N2 (batch): last write wins, by ts then event_id."""
    best = log.groupBy(*KEY).agg(
        F.max_by(F.struct("Manual_Override", "Planner_Note"), F.struct("ts", "event_id")).alias("w"))
    return best.select(*KEY, "w.Manual_Override", "w.Planner_Note")


def apply_overrides(grid: DataFrame, overrides: DataFrame,
                    pct: float = config.SAFETY_STOCK_PCT) -> DataFrame:
    """C4 + E8: new override / note win over the grid's (coalesce), then
    suggestion, safety stock and status are recomputed."""
    o = overrides.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("Manual_Override").cast("double").alias("_new_override"),
                         F.col("Planner_Note").alias("_new_note"))
    same = F.lit(True)
    for k in KEY:  # a null key is a key like others
        same = same & grid[k].eqNullSafe(o[f"_{k}"])
    j = grid.join(o, same, "left")
    merged = {"Manual_Override": F.coalesce("_new_override", "Manual_Override"),
              "Planner_Note": F.coalesce("_new_note", "Planner_Note")}
    j = j.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in GRID_COLUMNS])
    return recompute(j, pct)
