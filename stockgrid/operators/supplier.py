"""The grid of some suppliers without aggregating the others' keys.

A supplier is a property of the master row that wins a key, so the keys of the wanted suppliers are known from the master
alone. They reduce the sources (and the override log) by a left semi join before the partial aggregation. A few suppliers'
keys are small: AQE broadcasts them by their measured size, and no row of another key is aggregated or shuffled; a key set
too large for that joins by shuffle, where Spark's runtime Bloom filter reduces the rows before it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.operators.grid import ordering_grid
from stockgrid.operators.overrides import apply_overrides, latest_overrides
from stockgrid.operators.views import SUPPLIER_VIEWS, supplier_recommendation, supplier_view

KEY = ["Plant", "Material"]


def supplier_keys(target: DataFrame, suppliers: Sequence[str], plants: Sequence[str] | None = None) -> DataFrame:
    """Target rows of keys that a wanted supplier wins."""
    out = target.where(F.col("Supplier").isin(*suppliers))
    return out.where(F.col("Plant").isin(*plants)) if plants else out


def supplier_grid(tagged: DataFrame, target: DataFrame, suppliers: Sequence[str], plants: Sequence[str] | None = None,
                  override_log: DataFrame | None = None, field_by_plant: dict[str, str] | None = None,
                  pct: float = config.SAFETY_STOCK_PCT) -> DataFrame:
    """The (overridden) grid's rows of ``suppliers``, as a filter on the whole grid gives them. Keys with a null
    part have no master row, so they belong to no supplier."""
    mine = supplier_keys(target, suppliers, plants)
    keys = mine.select(*KEY)
    if plants:
        tagged = tagged.where(F.col("Plant").isin(*plants))
    grid = ordering_grid(tagged.join(keys, KEY, "left_semi"), mine, field_by_plant, pct)
    if override_log is None:
        return grid
    return apply_overrides(grid, latest_overrides(override_log.join(keys, KEY, "left_semi")), pct)


def supplier_pages(slice_: DataFrame, name: str = "supplier-slice") -> dict[str, DataFrame]:
    """All seven tabs of a supplier's page from one stored copy of its slice; each reads only its columns."""
    from stockgrid.operators.reports import materialize
    stored = materialize(slice_.sparkSession, slice_, name)
    pages = {view: supplier_view(stored, view) for view in SUPPLIER_VIEWS}
    return pages | {"recommendation": supplier_recommendation(stored)}
