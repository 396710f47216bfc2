"""Queries over stored, incrementally kept state: the merged grid and the compacted override log."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.operators import incremental as inc
from stockgrid.operators import reports
from stockgrid.plans.core import GRID_COLS, load_target
from stockgrid.plans.oracle_base import with_views
from stockgrid.plans.registry import query
from stockgrid.session import app_id, scratch_path
from stockgrid.sources import snapshots
from stockgrid.sources import testdata as td
from stockgrid.streaming import ingest

_DOCUMENT = {"customer_orders": "sales_order", "on_hand": "batch", "open_orders": "po_number"}


def _path(spark, name):
    return scratch_path(spark, f"{app_id(spark)}/{name}-{uuid.uuid4().hex}")


@query("incremental_grid", "N1/E9", with_views(f"select {GRID_COLS} from grid", "grid"))
def q_incremental_grid(spark, sf_dir):
    """The grid merged from key states. Each kind comes in three files by document number: two in a first batch (stock sends
    it twice), the third in the next one; then a file of each kind is withdrawn, the states are compacted, and the file is
    sent again."""
    path = _path(spark, "key-states")
    rows = reports.materialize(spark, td.source_rows(spark, sf_dir), "incremental-sources")

    def write(kind: str, batch_id: int, files: str) -> None:
        mine = rows.where(F.col("kind") == kind).withColumn("_source_file", (F.col(_DOCUMENT[kind]) % 3).cast("string"))
        inc.write_states(mine.where(f"_source_file IN ({files})"), kind, batch_id, path)

    for kind, batch_id, files in [("on_hand", 0, "'0', '1'"), *[(k, 0, "'0', '1'") for k in config.KINDS], *[(k, 1, "'2'") for k in config.KINDS]]:
        write(kind, batch_id, files)
    for kind in config.KINDS:
        inc.withdraw(spark, path, kind, "1", 1)
    inc.compact_states(spark, path)
    for kind in config.KINDS:
        write(kind, 2, "'1'")
    return inc.incremental_grid(spark, path, load_target(spark, sf_dir))


@query("overrides_from_log", "N2", with_views("select * from latest_overrides", "latest_overrides"))
def q_overrides_from_log(spark, sf_dir):
    """The override table from a log of two batches, the first of them compacted into a snapshot."""
    path = _path(spark, "override-log")
    events = td.override_log(spark, sf_dir)
    for batch_id, part in enumerate([events.where("event_id % 3 <> 0"), events]):
        latest = ingest.latest_per_key(part).withColumn("_batch", F.lit(batch_id).cast("long"))
        snapshots.write_batch(latest, path, ["_batch"])
        if batch_id == 0:
            ingest.compact_overrides(spark, path)
    return ingest.latest_from_log(spark, path)
