"""Streaming re-aims: drop-folder ingestion and the override stream."""
from __future__ import annotations

import datetime as dt
import os
import shutil

from test_files import write_uploads

from stockgrid.operators.overrides import latest_overrides
from stockgrid.streaming.ingest import (
    OVERRIDE_EVENT_SCHEMA, ingest_drop_folder, latest_from_log, read_kind_table, stream_overrides,
)


def test_drop_folder_reads_each_file_once(spark, tmp_dir):
    uploads = os.path.join(tmp_dir, "uploads")
    os.makedirs(uploads)
    write_uploads(uploads)
    drop = os.path.join(tmp_dir, "drop_on_hand")
    os.makedirs(drop)
    shutil.copy(os.path.join(uploads, "OH2910.csv"), drop)
    table, ckpt = os.path.join(tmp_dir, "oh_table"), os.path.join(tmp_dir, "ckpt_oh")
    ingest_drop_folder(spark, drop, "on_hand", table, ckpt)
    assert read_kind_table(spark, table, "on_hand").count() == 3
    shutil.copy(os.path.join(uploads, "OH2930.csv"), drop)
    ingest_drop_folder(spark, drop, "on_hand", table, ckpt)   # only the new file
    t = read_kind_table(spark, table, "on_hand")
    assert t.count() == 6 and {r.Plant for r in t.select("Plant").distinct().collect()} == {"2910", "2930"}
    ingest_drop_folder(spark, drop, "on_hand", table, ckpt)   # nothing new: no change
    assert read_kind_table(spark, table, "on_hand").count() == 6
    # a file with a wrong header is recorded and its rows are kept out
    with open(os.path.join(uploads, "OH2930.csv")) as fh:
        lines = fh.read().splitlines()
    with open(os.path.join(drop, "OH_bad.csv"), "w") as fh:
        fh.write("\n".join(["Material Number" + lines[0][len("Material"):]] + lines[1:]) + "\n")
    ingest_drop_folder(spark, drop, "on_hand", table, ckpt)
    assert read_kind_table(spark, table, "on_hand").count() == 6
    man = {r._source_file: r for r in spark.read.parquet(table + "_manifest").collect()}
    assert man["OH_bad.csv"].header_result == "mismatch" and man["OH_bad.csv"].row_count == 3
    assert man["OH2910.csv"].header_result == "ok"


def test_drop_folder_holds_back_malformed_files_and_records_empty_ones(spark, tmp_dir):
    uploads, drop = os.path.join(tmp_dir, "uploads"), os.path.join(tmp_dir, "drop")
    os.makedirs(uploads)
    os.makedirs(drop)
    write_uploads(uploads)
    with open(os.path.join(uploads, "OH2910.csv")) as fh:
        lines = fh.read().splitlines()
    table, ckpt = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "ck")

    def put(name, rows):
        with open(os.path.join(drop, name), "w") as fh:
            fh.write("\n".join(rows) + "\n")

    put("only header.csv", lines[:1])   # alone in its batch, with a blank in its name
    ingest_drop_folder(spark, drop, "on_hand", table, ckpt)
    put("long.csv", lines + [lines[1] + ",surplus"])
    put("short.csv", lines[:2] + [lines[2].split(",")[0]])
    put("good one.csv", lines)
    put("header.csv", lines[:1])
    ingest_drop_folder(spark, drop, "on_hand", table, ckpt, max_files_per_trigger=3)
    for i in range(12):                 # past the compaction of the source's log
        put(f"g{i:02}.csv", lines[:2])
        ingest_drop_folder(spark, drop, "on_hand", table, ckpt)
    man = {r._source_file.replace("%20", " "): (r.header_result, r.row_count, r.malformed_rows)
           for r in spark.read.parquet(table + "_manifest").collect()}
    n = len(lines) - 1
    assert man == {"only header.csv": ("ok", 0, 0), "header.csv": ("ok", 0, 0), "long.csv": ("ok", n + 1, 1),
                   "short.csv": ("ok", 2, 1), "good one.csv": ("ok", n, 0), **{f"g{i:02}.csv": ("ok", 1, 0) for i in range(12)}}
    got = {r._source_file.replace("%20", " "): r["count"] for r in read_kind_table(spark, table, "on_hand").groupBy("_source_file").count().collect()}
    assert got == {"good one.csv": n, **{f"g{i:02}.csv": 1 for i in range(12)}}


def test_override_stream_matches_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    t0 = dt.datetime(2026, 1, 1)
    b1 = [(1, t0, "2910", "A", 5.0, "first"), (2, t0, "2910", "A", 7.0, "same ts, later id"),
          (3, t0 + dt.timedelta(hours=1), "2920", "B", -3.0, "b")]
    b2 = [(4, t0 + dt.timedelta(hours=2), "2910", "A", 1.0, "latest"),
          (5, t0 - dt.timedelta(hours=5), "2920", "B", 9.0, "older")]
    spark.createDataFrame(b1, OVERRIDE_EVENT_SCHEMA).write.mode("append").parquet(src)
    log, ckpt = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "ckpt_ov")
    stream_overrides(spark, src, log, ckpt)
    spark.createDataFrame(b2, OVERRIDE_EVENT_SCHEMA).write.mode("append").parquet(src)
    stream_overrides(spark, src, log, ckpt)
    got = sorted(map(tuple, latest_from_log(spark, log).collect()), key=repr)
    batch = latest_overrides(spark.createDataFrame(b1 + b2, OVERRIDE_EVENT_SCHEMA))
    assert got == sorted(map(tuple, batch.collect()), key=repr)
    assert dict(((p, m), n) for p, m, _, n in got)[("2910", "A")] == "latest"


def test_refresh_applies_streamed_overrides(spark, tmp_dir):
    from stockgrid.refresh import refresh
    up = os.path.join(tmp_dir, "up")
    os.makedirs(up)
    write_uploads(up)
    master = os.path.join(tmp_dir, "master.csv")
    with open(master, "w") as fh:
        fh.write("Supplier,Plant,Material,TOL_Material,Description,Latest_Forecast_Qty,Forecast_Source_Column\n")
        fh.write("Alimentias,2910,10000,0,P,40,Forecast AS400\n")
    src = os.path.join(tmp_dir, "events")
    t0 = dt.datetime(2026, 1, 1)
    spark.createDataFrame([(1, t0, "2910", "10000", 25.0, "push"), (2, t0 - dt.timedelta(days=1), "2910", "10000",
                                                                   -99.0, "old")],
                          OVERRIDE_EVENT_SCHEMA).write.parquet(src)
    log = os.path.join(tmp_dir, "log")
    stream_overrides(spark, src, log, os.path.join(tmp_dir, "ck"))
    base = refresh(spark, up, master, allow_invalid=True)["grid"].filter("Plant = '2910' and Material = '10000'").first()
    res = refresh(spark, up, master, overrides=log, allow_invalid=True)["grid"]
    r = res.filter("Plant = '2910' and Material = '10000'").first()
    assert (r.Manual_Override, r.Planner_Note) == (25.0, "push")
    assert r.Suggested_Order_Qty == base.Suggested_Order_Qty + 25
