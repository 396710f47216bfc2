"""Nothing is cut: wide sheets, long formulas, null groups, malformed rows, whole-row twins, hot sheets, dates as written."""
from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stockgrid import config
from stockgrid.functions.normalize import coerce_timestamp
from stockgrid.functions.ranking import row_number_within, top_k_within
from stockgrid.operators import master_build as mb
from stockgrid.operators import quality
from stockgrid.session import ensure_checkpoint_dir
from stockgrid.sources import files

CELL = "sheet string, row_no int, col_no int, value string, formula string"


def test_wide_sheet_and_long_formula(spark):
    rows = [("W", 3, c, f"Forecast {c}", None) for c in range(1, 301)] + [("W", 1, 1, "title", None)]
    rows += [("W", 4, c, str(c), None) for c in range(1, 301)]
    long = "=IF(#REF!," + "A1+" * 330 + "1)"
    rows += [("W", 5, 1, "#REF!", long)]
    cells = spark.createDataFrame(rows, CELL)
    assert mb.header_row(cells).collect() == [("W", 3, 300)]
    assert mb.header_tags(cells).filter("tags = 'forecast'").count() == 300
    assert mb.header_row(cells, max_col=80).first().text_cells == 80
    s = mb.broken_formula_samples(cells).collect()
    assert [(r.formula, r.shown) for r in s] == [(long, long[:200])]
    assert mb.tagged_samples(cells).filter("row_no = 4").count() == 300


def test_hot_sheet_is_split(spark, monkeypatch):
    """One sheet with nine tenths of the cells: no exchange of cells on the sheet alone, results as with plain joins."""
    rows = [(s, 3, c, v, None) for s in ("hot", "cold") for c, v in
            ((1, config.LABEL_PLANT), (2, config.LABEL_SAP), (3, config.LABEL_TOL), (4, "Product"), (5, "Forecast"))]
    for s, n in (("hot", 900), ("cold", 100)):
        for r in range(4, 4 + n):
            rows += [(s, r, 1, "2910", None), (s, r, 2, f"{r}.0", None), (s, r, 3, str(r), None),
                     (s, r, 4, " x ", None), (s, r, 5, str(r), None)]
    cells = spark.createDataFrame(rows, CELL)
    monkeypatch.setattr(mb, "SLICE_ROWS", 100)
    master = mb.build_master(cells)
    assert master.groupBy("Supplier").count().orderBy("Supplier").collect() == [("cold", 100), ("hot", 900)]
    assert master.filter("Latest_Forecast_Qty = double(Material) and Plant = '2910' and Description = 'x'").count() == 1000
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stored = mb.with_sheet(cells, mb.sheet_roles(cells))
        # the master comes from one shuffle of the cells: the grouping by row keeps the slices
        plan = mb.build_master(cells.select("*"))._jdf.queryExecution().executedPlan().toString()
        by_slice = [x for x in plan.split("\n") if "Exchange hashpartitioning(sheet" in x and "_slice" in x]
        assert len(by_slice) == 2 and "row_no" not in "".join(x.split("hashpartitioning")[1] for x in by_slice)
        sizes = [n for n in stored.rdd.glom().map(len).collect() if n]
        assert max(sizes) < 0.5 * sum(sizes)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_null_group_is_numbered(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, k int")
    got = row_number_within(df, ["g"], ["k"], out_col="rn").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 1, 1), (None, 2, 2), ("a", 1, 1)], key=str)


def test_top_k_beyond_the_group_limit_raises(spark):
    with pytest.raises(ValueError):
        top_k_within(spark.range(3).withColumn("g", F.lit(1)), ["g"], ["id"], 1001)


def test_cluster_without_shared_folder_raises():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_dates_keep_their_wall_clock(spark):
    texts = ["2026-03-29T02:30:00.000", "2026-03-08 02:30:15.123456789", "2026-03-08T02:30:15.25Z", "2026-09-01",
             "2026-09-01 23:59", "3/8/2026 2:30", "12/31/2026", "2026-02-30", "2026-01-01 25:00:00", "45000",
             "2026-01-01 00:00:60", "13/1/2026", "", None]
    want = [dt.datetime(2026, 3, 29, 2, 30), dt.datetime(2026, 3, 8, 2, 30, 15, 123456),
            dt.datetime(2026, 3, 8, 2, 30, 15, 250000), dt.datetime(2026, 9, 1), dt.datetime(2026, 9, 1, 23, 59),
            dt.datetime(2026, 3, 8, 2, 30), dt.datetime(2026, 12, 31)] + [None] * 7
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r.v for r in df.select("i", coerce_timestamp("t").alias("v")).orderBy("i").collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_malformed_rows_make_an_error(spark, tmp_dir):
    head = ",".join(config.ON_HAND_HEADERS)
    good = ",".join(["x"] * len(config.ON_HAND_HEADERS))
    name = next(f for f, (k, _) in config.UPLOAD_FILE_MAP.items() if k == "on_hand").replace(".xlsx", ".csv")
    path = os.path.join(tmp_dir, name)
    with open(path, "w") as f:
        f.write("\n".join([head, good, good + ",EXTRA", good]) + "\n")
    df = files.read_kind(spark, path, "on_hand")
    assert [r._malformed for r in df.orderBy("_row_id").collect()] == [False, True, False]
    got = files.load_folder(spark, tmp_dir)["manifest"].filter("row_count > 0").first()
    assert (got.row_count, got.malformed_rows, got.header_result, got.status) == (3, 1, "ok", "Error")


def test_duplicates_are_whole_rows(spark):
    from stockgrid.plans.catalog import REGISTRY
    from stockgrid.sources import testdata as td
    plain = {r.kind: r.duplicate_rows for r in quality.duplicate_rows(
        td.source_rows(spark, SF_SMALL), td.KIND_COLUMNS).collect()}
    twins = {r.kind: r.duplicate_rows for r in REGISTRY["duplicate_rows"].build(spark, SF_SMALL).collect()}
    assert set(plain.values()) == {0} and all(n > 0 and n % 2 == 0 for n in twins.values()) and len(twins) == 3


def test_duplicates_join_the_lines_once(spark):
    """Both passes, hashes and whole rows, read the stored join and no source table."""
    from stockgrid.plans.catalog import REGISTRY
    from stockgrid.sources import testdata as td
    read = REGISTRY["duplicate_rows"].build(spark, SF_SMALL)
    assert not [f for f in read.inputFiles() if "lineitem" in f or "orders" in f]
    want = quality.duplicate_rows(td.resent_rows(spark, SF_SMALL), td.KIND_COLUMNS)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, want.collect()))


def test_master_without_activity_is_exercised(spark):
    from stockgrid.plans.catalog import REGISTRY
    assert REGISTRY["master_no_activity"].build(spark, SF_SMALL).count() > 0


def test_master_reads_each_plant_by_itself(spark, tmp_dir):
    """What the target lookup sorts in a scan task is at most one row a part, and the rows are those of parts exploded to plants."""
    from stockgrid.sources import testdata as td
    parts = [(k, f"name {k}", f"Brand#{k % 5}", k % 50) for k in range(1, 400)]
    parts += [(7, "again", "Brand#1", 8), (7, "again", "Brand#1", 8), (None, "no key", "Brand#2", 3), (21, None, None, None), (40, None, None, 5)]
    part = spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int")
    part.coalesce(1).write.parquet(f"{tmp_dir}/part.parquet")
    got = td.product_master(spark, tmp_dir)
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) <= len(parts)
    cols = ("concat('{m}', CAST(p_partkey AS STRING)) AS Material", "{s} AS Supplier", "CAST(p_partkey AS STRING) AS TOL_Material",
            "p_name AS Description", "CAST({f} AS DOUBLE) AS Latest_Forecast_Qty")
    want = [part.filter(where).selectExpr(f"{plant} AS Plant", *[c.format(m=m, s=s, f=f) for c in cols]) for where, plant, m, s, f in (
        ("p_size % 10 <> 0", "explode(array('2910', '2920', '2930'))", "100", "p_brand", "IF(p_size % 10 = 1, NULL, p_size * 4.5)"),
        ("p_partkey % 7 = 0", "'2910'", "100", "'Brand#ALT'", "p_size * 3.0"),
        ("p_partkey % 20 = 0", "'2930'", "900", "p_brand", "p_size * 2.0"))]
    want = want[0].unionByName(want[1]).unionByName(want[2])
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
