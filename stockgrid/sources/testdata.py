"""Adapters from the shared parquet tables to the engine's inputs.

The three source kinds, the product master, the override log and the dirty
text / file / header inputs are all derived from ``lineitem``, ``orders``,
``part`` and ``events`` by fixed rules, so every job's work grows with the
tables. The same rules, written as SQL, are the oracle's views.

``source_rows`` is the engine's main input: all three kinds in one tagged
frame built from a single scan of ``lineitem`` joined once to ``orders``.
The per-kind frames are filters of the same join.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.session import app_id

RETURNFLAG_KIND = {"N": "customer_orders", "R": "on_hand", "A": "open_orders"}


_READERS: dict[tuple[str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One shared (read-only) table. The scan definition is made once per
    application and path, so repeated queries skip file listing and footer
    reads at planning time; each query still plans its own column pruning
    and filters over it."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (app_id(spark), path)
    df = _READERS.get(key)
    if df is None or df.sparkSession is not spark:
        df = _READERS[key] = spark.read.parquet(path)
    return df


# fixture rule: supplier key -> plant code, one in 33 keys without plant
PLANT_OF_SUPPKEY_SQL = ("CASE WHEN l_suppkey % 33 = 7 THEN CAST(NULL AS STRING) WHEN l_suppkey % 3 = 0 THEN '2910' "
                        "WHEN l_suppkey % 3 = 1 THEN '2920' ELSE '2930' END")


def plant_by_mod3(key: Column) -> Column:
    return (F.when(key % 3 == 0, F.lit("2910"))
            .when(key % 3 == 1, F.lit("2920"))
            .otherwise(F.lit("2930")))


def material_of(key: Column) -> Column:
    return F.concat(F.lit("100"), key.cast("string"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the status of their order. The two narrow columns of the orders are the table a line is looked up in, shard
    by shard, so the lines, four times as many, are not sorted for the join beside the aggregates that follow in its tasks."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_returnflag", "l_linestatus", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").hint("shuffle_hash")
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner").drop("o_orderkey")
    return joined.selectExpr("*", f"{PLANT_OF_SUPPKEY_SQL} AS Plant",
                             "concat('100', CAST(l_partkey AS STRING)) AS Material")


# --- per-kind measure expressions over `lines` --------------------------------

# The fixture rule of each kind's columns, as SQL over `lines` (parsed once
# on the JVM side per use instead of a py4j call per expression node).
_KIND_SQL = {
    "customer_orders": [
        ("sales_order", "l_orderkey"),
        ("order_qty", "l_quantity"),
        ("confirmed_qty", "CASE WHEN l_linestatus = 'F' THEN l_quantity END"),
        ("requested_date", "l_shipdate"),
    ],
    "on_hand": [
        ("batch", "l_orderkey"),
        ("unrestricted", "CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE CAST(0 AS DOUBLE) END"),
        ("quality", "CASE WHEN l_linestatus = 'O' AND o_orderstatus = 'P' THEN l_quantity END"),
        ("blocked", "CASE WHEN l_linestatus = 'O' AND o_orderstatus = 'O' THEN l_quantity END"),
        ("expiry", "CASE WHEN l_linenumber <> 1 THEN l_shipdate END"),
    ],
    "open_orders": [
        ("po_number", "l_orderkey"),
        ("open_po_qty", "CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE CAST(0 AS DOUBLE) END"),
        ("po_qty", "l_quantity"),
        ("po_request_qty", "CAST(FLOOR(l_quantity * 0.75D) AS DOUBLE)"),
        ("inbound_qty", "CASE WHEN o_orderstatus = 'P' THEN l_quantity END"),
        ("delivery_date", "l_shipdate"),
    ],
}


_KIND_FLAG = {v: k for k, v in RETURNFLAG_KIND.items()}
KIND_COLUMNS = {k: ["Plant", "Material"] + [n for n, _ in _KIND_SQL[k]] for k in config.KINDS}


def kind_rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One source kind as its own frame (Plant, Material + kind columns)."""
    src = lines(spark, sf_dir).filter(F.col("l_returnflag") == _KIND_FLAG[kind])
    return src.selectExpr("Plant", "Material", *[f"{e} AS {n}" for n, e in _KIND_SQL[kind]])


def customer_orders(spark, sf_dir):
    return kind_rows(spark, sf_dir, "customer_orders")


def on_hand(spark, sf_dir):
    return kind_rows(spark, sf_dir, "on_hand")


def open_orders(spark, sf_dir):
    return kind_rows(spark, sf_dir, "open_orders")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three kinds in one tagged frame from one scan and one join.

    Columns: kind, Plant, Material and every kind's columns; a column of
    another kind is null on a row, which every aggregate ignores.
    """
    return source_rows_from(lines(spark, sf_dir))


def source_rows_from(lines_df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """``source_rows`` over an already joined ``lines`` frame, with ``more`` of its columns."""
    src = lines_df.filter(F.col("l_returnflag").isin(*RETURNFLAG_KIND))
    kind = "CASE " + " ".join(f"WHEN l_returnflag = '{f}' THEN '{k}'" for f, k in RETURNFLAG_KIND.items()) + " END"
    cols = [f"{kind} AS kind", "Plant", "Material"]
    for k in config.KINDS:
        cols += [f"CASE WHEN l_returnflag = '{_KIND_FLAG[k]}' THEN {e} END AS {n}" for n, e in _KIND_SQL[k]]
    return src.selectExpr(*cols, *more)


def rows_with_files(lines_df: DataFrame) -> DataFrame:
    """``source_rows`` with the plant a row's file is for and the plant value it carries there (null for rows of the file
    that never arrives, as in ``file_rows``)."""
    arrived = "NOT (l_returnflag NOT IN ('N', 'R') AND l_suppkey % 3 = 2)"
    expected = "CASE WHEN l_suppkey % 3 = 0 THEN '2910' WHEN l_suppkey % 3 = 1 THEN '2920' ELSE '2930' END"
    observed = "CASE WHEN l_returnflag = 'R' AND l_suppkey % 3 = 1 AND l_partkey % 40 = 0 THEN '2999' ELSE Plant END"
    with_file = lines_df.selectExpr("*", f"CASE WHEN {arrived} THEN {expected} END AS expected_plant",
                                    f"CASE WHEN {arrived} THEN {observed} END AS observed_plant")
    return source_rows_from(with_file, ["expected_plant", "observed_plant"])


def resent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_rows`` as uploads carry them when every 40th document is sent twice: its rows have whole-row twins."""
    return resent(source_rows(spark, sf_dir))


def resent(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "*", "explode(sequence(1, CASE WHEN coalesce(sales_order, batch, po_number) % 40 = 5 THEN 2 ELSE 1 END)) AS _copy"
    ).drop("_copy")


# --- product master, overrides ------------------------------------------------

def product_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master rows: every sized part at three plants, an alternate
    supplier for every seventh part at plant 2910 (duplicate keys), and a
    discontinued material, which no source has, for every 20th part.

    Each plant reads the parts in tasks of its own: the target lookup sorts what a scan task gives before it combines it, and
    that is one row a part here, where a part exploded to its plants gave three."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    sized = part.filter("p_size % 10 <> 0")
    main = [sized.selectExpr(
        f"'{plant}' AS Plant", "concat('100', CAST(p_partkey AS STRING)) AS Material",
        "p_brand AS Supplier", "CAST(p_partkey AS STRING) AS TOL_Material", "p_name AS Description",
        "CASE WHEN p_size % 10 = 1 THEN CAST(NULL AS DOUBLE) ELSE CAST(p_size * 4.5D AS DOUBLE) END"
        " AS Latest_Forecast_Qty") for plant in config.PLANTS]
    alt = part.filter("p_partkey % 7 = 0").selectExpr(
        "'2910' AS Plant", "concat('100', CAST(p_partkey AS STRING)) AS Material", "'Brand#ALT' AS Supplier",
        "CAST(p_partkey AS STRING) AS TOL_Material", "p_name AS Description",
        "CAST(p_size * 3.0D AS DOUBLE) AS Latest_Forecast_Qty")
    gone = part.filter("p_partkey % 20 = 0").selectExpr(
        "'2930' AS Plant", "concat('900', CAST(p_partkey AS STRING)) AS Material", "p_brand AS Supplier",
        "CAST(p_partkey AS STRING) AS TOL_Material", "p_name AS Description",
        "CAST(p_size * 2.0D AS DOUBLE) AS Latest_Forecast_Qty")
    return reduce(DataFrame.unionByName, [*main, alt, gone])


def override_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planner edits as an append-only log (event_id, ts, key, override, note)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        "event_id", "ts",
        plant_by_mod3(F.col("user_id")).alias("Plant"),
        material_of(F.col("user_id")).alias("Material"),
        (F.col("value") - 50).alias("Manual_Override"),
        F.col("event_type").alias("Planner_Note"),
    )


# --- dirty text, files, headers -----------------------------------------------

def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    pk, size = F.col("p_partkey"), F.col("p_size")
    pks = pk.cast("string")
    id_text = (F.when(pk % 6 == 0, F.concat(F.lit("\t"), F.lit("100"), pks, F.lit(".0 ")))
               .when(pk % 6 == 1, F.concat(F.lit(" PO-"), pks))
               .when(pk % 6 == 2, F.lit("NaN"))
               .when(pk % 6 == 3, F.lit("  "))
               .when(pk % 6 == 4, F.concat(pks, F.lit(".05")))
               .otherwise(pks))
    num_text = (F.when(size % 7 == 0, F.lit("1d"))
                .when(size % 7 == 1, F.lit("1,234"))
                .when(size % 7 == 2, F.lit("NaN"))
                .when(size % 7 == 3, F.lit(" 12 "))
                .when(size % 7 == 4, F.lit("1e3"))
                .when(size % 7 == 5, F.lit(""))
                .otherwise(size.cast("string")))
    day = F.lpad((pk % 28 + 1).cast("string"), 2, "0")
    date_text = (F.when(size % 13 == 0, F.lit("bad"))
                 .when(size % 13 == 1, F.lit("45000"))
                 .when(size % 13 == 2, F.lit(None).cast("string"))
                 .when(size % 13 == 3, F.lit("2026-02-30"))
                 .when(size % 13 == 4, F.concat(F.lit("2026-03-"), day, F.lit("T02:30:15")))
                 .when(size % 13 == 5, F.concat(F.lit(" 2026-03-"), day, F.lit(" 02:30:15.125 ")))
                 .when(size % 13 == 6, F.concat(F.lit("2026-03-"), day, F.lit("T02:30:15.250Z")))
                 .when(size % 13 == 7, F.concat(F.lit("2026-03-"), day, F.lit(" 23:59")))
                 .when(size % 13 == 8, F.concat(F.lit("3/"), (pk % 28 + 1).cast("string"), F.lit("/2026")))
                 .when(size % 13 == 9, F.concat(F.lit("03/"), day, F.lit("/2026 7:05")))
                 .when(size % 13 == 10, F.concat(F.lit("12/"), day, F.lit("/2025 17:05:09")))
                 .when(size % 13 == 11, F.lit("2026-09-01 25:00:00"))
                 .otherwise(F.concat(F.lit("2026-09-"), day)))
    return part.select(pk, id_text.alias("id_text"), num_text.alias("num_text"), date_text.alias("date_text"))


def required_files(spark: SparkSession) -> DataFrame:
    """The nine required (kind, plant) pairs: a fixed 9-row dimension."""
    rows = [(k, p) for k in config.KINDS for p in config.PLANTS]
    return spark.createDataFrame(rows, "kind string, plant string")


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source line: the file it came in (kind, expected plant)
    and the plant value it carries. Open orders of plant 2930 never arrive
    (a missing file) and some on-hand rows of 2920 carry plant 2999."""
    return file_rows_from(lines(spark, sf_dir))


def file_rows_from(src: DataFrame) -> DataFrame:
    """``file_rows`` over an already joined ``lines`` frame."""
    flag = F.col("l_returnflag")
    kind = (F.when(flag == "N", "customer_orders").when(flag == "R", "on_hand")
            .otherwise("open_orders"))
    expected = plant_by_mod3(F.col("l_suppkey"))
    observed = (F.when((flag == "R") & (F.col("l_suppkey") % 3 == 1) & (F.col("l_partkey") % 40 == 0),
                       F.lit("2999")).otherwise(F.col("Plant")))
    out = src.select(kind.alias("kind"), expected.alias("expected_plant"), observed.alias("observed_plant"))
    return out.filter(~((F.col("kind") == "open_orders") & (F.col("expected_plant") == "2930")))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated header rows, one file per part: drop / rename / swap /
    duplicate variants of the on-hand schema."""
    part = read_table(spark, sf_dir, "part").select("p_partkey")
    pk = F.col("p_partkey")
    expected = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(n).alias("name"))
                         for i, n in enumerate(config.ON_HAND_HEADERS)])
    e = part.select(pk, F.explode(expected).alias("e")).select(pk, "e.ord", "e.name")
    ordc, name = F.col("ord"), F.col("name")
    ordinal = (F.when((pk % 5 == 3) & (ordc == 1), F.lit(2))
               .when((pk % 5 == 3) & (ordc == 2), F.lit(1)).otherwise(ordc))
    new_name = F.when((pk % 5 == 2) & (ordc == 1), F.lit("Material Number")).otherwise(name)
    main = (e.filter(~((pk % 5 == 1) & (ordc == 11)))
            .select(pk.alias("file_id"), ordinal.alias("ordinal"), new_name.alias("name")))
    dup = part.filter(pk % 5 == 4).select(pk.alias("file_id"), F.lit(12).alias("ordinal"),
                                          F.lit("Material").alias("name"))
    return main.unionByName(dup)


def kind_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated header rows of every kind, one file per part and kind: last column missing, first one renamed, first two
    swapped, a second ``Material``, or as the contract has it."""
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"))
    out = None
    for kind in config.KINDS:
        names = config.HEADERS_BY_KIND[kind]
        cells = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(n).alias("name")) for i, n in enumerate(names)])
        e = part.select("file_id", F.explode(cells).alias("e")).select("file_id", "e.ord", "e.name")
        one = e.where(f"NOT (file_id % 5 = 1 AND ord = {len(names)})").selectExpr(
            f"'{kind}' AS kind", "file_id", "IF(file_id % 5 = 3 AND ord <= 2, 3 - ord, ord) AS ordinal",
            "IF(file_id % 5 = 2 AND ord = 1, concat(name, ' No.'), name) AS name")
        twice = part.where("file_id % 5 = 4").selectExpr(f"'{kind}' AS kind", "file_id", f"{len(names) + 1} AS ordinal", "'Material' AS name")
        one = one.unionByName(twice)
        out = one if out is None else out.unionByName(one)
    return out
