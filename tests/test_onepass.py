"""Reports from the metrics row and the key table agree with the operators that read the sources each by itself."""
from __future__ import annotations

import pytest
from conftest import SF_SMALL
from fixtures import d
from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.operators import grid as g
from stockgrid.operators import loading, onepass, quality
from stockgrid.plans.core import load_target
from stockgrid.plans.reports import REQUIRED
from stockgrid.sources import testdata as td

ROW = ("kind string, Plant string, Material string, order_qty double, confirmed_qty double, unrestricted double, quality double, "
       "blocked double, open_po_qty double, po_qty double, po_request_qty double, inbound_qty double, expiry timestamp_ntz, "
       "delivery_date timestamp_ntz, expected_plant string, observed_plant string")
COLUMNS = {"customer_orders": ["Plant", "Material", "order_qty", "confirmed_qty"], "on_hand": ["Plant", "Material", "unrestricted"],
           "open_orders": ["Plant", "Material", "open_po_qty"]}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same(a, b):
    assert rows_of(a.select(*sorted(a.columns))) == rows_of(b.select(*sorted(a.columns)))


@pytest.fixture(scope="module")
def stored(spark):
    rows = td.rows_with_files(td.lines(spark, SF_SMALL))
    return onepass.store(rows, onepass.key_table(rows, load_target(spark, SF_SMALL)), td.KIND_COLUMNS, REQUIRED)


def test_sections_equal_the_separate_operators(spark, stored):
    tagged, target = td.source_rows(spark, SF_SMALL), load_target(spark, SF_SMALL)
    grid = g.ordering_grid(tagged, target)
    same(onepass.grid(stored), grid)
    same(onepass.variances(stored), quality.reconciliation_variance(tagged, grid))
    same(onepass.gate(stored), quality.reconciliation_gate(quality.reconciliation_variance(tagged, grid)))
    same(onepass.null_counts(stored), quality.null_counts(spark, tagged, td.KIND_COLUMNS))
    same(onepass.unmatched(stored), quality.unmatched_by_source(tagged, target))
    same(onepass.not_in_master(stored), quality.sources_not_in_master(tagged, target))
    same(onepass.no_activity(stored), quality.master_no_activity(tagged, target))
    status = loading.load_status(td.required_files(spark), td.file_rows(spark, SF_SMALL))
    same(onepass.status_with_values(stored).drop("violating_rows", "error"), status)
    errors = {r.error for r in onepass.status_with_values(stored).where("status = 'Error'").collect()}
    assert errors <= {f"Plant column contains unexpected value(s) ['2999'] for a file mapped to plant {p}." for p in config.PLANTS}
    counts = {r.kind: r.n for r in onepass.unmatched_counts(stored).collect()}
    assert counts == {r.kind: r["count"] for r in quality.unmatched_by_source(tagged, target).groupBy("kind").count().collect()}


def test_edge_rows(spark):
    """Null keys, a missing kind, infinite and missing values, a master key without activity, a file of no required plant."""
    inf = float("inf")
    names = [c.split()[0] for c in ROW.split(", ")]
    some = [dict(kind="customer_orders", Material="m", order_qty=5.0, expected_plant="2910", observed_plant="2999"),
            dict(kind="customer_orders", Plant="2910", Material="m", confirmed_qty=2.0, expected_plant="2910", observed_plant="2910"),
            dict(kind="on_hand", Plant="2910", unrestricted=inf, expiry=d("2026-01-01"), expected_plant="7777", observed_plant="1"),
            dict(kind="on_hand", Plant="2910", Material="m", unrestricted=float("nan"))]
    rows = [tuple(r.get(n) for n in names) for r in some]
    rows = spark.createDataFrame(rows, ROW)
    target = spark.createDataFrame([("2910", "m", "S", "t", "d", 4.0), ("2920", "gone", "S", "t", "d", 1.0)],
                                   "Plant string, Material string, Supplier string, TOL_Material string, Description string, Target_Stock double")
    keys = onepass.key_table(rows, target)
    s = onepass.store(rows, keys, COLUMNS, REQUIRED)
    assert rows_of(onepass.unmatched(s)) == [("customer_orders", None, "m"), ("on_hand", "2910", None)]
    assert rows_of(onepass.no_activity(s)) == [("2920", "gone")] and onepass.grid(s).count() == 3
    assert not onepass.gate(s).first().passed    # an infinite total is no number
    nulls = {(r.kind, r.column): r.null_count for r in onepass.null_counts(s).collect()}
    assert nulls["on_hand", "unrestricted"] == 2 and nulls["customer_orders", "Plant"] == 1 and nulls["open_orders", "Plant"] == 0
    status = {(r.kind, r.plant): r for r in onepass.status_with_values(s).collect()}
    assert status["customer_orders", "2910"].violations == "2999" and status["customer_orders", "2910"].status == "Error"
    assert status["open_orders", "2930"].status == "Missing"
    assert rows_of(onepass.violations(s)) == [("customer_orders", "2910", "2999", 1), ("on_hand", "7777", "1", 1)]
    report = onepass.report(s, quality.duplicate_rows(rows, COLUMNS))
    assert {r.section for r in report.collect()} == {"file", "plant_violation", "duplicate_rows", "missing_values", "unmatched_key",
                                                     "not_in_master", "no_activity", "source_total", "dashboard_total", "variance", "gate"}
    none = rows.where("false")
    empty = onepass.store(none, onepass.key_table(none, target.where("false")), COLUMNS, REQUIRED)
    assert onepass.gate(empty).first().passed and onepass.grid(empty).count() == 0
    assert {r.status for r in onepass.file_status(empty).collect()} == {"Missing"}


def test_rows_outside_the_contracts_count_in_all(spark):
    """Rows of another or no kind, or of a plant no file is required for, are in the number of rows and in no file."""
    names = [c.split()[0] for c in ROW.split(", ")]
    some = [dict(kind="on_hand", Plant="2910", Material="m", unrestricted=2.5, expected_plant="1", observed_plant="2"),
            dict(kind="on_hand", Material="m", unrestricted=0.25, expected_plant="2910", observed_plant="2"),
            dict(kind="returns", Plant="2910", expected_plant="2910"), dict(Plant="2910")]
    rows = spark.createDataFrame([tuple(r.get(n) for n in names) for r in some], ROW)
    m = onepass.source_metrics(rows, COLUMNS, [("on_hand", "2910")]).first()
    assert (m.n_rows, m.rows_on_hand_2910, m.wrong_on_hand_2910, m.null_on_hand_Plant, m.null_open_orders_Plant) == (4, 1, 1, 1, 0)
    assert onepass.source_metrics(rows.where("false"), COLUMNS, []).first().n_rows == 0


def test_duplicates_survive_hash_collisions(spark):
    """With every hash equal, and with a hash that only knows one column, whole rows still decide."""
    data = [("on_hand", "p", str(i % 40), float(i % 3)) for i in range(200)] + [("open_orders", "p", None, 1.0), ("open_orders", "p", None, 1.0),
            ("open_orders", None, "p", 1.0), ("customer_orders", "p", "q", 0.0), ("customer_orders", "p", "q", -0.0)]
    df = spark.createDataFrame(data, "kind string, Plant string, Material string, unrestricted double")
    columns = {k: ["Plant", "Material", "unrestricted"] for k in config.KINDS}
    want = {"on_hand": 160, "open_orders": 2, "customer_orders": 2}  # 120 pairs, 80 of them twice
    for by in (quality.row_hash, lambda c, s: F.lit(7).cast("long"), lambda c, s: F.xxhash64("Plant")):
        assert {r.kind: r.duplicate_rows for r in quality.duplicate_rows(df, columns, by).collect()} == want
    assert {r.duplicate_rows for r in quality.duplicate_rows(df.where("false"), columns).collect()} == {0}
    wide = spark.createDataFrame([tuple(range(130))] * 2 + [tuple(range(129)) + (None,)], ", ".join(f"c{i} int" for i in range(130)))
    assert quality.full_row_duplicates(spark, {"on_hand": wide}).first().duplicate_rows == 2


def test_hot_duplicate_group(spark):
    df = spark.range(60000).selectExpr("'on_hand' as kind", "if(id % 3 = 0, 'same', cast(id as string)) as Plant")
    assert quality.duplicate_rows(df, {"on_hand": ["Plant"]}).first().duplicate_rows == 20000


def test_together_returns_in_order_and_raises(spark):
    assert onepass.together(lambda: 1, lambda: spark.range(5).count(), lambda: "x") == [1, 5, "x"]
    with pytest.raises(ZeroDivisionError):
        onepass.together(lambda: 1, lambda: 1 // 0)
