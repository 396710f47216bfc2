"""File sources and sinks on small CSVs written to a fresh folder."""
from __future__ import annotations

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.sinks.export import ExportBlocked, export_bundle, write_csv
from stockgrid.sources import files


def _row(kind, plant, i):
    vals = {h: "" for h in config.HEADERS_BY_KIND[kind]}
    vals["Plant"] = plant
    vals["Material"] = f" 1000{i}.0"
    if kind == "customer_orders":
        vals.update({"Order Quantity": "10", "Confirmed Quantity (CS)": "1d" if i == 2 else "4",
                     "Requested Delivery Date": "2026-09-01"})
    elif kind == "on_hand":
        vals.update({"Unrestricted Stock": "5", "Blocked Stock": "1", "Shelf Life Expiration Date": "2026-12-01"})
    else:
        vals.update({"Open PO Qty": "3", "PO Quantity": "4", "PO Request Quantity": "2",
                     "Delivery Date": "2026-08-25 00:00:00"})
    return vals


def write_uploads(folder):
    for fname, (kind, plant) in config.UPLOAD_FILE_MAP.items():
        if fname == "OR2930.xlsx":
            continue  # missing upload
        headers = list(config.HEADERS_BY_KIND[kind])
        if fname == "2930Customerorders.xlsx":
            headers[0], headers[1] = headers[1], headers[0]  # reordered header
        path = os.path.join(folder, fname.replace(".xlsx", ".csv"))
        with open(path, "w", newline="") as fh:
            w = csv.DictWriter(fh, fieldnames=headers)
            w.writeheader()
            for i in range(3):
                r = _row(kind, plant, i)
                if fname == "OR2920.xlsx" and i == 1:
                    r["Plant"] = "2999"
                w.writerow(r)


def test_load_folder_headers_types_manifest(spark, tmp_dir):
    write_uploads(tmp_dir)
    with open(os.path.join(tmp_dir, "OR2930.csv"), "w") as fh:  # content but no header line
        fh.write("\n\n")
    out = files.load_folder(spark, tmp_dir)
    hdr = {r.file_name: r.result for r in out["headers"].collect()}
    assert hdr["2930Customerorders.csv"] == "reordered" and hdr["OH20.csv"] == "ok"
    man = {r.file_name: r for r in out["manifest"].collect()}
    assert man["OR2930.xlsx"].status == "Error" and man["OR2930.xlsx"].header_result == "unreadable"
    assert man["2910Customerorders.xlsx"].status == "Valid"
    assert man["2930Customerorders.xlsx"].status == "Error"
    assert man["OR2920.xlsx"].status == "Error" and man["OR2920.xlsx"].violations == "2999"
    assert man["OH20.xlsx"].status == "Valid" and man["OH20.xlsx"].row_count == 3
    assert len(man["OH20.xlsx"].content_hash) == 64 and man["OH20.xlsx"].error is None
    co = out["customer_orders"]
    r = co.filter(F.col("_source_file") == "2910Customerorders.csv").orderBy("_row_id").collect()
    assert [x.Material for x in r] == ["10000", "10001", "10002"]
    assert [x.confirmed_qty for x in r] == [4.0, 4.0, None]
    assert r[0].requested_date.year == 2026


MASTER = ("Supplier,Plant,Material,TOL_Material,Description,Latest_Forecast_Qty,Forecast_Source_Column\n"
          "Alimentias,2910,10000,0,P,40,Forecast AS400\nCows,2910,10000,0,P,n/a,\n,2920,10001,1,Q,5,\n")


def refreshed(spark, folder, **how):
    from stockgrid.refresh import refresh
    up, master = os.path.join(folder, "up"), os.path.join(folder, "master.csv")
    os.makedirs(up)
    write_uploads(up)
    # a file of several splits, with doubled quotes, repeated rows and rows of other plants
    headers = config.HEADERS_BY_KIND["on_hand"]
    with open(os.path.join(up, "OH2910.csv"), "w", newline="") as fh:
        w = csv.DictWriter(fh, fieldnames=headers)
        w.writeheader()
        for i in range(3000):
            w.writerow(_row("on_hand", "2910", i % 700) | {"Batch": f"B{i // 2}", "Storage Location": f'say "{i // 2}", twice'})
    with open(master, "w") as fh:
        fh.write(MASTER)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        return refresh(spark, up, master, os.path.join(folder, "out"), allow_invalid=True, **how)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def read_section(path):
    """All records of a section in the order of its part files, and its header."""
    rows, header = [], None
    for part in sorted(glob.glob(os.path.join(path, "*.csv"))):
        with open(part, newline="") as fh:
            records = list(csv.reader(fh))
        if records:
            header = records[0]
            rows += records[1:]
    return header, rows


def test_export_reads_back_row_by_row(spark, tmp_dir):
    res = refreshed(spark, tmp_dir)
    written = res["written"]
    header, rows = read_section(written["On Hand 2910"])
    assert header == list(config.HEADERS_BY_KIND["on_hand"])
    with open(os.path.join(tmp_dir, "up", "OH2910.csv"), newline="") as fh:
        source = list(csv.reader(fh))[1:]
    at = {h: i for i, h in enumerate(header)}
    for h in ("Batch", "Storage Location", "Plant"):
        assert [r[at[h]] for r in rows] == [r[at[h]] for r in source]
    assert [r[at["Material"]] for r in rows] == [r[at["Material"]].strip()[:-2] for r in source]    # an identifier
    # every section is there, also without rows: other files' plants, suppliers without a key
    for label in ("Customer Orders", "On Hand", "Open Orders"):
        for plant in config.PLANTS:
            assert read_section(written[f"{label} {plant}"])[0] is not None
    assert read_section(written["Open Orders 2930"]) == (list(config.HEADERS_BY_KIND["open_orders"]), [])
    assert all(read_section(written[s])[0][0] == "Supplier" for s in config.SUPPLIERS)
    assert [r[1:3] for r in read_section(written["Alimentias"])[1]] == [["2910", "10000"]]
    header, rows = read_section(written["ordering_dashboard"])
    assert len(rows) == res["grid"].count() and [r[1:3] for r in rows] == sorted(r[1:3] for r in rows)
    checks = {r[0]: r for r in read_section(written["file_validation"])[1]}
    assert checks["OR2930.xlsx"][3] == "Missing" and checks["2930Customerorders.xlsx"][5].startswith("Columns present but")
    assert dict(read_section(written["duplicate_rows"])[1])["on_hand"] == "0"
    report = read_section(written["reconciliation_report"])[1]
    assert {r[0] for r in report} >= {"file", "missing_values", "unmatched_key", "not_in_master", "variance", "gate", "plant_violation"}
    nulls = {(r[1], r[4]): float(r[5]) for r in report if r[0] == "missing_values"}
    assert nulls["on_hand", "batch"] == 6 and len(nulls) == sum(len(h) for h in config.HEADERS_BY_KIND.values())
    assert read_section(written["stamp"])[1][0][1].startswith("PASS")


def test_export_is_all_or_nothing(spark, tmp_dir):
    from stockgrid.operators import onepass
    from stockgrid.sinks.export import current_export
    out = os.path.join(tmp_dir, "out")
    assert current_export(spark, out) == {}
    res = refreshed(spark, tmp_dir)
    first = current_export(spark, out)
    assert first == res["written"] and all("run=1" in p for p in first.values())
    # a section that fails part-way leaves the export before it
    broken = res["grid"].withColumn("Description", F.raise_error(F.lit("no description")).cast("string"))
    with pytest.raises(Exception, match="no description"):
        export_bundle(out, res["stored"], broken, res["duplicates"], res["manifest"])
    bad_files = res["manifest"].withColumn("error", F.raise_error(F.lit("no file")).cast("string"))
    with pytest.raises(Exception, match="no file"):
        export_bundle(out, res["stored"], res["grid"], res["duplicates"], bad_files)
    assert os.path.exists(os.path.join(out, "run=2")) and current_export(spark, out) == first
    again = export_bundle(out, res["stored"], res["grid"], res["duplicates"], res["manifest"])
    assert current_export(spark, out) == again and all("run=2" in p for p in again.values())
    # the gate
    s = res["stored"]
    keys = s.keys.withColumn("Open_PO_Qty", F.col("Open_PO_Qty") + 1)
    blocked = onepass.store(s.rows, keys, s.columns_by_kind, s.required)
    with pytest.raises(ExportBlocked):
        export_bundle(os.path.join(tmp_dir, "blocked"), blocked, res["grid"], res["duplicates"])
    assert not os.path.exists(os.path.join(tmp_dir, "blocked"))


def test_write_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("2910", 1.5), ("2920", None)], "Plant string, q double")
    p = write_csv(df, os.path.join(tmp_dir, "view"))
    back = spark.read.option("header", True).schema("Plant string, q double").csv(p)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("2910", 1.5), ("2920", None)], key=str)


def test_inspect_exports(spark, tmp_dir):
    write_uploads(tmp_dir)
    out = {r.file_name: r for r in files.inspect_exports(spark, tmp_dir).collect()}
    assert out["OR2920.csv"].plants == "2920,2999" and out["OR2920.csv"].row_count == 3
    # a bad header changes nothing about the rows and plants that a file holds
    bad = out["2930Customerorders.csv"]
    assert bad.result == "reordered" and bad.row_count == 3 and bad.plants == "2930"
    assert "OR2930.csv" not in out
    with open(os.path.join(tmp_dir, "notes 1+1.csv"), "w") as fh:
        fh.write("Region,Plant,Note\nx,7000.0,\"a, b\"\n\ny,2910,c\n")
    with open(os.path.join(tmp_dir, "OR2930.csv"), "w") as fh:
        fh.write("Material,Amount\n1,2\n")
    open(os.path.join(tmp_dir, "empty.csv"), "w").close()
    out = {r.file_name: r for r in files.inspect_exports(spark, tmp_dir).collect()}
    assert (out["notes 1+1.csv"].result, out["notes 1+1.csv"].row_count, out["notes 1+1.csv"].plants) == ("unrouted", 2, "2910,7000")
    assert out["OR2930.csv"].result == "mismatch" and out["OR2930.csv"].row_count == 1 and out["OR2930.csv"].plants == ""
    assert "missing columns: ['PO Number'" in out["OR2930.csv"].message and "unexpected columns: ['Amount']" in out["OR2930.csv"].message
    assert "empty.csv" not in out    # Spark lists no empty files


def test_manifest_says_what_is_wrong(spark, tmp_dir):
    write_uploads(tmp_dir)
    with open(os.path.join(tmp_dir, "OH2930.csv"), "a") as fh:
        fh.write("1,2\n")
    out = files.load_folder(spark, tmp_dir)
    man = {r.file_name: r for r in out["manifest"].collect()}
    assert man["OR2930.xlsx"].error is None and man["OR2930.xlsx"].status == "Missing"
    assert man["2930Customerorders.xlsx"].error == "Columns present but reordered relative to the expected schema."
    assert man["OR2920.xlsx"].error == "Plant column contains unexpected value(s) ['2999'] for a file mapped to plant 2920."
    assert man["OH2930.xlsx"].error == "1 row(s) have more or fewer fields than the header." and man["OH2930.xlsx"].malformed_rows == 1
    kinds = {k: out[k] for k in config.KINDS if k in out}
    assert [tuple(r) for r in files.plant_violations(spark, kinds).collect()] == [("OR2920.xlsx", "open_orders", "2920", "2999", 1)]


def test_missing_upload_is_reported(spark, tmp_dir):
    write_uploads(tmp_dir)
    man = {r.file_name: r for r in files.load_folder(spark, tmp_dir)["manifest"].collect()}
    assert man["OR2930.xlsx"].status == "Missing" and man["OR2930.xlsx"].row_count == 0


def test_refresh_end_to_end(spark, tmp_dir):
    from stockgrid.refresh import UploadsInvalid, refresh
    up = os.path.join(tmp_dir, "up")
    os.makedirs(up)
    write_uploads(up)
    master = os.path.join(tmp_dir, "master.csv")
    with open(master, "w") as fh:
        fh.write("Supplier,Plant,Material,TOL_Material,Description,Latest_Forecast_Qty,Forecast_Source_Column\n")
        fh.write("Alimentias,2910,10000,0,P,40,Forecast AS400\nCows,2910,10000,0,P,n/a,\n,2920,10001,1,Q,5,\n")
    try:
        refresh(spark, up, master)
        raise AssertionError("invalid uploads must stop the refresh")
    except UploadsInvalid:
        pass
    res = refresh(spark, up, master, os.path.join(tmp_dir, "out"), allow_invalid=True)
    g = {(r.Plant, r.Material): r for r in res["grid"].collect()}
    assert g[("2910", "10000")].Supplier == "Alimentias" and g[("2910", "10000")].Target_Stock == 40
    assert g[("2920", "10001")].Risk_Status == "Review"  # master row without supplier
    assert "ordering_dashboard" in res["written"] and "audit" in res["written"]
    text = "\n".join(r.value for r in spark.read.text(res["written"]["audit"]).collect())
    assert "AUDIT REPORT" in text and "Reconciliation: PASS" in text
    assert "OR2930.xlsx: Missing" in text and "2999" in text


def test_header_parse_quotes_and_width(spark, tmp_dir):
    names = [f"Col {i}" for i in range(400)] + ['Quoted, with comma', 'Has ""quote""']
    with open(os.path.join(tmp_dir, "wide.csv"), "w") as fh:
        fh.write(",".join(names[:400]) + ',"Quoted, with comma","Has ""quote"""\n1,2\n')
    rows = files.header_rows(spark, os.path.join(tmp_dir, "wide.csv")).orderBy("ordinal").collect()
    assert len(rows) == 402 and rows[400].name == "Quoted, with comma" and rows[401].name == 'Has "quote"'


def test_blank_header_field_is_rejected(spark, tmp_dir):
    from stockgrid.operators.loading import header_validation
    hdr = list(config.HEADERS_BY_KIND["on_hand"])
    with open(os.path.join(tmp_dir, "OH2910.csv"), "w") as fh:
        fh.write(hdr[0] + ",," + ",".join(hdr[1:]) + "\n")
    h = files.header_rows(spark, os.path.join(tmp_dir, "OH2910.csv"))
    r = header_validation(h, hdr, file_col="file_name").first()
    assert r.result == "mismatch" and r.extra_columns == "(blank)"


def test_header_with_byte_order_mark(spark, tmp_dir):
    from stockgrid.operators.loading import header_validation
    hdr = list(config.HEADERS_BY_KIND["on_hand"])
    with open(os.path.join(tmp_dir, "OH2910.csv"), "w", encoding="utf-8-sig") as fh:
        fh.write(",".join(hdr) + "\n1,2\n")
    r = header_validation(files.header_rows(spark, os.path.join(tmp_dir, "OH2910.csv")), hdr,
                          file_col="file_name").first()
    assert r.result == "ok"
