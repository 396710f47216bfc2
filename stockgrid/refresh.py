"""End-to-end refresh over real files: uploads -> grid -> gate -> export.

    python -m stockgrid.refresh --uploads DIR --master master.csv --out DIR [--overrides LOG] [--cache DIR]

Steps (all Spark jobs): load and validate the upload folder, stop unless
every required upload is valid (``--allow-invalid`` keeps going with the
valid files), write the tagged sources and the key table once, take their
metrics (``operators.onepass``), apply the latest planner overrides,
reconcile the pre-override grid against the sources, build the whole
reconciliation report and write the gated export. Only the validity flag,
the metrics row and file names reach the driver.
"""
from __future__ import annotations

import argparse
import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.operators import loading, onepass, quality
from stockgrid.operators.aggregate import tag_sources
from stockgrid.operators.overrides import apply_overrides
from stockgrid.operators.reports import audit_lines
from stockgrid.operators.target import target_lookup
from stockgrid.session import scratch_path
from stockgrid.sinks.export import export_bundle
from stockgrid.sources import blocks, files, results

MASTER_SCHEMA = ("Supplier string, Plant string, Material string, TOL_Material string, Description string, "
                 "Latest_Forecast_Qty string, Forecast_Source_Column string")


class UploadsInvalid(RuntimeError):
    """Raised when a required upload is missing or invalid."""


def read_master_csv(spark: SparkSession, path: str) -> DataFrame:
    """A10: the product-master CSV, keys as text, forecast coerced later."""
    return spark.read.schema(MASTER_SCHEMA).option("header", True).option("escape", '"').csv(path)


def with_files(spark: SparkSession, tagged: DataFrame) -> DataFrame:
    """Tagged rows with the plant their file is for and the plant they carry (null for files of no upload)."""
    route = files.routing(spark).select(F.col("file_name").alias("_route"), F.col("plant").alias("expected_plant"))
    out = tagged.withColumn("_route", files._csv_name(F.col("_source_file"))).join(F.broadcast(route), "_route", "left")
    return out.drop("_route").withColumn("observed_plant", F.when(F.col("expected_plant").isNotNull(), F.col("Plant")))


def settings() -> dict:
    """Everything but the inputs that decides a refresh."""
    return {"allocation": config.ALLOCATION_FIELD_BY_PLANT, "safety_stock": config.SAFETY_STOCK_PCT, "uploads": config.UPLOAD_FILE_MAP,
            "headers": config.HEADERS_BY_KIND, "identifiers": config.IDENTIFIER_HEADERS, "dates": config.DATE_HEADERS,
            "numbers": config.NUMERIC_HEADERS, "metrics": quality.RECONCILED_METRICS, "format": 1}


def input_hashes(spark: SparkSession, uploads: str, master: str) -> dict[str, str]:
    """Content hash of every file present and of the product master; a row a file of the upload folder."""
    up = {f"upload:{r['file_name']}": r["content_hash"] for r in blocks.content_hashes(spark, f"{uploads.rstrip('/')}/*").collect()}
    return up | {f"master:{r['file_name']}": r["content_hash"] for r in blocks.content_hashes(spark, master).collect()}


TABLES = ["manifest", "rows", "keys", "metrics", "duplicates", "kinds"]


def compute(spark: SparkSession, uploads: str, master: str, allow_invalid: bool,
            write: Callable[[DataFrame, str], DataFrame]) -> None:
    """Write the tables of a refresh: manifest, tagged rows, key table, metrics, duplicates and the kinds that were loaded."""
    loaded = files.load_folder(spark, uploads)
    manifest = write(loaded["manifest"], "manifest")    # a row an upload; read for several sections
    if not _all_valid(manifest) and not allow_invalid:
        raise UploadsInvalid("not every required upload is valid; see the manifest")
    kinds = [k for k in config.KINDS if k in loaded]
    tagged = tag_sources(*[loaded.get(k) for k in ("customer_orders", "on_hand", "open_orders")])
    rows = write(with_files(spark, tagged), "rows")     # parsed once; read back with column pruning
    target, columns = target_lookup(read_master_csv(spark, master)), _columns(kinds)

    def metrics() -> DataFrame:
        keys = write(onepass.key_table(rows, target), "keys")
        return write(onepass.store(rows, keys, columns, REQUIRED).metrics, "metrics")

    onepass.together(metrics, lambda: write(quality.duplicate_rows(rows, columns), "duplicates"))
    write(spark.createDataFrame([(k,) for k in kinds], "kind string"), "kinds")


REQUIRED = list(config.UPLOAD_FILE_MAP.values())


def _all_valid(manifest: DataFrame) -> bool:
    return bool(manifest.agg(F.bool_and(F.col("status") == loading.STATUS_VALID).alias("ok")).first()["ok"])


def _columns(kinds) -> dict[str, list[str]]:
    return {k: [config.physical_name(h) for h in config.HEADERS_BY_KIND[k]] for k in config.KINDS if k in kinds}


def refresh(spark: SparkSession, uploads: str, master: str, out_dir: str | None = None,
            overrides: str | None = None, allow_invalid: bool = False,
            suppliers=config.SUPPLIERS, cache: str | None = None) -> dict:
    """The whole flow. With ``cache`` the tables are stored under the digest of all inputs and settings: a refresh of unchanged
    inputs reads them instead of parsing, aggregating or checking anything again. Overrides are applied to the result on
    every call and have no part in the key."""
    if cache:
        key = results.key_of(input_hashes(spark, uploads, master), settings() | {"allow_invalid": allow_invalid})
    else:
        cache, key = scratch_path(spark, f"refresh-{uuid.uuid4().hex}"), "only"

    def fresh(write: Callable[[DataFrame, str], DataFrame]) -> list[str]:
        compute(spark, uploads, master, allow_invalid, write)
        return TABLES

    tables = results.stored(spark, cache, key, fresh)
    manifest, duplicates = tables["manifest"], tables["duplicates"]
    kinds = {r["kind"] for r in tables["kinds"].collect()}    # three at most
    stored = onepass.Stored(tables["rows"], tables["keys"], tables["metrics"], _columns(kinds), REQUIRED)
    dashboard = onepass.grid(stored)
    if overrides:
        from stockgrid.streaming.ingest import latest_from_log
        dashboard = apply_overrides(dashboard, latest_from_log(spark, overrides))
    stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")
    result = {"manifest": manifest, "grid": dashboard, "variances": onepass.variances(stored), "all_valid": _all_valid(manifest),
              "stored": stored, "duplicates": duplicates, "report": onepass.report(stored, duplicates),
              "plant_violations": onepass.violations(stored)}
    if out_dir:
        audit = audit_lines(spark, onepass.variances(stored), duplicates, manifest, onepass.unmatched_counts(stored),
                            stored.metrics.selectExpr("no_activity AS n"), stamp)
        result["written"] = export_bundle(out_dir, stored, dashboard, duplicates, manifest, audit, stamp, suppliers)
    return result


def main(argv=None) -> int:
    from stockgrid.session import build_session
    p = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    p.add_argument("--uploads", required=True)
    p.add_argument("--master", required=True)
    p.add_argument("--out")
    p.add_argument("--overrides")
    p.add_argument("--allow-invalid", action="store_true")
    p.add_argument("--cache", help="folder of stored results, addressed by their inputs")
    p.add_argument("--master-url")
    a = p.parse_args(argv)
    spark = build_session(a.master_url)
    res = refresh(spark, a.uploads, a.master, a.out, a.overrides, a.allow_invalid, cache=a.cache)
    print(json.dumps({"all_valid": res["all_valid"], "written": res.get("written", {})}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
