"""Loading ERP export files (CSV) as Spark jobs.

* Headers: the first line of every file (``sources.blocks``), split into
  (file, ordinal, name) rows that feed ``header_validation``. Duplicate
  header names survive, which Spark's own header handling would rename.
* Data: every column read as text with the kind's header contract applied
  by position (the header line of each file is skipped), then identifiers,
  dates and quantities are coerced with column expressions.
* Manifest: a content hash per file (a tree over its blocks) joined with
  its row count, expected (kind, plant), load status and error text.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stockgrid import config
from stockgrid.functions import coerce_numeric, coerce_timestamp, normalize_identifier
from stockgrid.operators import loading
from stockgrid.sources import blocks

BLANK_HEADER = "(blank)"


def routing(spark: SparkSession) -> DataFrame:
    """A2: upload file name -> (kind, plant); a fixed 9-row dimension."""
    rows = [(f, k, p) for f, (k, p) in config.UPLOAD_FILE_MAP.items()]
    return spark.createDataFrame(rows, "file_name string, kind string, plant string")


def _csv_name(file_name):
    """Uploads may arrive as .xlsx names converted to .csv: route on stem."""
    return F.regexp_replace(file_name, r"\.[A-Za-z0-9]+$", ".xlsx")


def _split_csv_line(line, sep: str):
    """Fields of one CSV line (RFC 4180 quoting, no embedded newlines):
    split on separators outside quotes, then unquote. No width limit."""
    sep_re = re.escape(sep)
    parts = F.split(line, f'{sep_re}(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda x: F.regexp_replace(
        F.regexp_replace(x, r'^\s*"|"\s*$', ""), '""', '"'))


def header_rows(spark: SparkSession, paths: Sequence[str] | str, sep: str = ",") -> DataFrame:
    """(file_name, ordinal, name) of every file's header line; only the first bytes of a file are read."""
    first = blocks.first_lines(spark, paths).select("file_name", "line")
    # a blank first line means no header (the file is reported unreadable);
    # an empty field inside a header is an unnamed column, kept as "(blank)"
    first = (first.withColumn("line", F.regexp_replace("line", "^\ufeff", ""))  # byte-order mark
             .filter(F.trim(F.col("line")) != ""))
    cells = first.select("file_name", F.posexplode(_split_csv_line(F.col("line"), sep)).alias("pos", "name"))
    name = F.when(F.trim(F.col("name")) == "", F.lit(BLANK_HEADER)).otherwise(F.col("name"))
    return cells.select("file_name", (F.col("pos") + 1).alias("ordinal"), name.alias("name"))


def validate_headers(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    """A4 on real files: each file checked against its kind's contract."""
    hdr = header_rows(spark, paths, sep).withColumn("_route", _csv_name(F.col("file_name")))
    route = routing(spark)
    out = None
    for kind, expected in config.HEADERS_BY_KIND.items():
        files = route.filter(F.col("kind") == kind).select(F.col("file_name").alias("_route"))
        part = hdr.join(F.broadcast(files), "_route").drop("_route")
        res = loading.header_validation(part, expected, file_col="file_name").withColumn("kind", F.lit(kind))
        out = res if out is None else out.unionByName(res)
    return out


def _string_schema(kind: str) -> StructType:
    return StructType([StructField(config.physical_name(h), StringType(), True)
                       for h in config.HEADERS_BY_KIND[kind]])


def typed_columns(kind: str) -> list:
    """A5-A7 per column class of the kind: identifiers normalized, dates
    and quantities coerced (invalid -> null, rows kept), rest as text."""
    ids = {config.physical_name(h) for h in config.IDENTIFIER_HEADERS[kind]}
    dates = {config.physical_name(h) for h in config.DATE_HEADERS[kind]}
    nums = {config.physical_name(h) for h in config.NUMERIC_HEADERS[kind]}
    cols = []
    for field in _string_schema(kind).fields:
        c = field.name
        if c in ids:
            cols.append(normalize_identifier(c).alias(c))
        elif c in dates:
            cols.append(coerce_timestamp(c).alias(c))
        elif c in nums:
            cols.append(coerce_numeric(c).alias(c))
        else:
            cols.append(F.col(c))
    return cols


def read_kind(spark: SparkSession, paths, kind: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """A1 + A5-A7: one kind's files as typed rows, source order and
    duplicates kept, with lineage columns ``_source_file`` / ``_block`` / ``_row_id`` (in this order, the source's) and ``_malformed`` (the row has more or fewer
    fields than its header: the fields that fit are kept). Quotes inside quoted fields are doubled, as
    standard CSV has them; ``multi_line`` allows line ends inside fields, but then a file is read by one task."""
    schema = StructType([*_string_schema(kind).fields, StructField("_corrupt", StringType(), True)])
    raw = (spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt")
           .option("columnPruning", False)  # a pruned parse would not see a row's surplus fields
           .option("header", True).option("sep", sep)
           .option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(paths)
           .withColumn("_source_file", F.col("_metadata.file_name"))
           .withColumn("_block", F.col("_metadata.file_block_start"))
           .withColumn("_row_id", F.monotonically_increasing_id()))
    return raw.select(*typed_columns(kind), "_source_file", "_block", "_row_id", F.col("_corrupt").isNotNull().alias("_malformed"))


def file_rows_of(kind_frame: DataFrame, spark: SparkSession) -> DataFrame:
    """(file_name, kind, expected_plant, observed_plant, malformed) per row, for A8/A9."""
    route = routing(spark).withColumnRenamed("plant", "expected_plant")
    rows = kind_frame.select(F.col("_source_file").alias("_f"), F.col("Plant").alias("observed_plant"),
                              F.col("_malformed").alias("malformed"))
    return rows.join(F.broadcast(route), _csv_name(F.col("_f")) == route.file_name).select(
        "file_name", "kind", "expected_plant", "observed_plant", "malformed")


def manifest(spark: SparkSession, paths, frames: dict[str, DataFrame], headers: DataFrame) -> DataFrame:
    """A3 + A9: per required upload: content hash, bytes, rows, header
    result, plant violations, malformed rows, status (Missing / Error / Valid) and the error's text. A file
    with content but no header line is 'unreadable' (Error); Spark lists no
    empty files, so an empty upload is Missing."""
    found = blocks.content_hashes(spark, paths).select(
        _csv_name(F.col("file_name")).alias("file_name"), F.col("length").alias("bytes"), "content_hash")
    rows = None
    for kind, df in frames.items():
        fr = file_rows_of(df, spark)
        rows = fr if rows is None else rows.unionByName(fr)
    hdr = headers.select(_csv_name(F.col("file_name")).alias("file_name"), "result", "message")
    out = routing(spark).join(found, "file_name", "left").join(hdr, "file_name", "left")
    if rows is not None:
        # one row a plant value first: values are free text, and a file may hold many rows of each
        values = rows.groupBy("file_name", "expected_plant", "observed_plant").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("malformed").alias("m"))
        other = F.col("observed_plant").isNotNull() & (F.col("observed_plant") != F.col("expected_plant"))
        out = out.join(values.groupBy("file_name").agg(
            F.sum("n").alias("row_count"), F.sum("m").alias("malformed_rows"),
            F.array_sort(F.collect_list(F.when(other, F.col("observed_plant")))).alias("_wrong")), "file_name", "left")
    else:
        out = out.selectExpr("*", "CAST(NULL AS BIGINT) AS row_count", "CAST(NULL AS BIGINT) AS malformed_rows",
                             "CAST(NULL AS ARRAY<STRING>) AS _wrong")
    absent = F.col("content_hash").isNull()
    header = F.coalesce(F.col("result"), F.lit("unreadable"))
    error = (F.when(absent, F.lit(None).cast("string"))
             .when(header == "unreadable", F.lit(loading.ERROR_UNREADABLE))
             .when(header != "ok", F.col("message"))
             .when(F.size("_wrong") > 0, F.concat(F.lit(loading.ERROR_PLANT_HEAD + "'"), F.array_join("_wrong", "', '"),
                                                  F.lit("'" + loading.ERROR_PLANT_TAIL), F.col("plant"), F.lit(".")))
             .when(F.col("malformed_rows") > 0, F.concat(F.col("malformed_rows").cast("string"), F.lit(loading.ERROR_MALFORMED))))
    status = (F.when(absent, F.lit(loading.STATUS_MISSING)).when(F.col("error").isNotNull(), F.lit(loading.STATUS_ERROR))
              .otherwise(F.lit(loading.STATUS_VALID)))
    return out.withColumn("error", error).select(
        "file_name", "kind", "plant", "content_hash", "bytes", F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"),
        F.when(absent, F.lit("")).otherwise(header).alias("header_result"),
        F.coalesce(F.array_join("_wrong", ","), F.lit("")).alias("violations"),
        F.coalesce("malformed_rows", F.lit(0).cast("long")).alias("malformed_rows"), status.alias("status"), "error")


def plant_violations(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """A8 over loaded files: (file_name, kind, expected_plant, observed_plant, n_rows)."""
    rows = None
    for df in frames.values():
        fr = file_rows_of(df, spark)
        rows = fr if rows is None else rows.unionByName(fr)
    if rows is None:
        return spark.createDataFrame([], "file_name string, kind string, expected_plant string, observed_plant string, n_rows long")
    return loading.violation_rows(rows, ["file_name", "kind", "expected_plant"])


def load_folder(spark: SparkSession, folder: str, sep: str = ",") -> dict[str, DataFrame]:
    """Load a folder of uploads: header check, typed kinds (valid headers
    only), manifest. Returns ``headers``, ``manifest`` and one frame per kind."""
    paths = f"{folder.rstrip('/')}/*"
    headers = validate_headers(spark, paths, sep).cache()
    ok = {r["file_name"] for r in headers.filter(F.col("result") == "ok").select("file_name").collect()}
    route = config.UPLOAD_FILE_MAP
    frames = {}
    for kind in config.KINDS:
        files = [f"{folder.rstrip('/')}/{f}" for f in sorted(ok)
                 if route.get(_stem_xlsx(f), ("", ""))[0] == kind]
        if files:
            frames[kind] = read_kind(spark, files, kind, sep)
    out = {"headers": headers, "manifest": manifest(spark, paths, frames, headers)}
    out.update(frames)
    return out


def _stem_xlsx(name: str) -> str:
    return name.rsplit(".", 1)[0] + ".xlsx"


def inspect_exports(spark: SparkSession, folder: str, sep: str = ",") -> DataFrame:
    """Every file present: its kind and header result (``unrouted`` and null where the name belongs to no upload), the
    header's message, data rows and the sorted distinct plant values. Rows are counted by record whatever the header says;
    plants are read from the column named ``Plant``, wherever it stands, and null without one."""
    paths = f"{folder.rstrip('/')}/*"
    files = blocks.listed(spark, paths).select("file_name").withColumn("_route", _csv_name(F.col("file_name")))
    checked = validate_headers(spark, paths, sep).select("file_name", "result", "message", "missing_columns", "extra_columns")
    at = header_rows(spark, paths, sep).where("name = 'Plant'").groupBy("file_name").agg(F.min("ordinal").alias("_at"))
    # all files as lines of one text column: records without line ends inside fields, as read_kind has them
    lines = spark.read.text(paths).select("value", blocks.plain(F.col("_metadata.file_name")).alias("file_name"))
    first = blocks.first_lines(spark, paths).select("file_name", F.col("line").alias("_first"))
    fields = _split_csv_line(F.col("value"), sep)
    plant = normalize_identifier(F.get(fields, F.col("_at") - 1))
    rows = lines.where(F.trim("value") != "").join(at, "file_name", "left").select("file_name", plant.alias("plant"))
    values = rows.groupBy("file_name", "plant").agg(F.count(F.lit(1)).alias("n"))
    per_file = values.join(first, "file_name", "left").groupBy("file_name").agg(
        (F.sum("n") - F.max(F.when(F.trim("_first") != "", 1).otherwise(0))).alias("row_count"),
        F.array_sort(F.collect_set("plant")).alias("_plants")).join(at, "file_name", "left")
    # the header line itself carries the name of the column
    plants = F.when(F.col("_at").isNotNull(), F.array_join(F.array_remove("_plants", "Plant"), ","))
    route = routing(spark).select(F.col("file_name").alias("_route"), "kind")
    return (files.join(route, "_route", "left").join(checked, "file_name", "left").join(
        per_file.select("file_name", "row_count", plants.alias("plants")), "file_name", "left").select(
        "file_name", "kind", F.when(F.col("kind").isNull(), F.lit("unrouted")).otherwise(
            F.coalesce("result", F.lit("unreadable"))).alias("result"), "message", "missing_columns", "extra_columns",
        F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"), F.coalesce("plants", F.lit("")).alias("plants")))
