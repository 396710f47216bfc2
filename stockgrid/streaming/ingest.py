"""Structured Streaming re-aims of the upload refresh and the override map.

N1 ``ingest_drop_folder``: files landing in a folder are read once each
(the file source's checkpointed log replaces the content-hash cache),
coerced to the kind's types and appended to a Parquet table partitioned by
plant; ``trigger(availableNow=True)`` drains what is there and stops, so a
scheduler can run it like a batch job. The grid is then a batch job over
the table.

N2 ``stream_overrides``: planner edits arrive as an append-only event
stream; a stateful streaming aggregation keeps the latest edit per
(Plant, Material) (by ts, then event_id) in the state store, and each
micro-batch's changed keys are appended with their batch id. Readers take
the newest row per key (``latest_from_log``), so replays of a batch are
idempotent.
"""
from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

from stockgrid.sources import files, snapshots

OVERRIDE_EVENT_SCHEMA = StructType([
    StructField("event_id", LongType()), StructField("ts", TimestampNTZType()),
    StructField("Plant", StringType()), StructField("Material", StringType()),
    StructField("Manual_Override", DoubleType()), StructField("Planner_Note", StringType()),
])


def _batch_paths(spark: SparkSession, checkpoint: str, batch_id: int) -> list[str]:
    """The files of one micro-batch, with those that hold no rows, from the file source's own log: entries after the
    offset of the batch before, up to this batch's. At most ``maxFilesPerTrigger``."""
    def lines(path: str) -> list[str]:
        return [r["value"] for r in spark.read.text(path).collect()]

    def offset(n: int) -> int:
        found = [json.loads(x) for x in lines(f"{checkpoint}/offsets/{n}") if x.startswith("{")]
        return next(int(x["logOffset"]) for x in found if "logOffset" in x)

    checkpoint = checkpoint.rstrip("/")
    first = offset(batch_id - 1) + 1 if batch_id else 0
    out = []
    for n in range(first, offset(batch_id) + 1):
        log = spark.read.text(f"{checkpoint}/sources/0/{{{n},{n}.compact}}").where(F.col("value").startswith("{"))
        entry = F.from_json("value", "path string, batchId long")
        out += [r["path"] for r in log.select(entry.alias("e")).where(F.col("e.batchId") == n)
                .select("e.path").distinct().collect()]
    return sorted(set(out))


def ingest_drop_folder(spark: SparkSession, folder: str, kind: str, table_path: str,
                       checkpoint: str, sep: str = ",", max_files_per_trigger: int = 64,
                       states_path: str | None = None) -> int:
    """Drain new files of one kind into ``table_path``; returns the
    number of micro-batches run.

    Each micro-batch checks the header of its own files (at most
    ``max_files_per_trigger``) against the kind's contract, appends rows of
    the files that pass and have no malformed row (more or fewer fields than
    the header), and records every file, also one without rows, with its header
    result, row count and malformed rows in ``<table_path>_manifest``. Both writes overwrite only the
    batch's own partition, so a replayed batch is idempotent. With ``states_path`` the batch's key states are stored the
    same way, from which ``operators.incremental`` merges the grid.
    """
    from stockgrid import config
    from stockgrid.operators.incremental import write_states
    from stockgrid.operators.loading import header_validation
    schema = StructType([*files._string_schema(kind).fields, StructField("_corrupt", StringType(), True)])
    stream = (spark.readStream.schema(schema).option("header", True).option("sep", sep).option("escape", '"')
              .option("columnNameOfCorruptRecord", "_corrupt")
              .option("columnPruning", False)  # as in files.read_kind: a pruned parse would not see surplus fields
              .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder)
              .withColumn("_source_file", F.col("_metadata.file_name")))
    typed = stream.select(*files.typed_columns(kind), "_source_file",
                          F.col("_corrupt").isNotNull().alias("_malformed"))
    batches = []

    def sink(batch: DataFrame, batch_id: int) -> None:
        # the batch's file list is bounded by maxFilesPerTrigger
        paths = _batch_paths(spark, checkpoint, batch_id)  # percent-encoded, as names in _metadata are
        if not paths:
            return
        names = [p.rsplit("/", 1)[-1] for p in paths]
        listed = spark.createDataFrame([(n, unquote(n)) for n in names], "_source_file string, file_name string")
        checked = header_validation(files.header_rows(spark, [unquote(p) for p in paths], sep), config.HEADERS_BY_KIND[kind],
                                    file_col="file_name").select("file_name", "result")
        counts = batch.groupBy("_source_file").agg(F.count(F.lit(1)).alias("row_count"),
                                                   F.count_if("_malformed").alias("malformed_rows"))
        none = F.lit(0).cast("long")
        per_file = listed.join(checked, "file_name", "left").join(counts, "_source_file", "left").select(
            "_source_file", F.coalesce("result", F.lit("unreadable")).alias("header_result"),
            F.coalesce("row_count", none).alias("row_count"), F.coalesce("malformed_rows", none).alias("malformed_rows"))
        whole = per_file.filter("header_result = 'ok' and malformed_rows = 0").select("_source_file")
        good = batch.join(F.broadcast(whole), "_source_file", "left_semi").drop("_malformed")
        if states_path is not None:
            write_states(good, kind, batch_id, states_path)
        (good.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", "Plant").parquet(table_path))
        (per_file.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(table_path.rstrip("/") + "_manifest"))
        batches.append(batch_id)

    q = (typed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(batches)


def latest_per_key(events: DataFrame) -> DataFrame:
    """Latest edit per key as a (streaming or batch) aggregation."""
    best = events.groupBy("Plant", "Material").agg(
        F.max(F.struct("ts", "event_id", "Manual_Override", "Planner_Note")).alias("w"))
    return best.select("Plant", "Material", F.col("w.ts").alias("ts"), F.col("w.event_id").alias("event_id"),
                       F.col("w.Manual_Override").alias("Manual_Override"),
                       F.col("w.Planner_Note").alias("Planner_Note"))


def stream_overrides(spark: SparkSession, source_dir: str, log_path: str, checkpoint: str,
                     source_format: str = "parquet") -> int:
    """Fold override events into the latest-per-key log."""
    events = spark.readStream.schema(OVERRIDE_EVENT_SCHEMA).format(source_format).load(source_dir)
    latest = latest_per_key(events)
    batches = []

    def sink(batch: DataFrame, batch_id: int) -> None:
        # replays of a batch rewrite the same _batch partition (idempotent)
        (batch.withColumn("_batch", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_batch").parquet(log_path))
        batches.append(batch_id)

    q = (latest.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return len(batches)


LOG_SCHEMA = StructType([
    StructField("Plant", StringType()), StructField("Material", StringType()),
    StructField("ts", TimestampNTZType()), StructField("event_id", LongType()),
    StructField("Manual_Override", DoubleType()), StructField("Planner_Note", StringType()),
    StructField("_batch", LongType()),
])


def _newest(log: DataFrame) -> DataFrame:
    """The newest logged row of each key: a batch's row already is the latest edit by (ts, event_id) of all events up to it,
    so late events change nothing that a later batch has not seen."""
    best = log.groupBy("Plant", "Material").agg(
        F.max(F.struct("_batch", "ts", "event_id", "Manual_Override", "Planner_Note")).alias("w"))
    return best.select("Plant", "Material", "w.*")


def latest_from_log(spark: SparkSession, log_path: str) -> DataFrame:
    """Current override table: newest logged row per key, from the log's snapshot and the batches after it."""
    log = snapshots.read(spark, log_path, LOG_SCHEMA, "_batch")
    return _newest(log).select("Plant", "Material", "Manual_Override", "Planner_Note")


def compact_overrides(spark: SparkSession, log_path: str) -> int:
    """Reduce the log to its newest row per key as a new snapshot, so that reading costs keys, not batches; returns the
    snapshot's version (0: nothing new). The stream may go on meanwhile and may replay batches that the snapshot holds."""
    return snapshots.compact(spark, log_path, LOG_SCHEMA, "_batch", _newest)


def kind_table_schema(spark: SparkSession, kind: str) -> StructType:
    """Schema of an ingested kind table (typed columns + ``_source_file``)."""
    empty = spark.createDataFrame([], files._string_schema(kind))
    return empty.select(*files.typed_columns(kind), F.lit(None).cast("string").alias("_source_file"),
                        F.lit(None).cast("long").alias("batch_id")).schema


def read_kind_table(spark: SparkSession, table_path: str, kind: str) -> DataFrame:
    """Read an ingested table with its declared schema, so the ``Plant``
    partition values stay text (partition discovery would make them ints
    and drop leading zeros)."""
    return spark.read.schema(kind_table_schema(spark, kind)).parquet(table_path)
