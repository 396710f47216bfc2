"""Append-only tables that are compacted: a snapshot, the batches after it, and a version that says which is which.

    <path>/            batches as partitions, written by dynamic partition overwrite (a replay replaces its own batch)
    <path>_snapshots/  version=<v>/  what all batches up to a point come down to
    <path>_versions/   version=<v>/  one row a stream: the last batch that version <v> holds; written after the snapshot

A version counts from the moment its row is committed; until then, and if the writer fails before, readers use the version
before it. A replayed batch that the snapshot already holds only rewrites a partition that readers skip. Readers therefore
read what the snapshot holds plus the batches after it, however many batches there were. Folders of older versions and
batches are not removed here, since a reader may still be at work on them: ``expired`` names them for a clean-up job.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_VERSION = StructType([StructField("stream", StringType()), StructField("through", LongType()), StructField("version", LongType())])


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet folder, or no rows while nobody has written it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_batch(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Write a batch's partitions in place of what an earlier try of it left."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def current_version(spark: SparkSession, path: str) -> tuple[int, dict[str | None, int]]:
    """The newest version (0: none) and the last batch that it holds of each stream; one row a stream is read."""
    rows = read_or_empty(spark, f"{path.rstrip('/')}_versions", _VERSION)
    newest = rows.agg(F.max("version").alias("v")).first()["v"]
    if newest is None:
        return 0, {}
    return newest, {r["stream"]: r["through"] for r in rows.where(F.col("version") == newest).collect()}


def read(spark: SparkSession, path: str, schema: StructType, batch: str, stream: str | None = None) -> DataFrame:
    """Snapshot rows and the rows of later batches. ``batch`` (and ``stream``, where several number their batches by
    themselves) are the partition columns; skipped batches are pruned."""
    path = path.rstrip("/")
    version, through = current_version(spark, path)
    tail = read_or_empty(spark, path, schema)
    if not version:
        return tail
    for name, last in through.items():
        old = F.col(batch) <= last
        tail = tail.where(~((F.col(stream) == name) & old) if stream else ~old)
    snapshot = spark.read.schema(schema).parquet(f"{path}_snapshots/version={version}")
    return snapshot.unionByName(tail)


def compact(spark: SparkSession, path: str, schema: StructType, batch: str, combine: Callable[[DataFrame], DataFrame],
            stream: str | None = None) -> int:
    """Write ``combine`` of all rows as a new version and return its number; 0 if there is nothing to do.

    The last batch of each stream is fixed before the rows are read, and only rows up to it are taken: a batch that is being
    written meanwhile stays in the tail. One compaction runs at a time."""
    path = path.rstrip("/")
    version, through = current_version(spark, path)
    names = F.col(stream) if stream else F.lit(None).cast("string")
    last = dict(through)
    for r in read_or_empty(spark, path, schema).groupBy(names.alias("s")).agg(F.max(batch).alias("b")).collect():
        if r["b"] > last.get(r["s"], -1):
            last[r["s"]] = r["b"]
    if not last or last == through:
        return 0
    rows = read(spark, path, schema, batch, stream)
    kept = None
    for name, b in last.items():
        mine = (F.col(batch) <= b) & (F.col(stream) == name) if stream else F.col(batch) <= b
        kept = mine if kept is None else kept | mine
    combine(rows.where(kept)).select(*schema.names).write.mode("overwrite").parquet(f"{path}_snapshots/version={version + 1}")
    pointer = spark.createDataFrame([(s, b) for s, b in last.items()], "stream string, through long")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{path}_versions/version={version + 1}")
    return version + 1


def expired(spark: SparkSession, path: str) -> list[str]:
    """Folders that no reader who starts now will read: the snapshots of older versions."""
    version, _ = current_version(spark, path)
    return [f"{path.rstrip('/')}_snapshots/version={v}" for v in range(1, version)]
