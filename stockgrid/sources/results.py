"""Stored results addressed by what they were made from.

    <cache>/entries/key=<hex>/    one row: the folder of the result; written last
    <cache>/results/<id>/<name>/  the tables of one result

The key is a digest of the inputs' content hashes and of every setting that has a part in the result, so a changed byte or
setting has another key, and an entry is never out of date. A result counts from the moment its entry is committed. Two
writers of one key write two folders, and either serves.
"""
from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stockgrid.sources.snapshots import read_or_empty

_ENTRY = StructType([StructField("folder", StringType()), StructField("names", StringType()), StructField("key", StringType())])


def key_of(inputs: Mapping[str, str], settings: Mapping[str, object]) -> str:
    """Digest of content hashes by input name and of the settings (anything JSON can say)."""
    return hashlib.sha256(json.dumps([dict(inputs), dict(settings)], sort_keys=True, default=list).encode()).hexdigest()


def found(spark: SparkSession, cache: str, key: str) -> dict[str, DataFrame] | None:
    """The tables of a stored result, or None."""
    row = read_or_empty(spark, f"{cache.rstrip('/')}/entries", _ENTRY).where(F.col("key") == key).first()
    if row is None:
        return None
    return {n: spark.read.parquet(f"{row['folder']}/{n}") for n in json.loads(row["names"])}


def stored(spark: SparkSession, cache: str, key: str,
           compute: Callable[[Callable[[DataFrame, str], DataFrame]], Sequence[str]]) -> dict[str, DataFrame]:
    """The result under ``key``. If nobody has entered it, ``compute`` gets a function that writes a table under a name and
    reads it back, and returns the names of the result's tables; the entry follows when all are written."""
    have = found(spark, cache, key)
    if have is not None:
        return have
    folder = f"{cache.rstrip('/')}/results/{uuid.uuid4().hex}"

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    names = list(compute(write))
    entry = spark.createDataFrame([(folder, json.dumps(names))], "folder string, names string")
    entry.coalesce(1).write.mode("overwrite").parquet(f"{cache.rstrip('/')}/entries/key={key}")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
