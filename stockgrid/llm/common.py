"""Helpers shared by the operators of this package."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockgrid.session import app_id, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _places(df: DataFrame) -> dict[str, int]:
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    for i, c in enumerate(df.columns):
        at.setdefault(c.lower(), i)
    return at


def position(df: DataFrame, name: str) -> int | None:
    """Place of the named column as ``pick`` finds it; None if there is none."""
    return _places(df).get(name)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact spelling first, so that further columns (also ones that
    differ in case alone) never clash with what an operator adds."""
    at = _places(df)
    plain = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"__c{at[n]}").alias(n) for n in names])


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` with nulls read as empty, plus further named columns."""
    d = pick(small_batches(df), "doc_id", "text", *more)
    return d.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.coalesce("text", F.lit("")))


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Hold this session's Arrow batches to ``rows`` rows and 16 MB, unless it asks for fewer rows: texts are long, and a
    batch of them is what a Python worker holds at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return df


def remainder(modulus: int) -> Column:
    """crc32 of ``doc_id`` as text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared scratch folder and read it back: cuts lineage, columnar, survives
    lost executors. The folder carries the application's id, so a clean-up job can remove it afterwards."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{app_id(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_count(df: DataFrame, least: int = 32) -> int:
    """How many groups to deal work into: as many as the input has splits, so that a group's share stays constant."""
    return max(least, df.rdd.getNumPartitions())


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ordinals(df: DataFrame, by: str, key: Column, order: list[Column], out: str, buckets: int) -> DataFrame:
    """Gapless numbers from 0 within each value of ``by`` without putting a value's rows into one task.

    Rows are dealt to ``buckets`` buckets of ``key`` within ``by``; a window numbers each bucket, and the sizes of the
    buckets before it (a table of at most ``buckets`` rows a value) are added."""
    from pyspark.sql import Window
    dealt = df.withColumn("__b", F.pmod(key, F.lit(buckets)))
    sizes = dealt.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(
        Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col(by).alias("__by"), F.col("__b").alias("__bb"), "__o")
    rank = F.row_number().over(Window.partitionBy(by, "__b").orderBy(*order)) - 1
    numbered = dealt.withColumn("__r", rank)
    return numbered.join(before, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__b") == F.col("__bb"))).withColumn(
        out, (F.col("__o") + F.col("__r")).cast("long")).drop("__b", "__bb", "__by", "__o", "__r")


def give_back() -> None:
    """Return this Python worker's freed memory to the system: Spark keeps workers for later stages, and what each has
    freed but still holds would add up."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batches, chars: int = 8_000_000):
    """Arrow batches cut so that their ``text`` column holds about ``chars`` bytes at most (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc
    give_back()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.cumsum(sizes) // chars
        starts = [0, *(np.flatnonzero(np.diff(cut)) + 1), len(cut)] if len(cut) else [0]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)
    give_back()
