"""Reading parts of files: first lines and content hashes without a row that holds a whole file.

Spark lists the files (``binaryFile`` with its content column pruned; it leaves out empty files) and deals paths or byte
ranges to tasks, and a task reads its range through Arrow's file systems. Paths of a scheme that Arrow doesn't know (``viewfs`` for one) are read by
Spark's own sources: the text source for first lines, ``binaryFile`` rows for hashes, which then is bounded by the size of a
file.

The content hash is a tree: SHA-256 of every block of ``BLOCK`` bytes, then of the hashes of each ``FAN`` blocks in order,
then of those nodes in order with the file's length. It depends on the bytes alone, not on how blocks were dealt to tasks, and
no step holds more than a block, or the hashes of one node or file (64 bytes for each 4 GiB of a file).
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4 << 20
FAN = 1024
CHUNK = 1 << 16
# Schemes of Arrow's file systems; a path without a scheme is in Spark's default file system
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def plain(c) -> F.Column:
    """A file name or path of ``_metadata``, which percent-encodes it, as ``listed`` has it."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def listed(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(path, file_name, length) of files, found by Spark; no content is read. The name is percent-decoded, the path too."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").cast("long").alias("length"))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


def _open(path: str):
    """(file system, path in it) of a listed file."""
    from pyarrow import fs
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if colon and scheme == "s3a":
        path = "s3:" + rest
    return fs.FileSystem.from_uri(path)


def readable() -> F.Column:
    """Whether tasks can read a listed path through Arrow."""
    return F.regexp_extract("path", "^([a-z0-9]+):", 1).isin(*SCHEMES)


def first_line(path: str) -> tuple[str | None, int]:
    """The bytes up to the first line end as text (null: an empty file), and how many bytes were read for it."""
    system, name = _open(path)
    found, size = b"", 0
    with system.open_input_stream(name) as stream:    # decompresses by extension, as Spark's text source does
        while True:
            chunk = stream.read(CHUNK)
            size += len(chunk)
            found += chunk
            ends = [at for at in (found.find(b"\n"), found.find(b"\r")) if at >= 0]
            if ends:
                return found[:min(ends)].decode("utf-8", "replace"), size
            if not chunk:
                return (found.decode("utf-8", "replace") if found else None), size


def _first_lines(batches: Iterable):
    import pyarrow as pa
    for batch in batches:
        lines = [first_line(p) for p in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file_name"), pa.array([x for x, _ in lines], pa.string()),
                                          pa.array([n for _, n in lines], pa.int64())], names=["file_name", "line", "bytes_read"])


def first_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(file_name, line, bytes_read) of every file: reading stops at the first line end (a chunk of 64 KB at a time), so it
    does not grow with the files. ``bytes_read`` is null where Spark's text source read."""
    files = listed(spark, paths)
    near = files.where(readable()).select("path", "file_name").mapInArrow(
        _first_lines, "file_name string, line string, bytes_read long")
    far = files.where(~readable()).select("path", "file_name")
    if far.isEmpty():
        return near
    text = spark.read.text(paths).select(
        "value", plain(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("_block"))
    scanned = text.where("_block = 0").withColumn("_id", F.monotonically_increasing_id()).groupBy("path").agg(
        F.min_by("value", "_id").alias("line"))
    return near.unionByName(far.join(scanned, "path", "left").select("file_name", "line", F.lit(None).cast("long").alias("bytes_read")))


def _leaves(batches: Iterable):
    import pyarrow as pa
    for batch in batches:
        for path, first, n in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "n"))):
            system, name = _open(path)
            with system.open_input_file(name) as f:
                leaves = [hashlib.sha256(f.read_at(BLOCK, (first + i) * BLOCK)).hexdigest() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(first, first + n), pa.int64()), pa.array(leaves)],
                                             names=["path", "block", "leaf"])


def content_hashes(spark: SparkSession, paths: Sequence[str] | str, blocks_a_range: int = 16) -> DataFrame:
    """(path, file_name, length, content_hash): the root of each file's hash tree. ``blocks_a_range`` consecutive blocks are one
    unit of work, dealt over the tasks; it has no part in the result."""
    files = listed(spark, paths)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("length") / F.lit(BLOCK))).cast("long")
    ranges = files.where(readable()).withColumn("_blocks", blocks).select(
        "path", "_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1, F.lit(blocks_a_range).cast("long"))).alias("first"))
    ranges = ranges.withColumn("n", F.least(F.lit(blocks_a_range), F.col("_blocks") - F.col("first")).cast("int"))
    leaves = ranges.repartition("path", "first").select("path", "first", "n").mapInArrow(_leaves, "path string, block long, leaf string")
    far = files.where(~readable())
    if not far.isEmpty():
        names = spark.read.format("binaryFile").load(paths).where(~readable())
        at = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("length") / F.lit(BLOCK)) - 1).cast("long"))
        cut = names.select("path", "content", F.explode(at).alias("block")).select(
            "path", "block", F.sha2(F.expr(f"substring(content, cast(block * {BLOCK} + 1 as int), {BLOCK})"), 256).alias("leaf"))
        leaves = leaves.unionByName(cut)

    def joined(number: str, value: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, value))), lambda x: x[value]), "")

    nodes = leaves.groupBy("path", F.floor(F.col("block") / FAN).alias("node")).agg(F.sha2(joined("block", "leaf"), 256).alias("hash"))
    roots = nodes.groupBy("path").agg(joined("node", "hash").alias("nodes"))
    return files.join(roots, "path").select(
        "path", "file_name", "length", F.sha2(F.concat(F.col("length").cast("string"), F.lit(":"), F.col("nodes")), 256).alias("content_hash"))


def tree_hash(data: bytes) -> str:
    """The root for bytes in memory (small files, tests)."""
    sha = hashlib.sha256
    leaves = [sha(data[i:i + BLOCK]).hexdigest() for i in range(0, max(1, len(data)), BLOCK)]
    nodes = [sha("".join(leaves[i:i + FAN]).encode()).hexdigest() for i in range(0, len(leaves), FAN)]
    return sha(f"{len(data)}:{''.join(nodes)}".encode()).hexdigest()
