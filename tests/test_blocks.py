"""First lines and content hashes read parts of files; results don't depend on how the parts are dealt."""
from __future__ import annotations

import gzip
import hashlib
import os

import pytest

from stockgrid.sources import blocks, files


def put(folder, name, data):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def test_root_is_the_same_however_a_file_is_dealt(spark, tmp_dir):
    sizes = {"none": 0, "one": 1, "exact": blocks.BLOCK, "more": blocks.BLOCK + 1, "long name.bin": 3 * blocks.BLOCK + 77}
    data = {n: (hashlib.sha256(n.encode()).digest() * (size // 32 + 1))[:size] for n, size in sizes.items()}
    for n, d in data.items():
        put(tmp_dir, n, d)
    want = {n: (len(d), blocks.tree_hash(d)) for n, d in data.items() if d}    # Spark lists no empty files
    for dealt in (1, 2, 16):
        got = {r.file_name: (r.length, r.content_hash) for r in blocks.content_hashes(spark, tmp_dir, dealt).collect()}
        assert got == want
    swapped = bytearray(data["long name.bin"])
    swapped[blocks.BLOCK + 5] ^= 1
    assert blocks.tree_hash(bytes(swapped)) != want["long name.bin"][1]


def test_tree_of_many_nodes(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    monkeypatch.setattr(blocks, "FAN", 3)
    data = bytes(range(50))
    leaves = [hashlib.sha256(data[i:i + 4]).hexdigest() for i in range(0, 50, 4)]
    nodes = [hashlib.sha256("".join(leaves[i:i + 3]).encode()).hexdigest() for i in range(0, 13, 3)]
    assert len(nodes) == 5 and blocks.tree_hash(data) == hashlib.sha256(("50:" + "".join(nodes)).encode()).hexdigest()


@pytest.fixture
def spark_only(monkeypatch):
    monkeypatch.setattr(blocks, "SCHEMES", ("nothing",))


def first_lines(spark, folder):
    return {r.file_name: r.line for r in blocks.first_lines(spark, folder).collect()}


LINES = {"a.csv": b"x,y\n1,2\n", "crlf.csv": b"x,y\r\n1,2\r\n", "cr.csv": b"x;y\r1;2", "open.csv": b"only header", "blank.csv": b"\n\n1",
         "bom.csv": "\ufeffä,ö\n".encode(), "with blank.csv": b"p,q\n"}
WANT = {"a.csv": "x,y", "crlf.csv": "x,y", "cr.csv": "x;y", "open.csv": "only header", "blank.csv": "", "bom.csv": "\ufeffä,ö",
        "with blank.csv": "p,q"}


def test_first_lines(spark, tmp_dir):
    for n, d in LINES.items():
        put(tmp_dir, n, d)
    put(tmp_dir, "empty.csv", b"")
    put(tmp_dir, "zipped.csv.gz", gzip.compress(b"g,h\n" + b"1,2\n" * 100000))
    assert first_lines(spark, tmp_dir) == WANT | {"zipped.csv.gz": "g,h"}    # Spark lists no empty files


def test_bytes_read_do_not_grow_with_files(spark, tmp_dir):
    put(tmp_dir, "small.csv", b"a,b\n1,2\n")
    put(tmp_dir, "large.csv", b"a,b\n" + b"1,2\n" * 5_000_000)
    put(tmp_dir, "wide.csv", b",".join(b"column %d" % i for i in range(20000)) + b"\n" + b"x\n" * 1_000_000)
    read = {r.file_name: r.bytes_read for r in blocks.first_lines(spark, tmp_dir).collect()}
    assert read["small.csv"] == 8 and read["large.csv"] == blocks.CHUNK and read["wide.csv"] < 5 * blocks.CHUNK
    assert files.header_rows(spark, f"{tmp_dir}/wide.csv").count() == 20000


def test_paths_that_only_spark_reads(spark, tmp_dir, spark_only):
    names = {n: d for n, d in LINES.items() if n not in ("with blank.csv", "bom.csv")}
    for n, d in names.items():
        put(tmp_dir, n, d)
    put(tmp_dir, "big.bin", os.urandom(blocks.BLOCK + 9))
    got = blocks.first_lines(spark, f"{tmp_dir}/*.csv")
    assert {r.file_name: r.line for r in got.collect()} == {n: WANT[n] for n in names}
    assert {r.bytes_read for r in got.collect()} == {None}
    with open(os.path.join(tmp_dir, "big.bin"), "rb") as f:
        data = f.read()
    hashes = {r.file_name: r.content_hash for r in blocks.content_hashes(spark, tmp_dir).collect()}
    assert hashes["big.bin"] == blocks.tree_hash(data) and hashes["a.csv"] == blocks.tree_hash(LINES["a.csv"])
