"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts form an indivisible group. Groups, largest first, enter the open shard whose remaining capacity is
the tightest that fits, found in a balanced tree of remaining capacities; if none fits, a shard is opened.

Scale: the driver never sees groups, only a histogram of group sizes. Equal sizes are interchangeable, so a whole size
class enters shard after shard at once. Sizes of 4,096 and more are rounded up to 12 significant bits, so there are fewer
than 4,096 + 2,048 x 52 classes whatever the data, shards never exceed their capacity, and their true sizes are at most
1/2,048 below the counted ones. Groups are numbered inside their class by distributed ordinals; rows take their group's
shard in one join (a text held by many rows is split by AQE), slots are distributed ordinals again.

``fixed_capacity`` opens as few shards as best-fit-decreasing needs for the counted sizes; groups find their shard in an
interval join of their number with the runs of their class. ``balanced`` finds the least capacity at which a
given number of shards suffices, which makes their sizes near equal (law ``bytes``); a group larger than an equal share
gets a shard of its own first.

Null text: size 1, a group with the empty text. Null and repeated ids: rows like others. Empty table: no rows. Reruns
agree up to the numbering among fully equal rows. Other columns are never read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockgrid.llm.common import documents, ordinals, split_count, stored

Classes = list[tuple[int, int]]            # (size, number of groups), largest first
Runs = list[tuple[int, int, int]]          # (size, shard, number of groups), in order of placement


class Capacities:
    """A balanced search tree (treap with hashed priorities) of (remaining capacity, shard)."""

    def __init__(self) -> None:
        self.root: list | None = None      # [key, priority, left, right]

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, hash((key[1], 0x9E3779B9)), None, None]), high)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the tightest shard with ``least`` or more left."""
        node, best = self.root, None
        while node:
            if node[0] >= (least, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            low, high = self._split(self.root, best)
            _, high = self._split(high, (best[0], best[1] + 1))
            self.root = self._join(low, high)
        return best

    def _split(self, node: list | None, key: tuple[int, int]):
        """Trees of the keys below ``key`` and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _join(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return [low[0], low[1], low[2], self._join(low[3], high)]
        return [high[0], high[1], self._join(low, high[2]), high[3]]


def best_fit_decreasing(classes: Classes, capacity: int, most: int | None = None) -> tuple[Runs, int] | None:
    """Placement of size classes and the number of shards; None if it would take more than ``most``. A group above the
    capacity has a shard to itself."""
    free, runs, shards = Capacities(), [], 0
    for size, n in classes:
        while n:
            found = free.take(size)
            if found is None:
                if most is not None and shards == most:
                    return None
                found = (max(capacity, size), shards)
                shards += 1
            left, shard = found
            some = min(n, left // size)
            n -= some
            runs.append((size, shard, some))
            if left > some * size:
                free.add((left - some * size, shard))
    return runs, shards


def balanced_runs(classes: Classes, shards: int) -> Runs:
    """Best-fit-decreasing at the least capacity found at which ``shards`` shards suffice."""
    first: Runs = []
    rest, total = list(classes), sum(s * n for s, n in classes)
    while rest and len(first) < shards - 1 and rest[0][0] * (shards - len(first)) > total:
        size, n = rest[0]
        first.append((size, len(first), 1))
        total -= size
        rest = ([(size, n - 1)] if n > 1 else []) + rest[1:]
    if not rest:
        return first
    k = shards - len(first)
    low = max(rest[0][0], -(-total // k))
    high = low + rest[0][0]
    while (best := best_fit_decreasing(rest, high, k)) is None:
        high = 2 * high
    while low < high:
        middle = (low + high) // 2
        if (found := best_fit_decreasing(rest, middle, k)) is None:
            low = middle + 1
        else:
            best, high = found, middle
        if high - low <= total // k // 100_000:
            break
    return first + [(s, b + len(first), n) for s, b, n in best[0]]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.encode("text", "UTF-8")
    return stored(documents(docs).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash")), "shard-rows")


def _rounded(weight: str) -> Column:
    return F.expr(f"case when {weight} < 4096 then {weight} else shiftleft(shiftright({weight} + "
                  f"shiftleft(1L, length(bin({weight})) - 12) - 1, length(bin({weight})) - 12), length(bin({weight})) - 12) end")


def _in_runs(numbered: DataFrame, runs: Runs) -> DataFrame:
    """Rows of ``class`` and ``number`` with the ``shard`` of the run that holds the number: an interval join on cells. A
    class of ``n`` groups in ``r`` runs has cells of ``n / 64 r`` numbers, so runs touch at most 129 r cells in all, and
    the comparisons grow with groups and runs, not with their product."""
    ends: dict[int, int] = {}
    count: dict[int, int] = {}
    spans = []
    for size, shard, n in runs:
        first = ends.get(size, 0)
        ends[size], count[size] = first + n, count.get(size, 0) + 1
        spans.append((size, first, first + n, shard))
    session = numbered.sparkSession
    cells = session.createDataFrame([(c, max(1, n // (64 * count[c]))) for c, n in ends.items()], "c long, cell long")
    cells = F.broadcast(cells)  # a row a class, at most 111 thousand
    known = session.createDataFrame(spans, "k long, first long, stop long, shard int")
    known = known.join(cells, F.col("k") == F.col("c")).withColumn("at", F.explode(F.expr(
        "sequence(first div cell, (stop - 1) div cell)"))).select("k", "at", "first", "stop", "shard")
    placed = numbered.join(cells, F.col("class") == F.col("c")).withColumn("at_", F.expr("number div cell"))
    inside = (F.col("first") <= F.col("number")) & (F.col("number") < F.col("stop"))
    return placed.join(known, (F.col("class") == F.col("k")) & (F.col("at_") == F.col("at")) & inside).drop(
        "k", "at", "first", "stop", "at_", "c", "cell")


def _placed(rows: DataFrame, place) -> DataFrame:
    """``rows`` with ``shard``: ``place`` turns the histogram of group sizes into runs."""
    buckets = split_count(rows)
    groups = rows.groupBy("text_hash", "text_crc32", "size").agg((F.count("*") * F.col("size")).alias("weight"))
    groups = stored(groups.withColumn("class", _rounded("weight")), "shard-groups")
    histogram = groups.groupBy("class").agg(F.count("*").alias("n")).collect()  # at most 111 thousand classes
    runs = place(sorted(((r["class"], r["n"]) for r in histogram), reverse=True))
    numbered = ordinals(groups, "class", F.col("text_hash"), [F.col("text_hash"), F.col("text_crc32")], "number", buckets)
    sharded = _in_runs(numbered, runs).select(F.col("text_hash").alias("h"), F.col("text_crc32").alias("crc"),
                                              F.col("size").alias("s"), "shard")
    sharded = stored(sharded, "shard-of-group")
    return rows.join(sharded, (F.col("text_hash") == F.col("h")) & (F.col("text_crc32") == F.col("crc")) & (
        F.col("size") == F.col("s"))).drop("h", "crc", "s")


def _slots(placed: DataFrame) -> DataFrame:
    placed = stored(placed, "shard-placed")
    return ordinals(placed, "shard", F.xxhash64("doc_id", "text_hash"), [F.col("doc_id"), F.col("text_hash")], "slot",
                    split_count(placed, 64))


def fixed_capacity(docs: DataFrame, capacity: int) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``: as few shards of ``capacity`` bytes as
    best-fit-decreasing needs for the counted sizes, which are at most 1/2,048 above the true ones (exact below 4,096)."""
    out = _slots(_placed(_rows(docs), lambda classes: best_fit_decreasing(classes, capacity)[0]))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


def balanced(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The same columns for a given number of shards of near equal size."""
    out = _slots(_placed(_rows(docs), lambda classes: balanced_runs(classes, shards)))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


def sharding(docs: DataFrame) -> DataFrame:
    """Contract query: law ``bytes`` over 16 shards."""
    return balanced(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                 F.lit(None).cast("int").alias("grown_shard"))
