"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

* Targets: sources by code point (null last) weigh ``weights`` repeating and share ``share`` times all words; a target
  stops at ``most`` times its source's words and the excess is reshared by weight among the others.
* Blocks: a source's documents are dealt to blocks of about ``block_words`` words by hash; the order of the blocks and of
  the documents in a block is a hash order too, another one in each pass over the source. A pass takes blocks in order
  until the pass's share of the target is met; the block at the border gives its first documents only, so a source's
  taken words come within one document of its target.
* Tree: each source's exact number of taken blocks is its quota. Every node of a binary tree over the output shards
  splits its vector of quotas by a multivariate-hypergeometric draw, seeded by the node, into halves in proportion to
  their shards; the leaves say how many blocks of each source a shard gets. Blocks are then dealt in permuted order, so
  shards hold disjoint blocks, and documents are shuffled inside the shard by a random key.

Scale: blocks are ordered by distributed prefix sums over slices of the hash order, a window a slice of some thousand
blocks and one over a source's slices. Blocks grow where there would be more than ``MOST_BLOCKS``, so that every
hypergeometric draw stays within its generator's exact range. A shard of ``mixed`` is a run of whole partitions, as many as
the input's splits ask for.

What reaches the driver: one row per source (name, words, blocks), never documents or blocks. Per document the result is
an array of copies (at most ``ceil(most)``), so nothing is exploded until ``mixed``.

Null text: size 0, never taken. Null source: a source of its own. Repeated rows (same id and text) share block and order
and are taken one by one. All-empty sources: target 0. Empty table: no rows. Reruns agree: every choice is a hash.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from stockgrid.llm.common import pick, position, split_count, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST_BLOCKS = 400_000_000   # taken blocks of all passes together; numpy draws exactly below 10^9
SLICE_BLOCKS = 10_000       # blocks of a source that one window orders, about


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words each source (in its fixed order) shall give: weighted shares, stopped at ``most`` times the size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, free = share * sum(sizes), list(range(len(sizes)))
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int = 11) -> np.ndarray:
    """Blocks of each source that each shard gets (shards x sources); columns sum to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(low: int, high: int, counts: np.ndarray) -> None:
        if high - low == 1 or not counts.sum():
            out[low] = counts
            return
        middle = (low + high) // 2
        total = int(counts.sum())
        draws = round(total * (middle - low) / (high - low))
        rng = np.random.default_rng([seed, low, high])
        left, rest = np.zeros_like(counts), total
        for i, c in enumerate(counts):  # a multivariate draw as conditional single draws
            rest -= int(c)
            got = _hypergeometric(rng, int(c), rest, draws)
            left[i] = got
            draws -= got
        split(low, middle, left)
        split(middle, high, counts - left)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    return int(rng.hypergeometric(good, bad, draws)) if good and draws else 0


def _unit(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def _small(known: DataFrame, rows: int) -> DataFrame:
    """A table of ``rows`` rows a source: broadcast while it is known to be small, else left to a shuffled join."""
    return F.broadcast(known) if rows <= 100_000 else known


def _before(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each one in ``by``, ordered by ``slice``, then ``order``. No
    window holds more than a slice, or one row for each slice of a group."""
    sums = df.groupBy(*by, "slice").agg(F.sum(value).alias("s_sum"))
    ahead = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"s_{c}") for c in [*by, "slice"]],
                       F.coalesce(F.sum("s_sum").over(ahead), F.lit(0)).alias("s_before"))
    inside = Window.partitionBy(*by, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = df.withColumn("s_own", F.sum(value).over(inside) - value)
    same = [F.col(c) == F.col(f"s_{c}") for c in [*by, "slice"]]
    return own.join(sums, same).withColumn(out, F.col("s_before") + F.col("s_own")).drop(*sums.columns, "s_own")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, shards: int = 16,
         block_words: int = 100_000) -> DataFrame:
    """One row a row of ``docs``: ``doc_id``, ``text_hash``, ``source``, ``size``, ``source_size``, ``target`` and
    ``copies``, an array of (pass, shard, key): where each copy goes and its place in the shard's local shuffle."""
    d = pick(docs, "doc_id", "text", "source").withColumn("doc_id", F.col("doc_id").cast("long"))
    text = F.coalesce("text", F.lit(""))
    size = F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")
    rows = stored(d.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col("source").cast("string").alias("source"),
                           size.alias("size")), "mix-rows")
    spark = docs.sparkSession
    sources = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()  # one row per source
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["n"] for r in sources], weights, share, most)
    passes = math.ceil(most)
    words = sum(r["n"] for r in sources)
    block_words = max(block_words, math.ceil(words * passes / MOST_BLOCKS))
    blocks = [max(1, math.ceil(r["n"] / block_words)) for r in sources]
    bits = max(1, (max(blocks, default=0) // SLICE_BLOCKS).bit_length())
    schema = StructType([StructField("s", StringType()), StructField("sid", IntegerType()),
                         StructField("source_size", LongType()), StructField("target", DoubleType()),
                         StructField("blocks", LongType())])
    known = spark.createDataFrame([(r["source"], i, r["n"], goal[i], blocks[i]) for i, r in enumerate(sources)], schema)
    placed = rows.join(_small(known, len(sources)), rows.source.eqNullSafe(known.s)).drop("s")
    placed = placed.withColumn("block", F.pmod(_unit(F.lit("block"), "doc_id", "text_hash"), F.col("blocks")))
    # the passes of each block: words before it in the pass's order, words it may give
    heaps = stored(placed.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"),
                                                      F.first("source_size").alias("n")), "mix-heaps")
    each = heaps.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn(
        "order", _unit(F.lit("pass"), "pass", "sid", "block"))
    half = 1 << (bits - 1)  # the first bits of the order, as slices that rise with pass and order
    each = each.withColumn("slice", F.col("pass").cast("long") * (2 * half) + F.shiftright("order", 64 - bits) + half)
    each = _before(each, ["sid", "pass"], ["order", "block"], F.col("words"), "before")
    want = F.least(F.greatest(F.col("target") - F.col("pass") * F.col("n"), F.lit(0.0)), F.col("n").cast("double"))
    each = each.withColumn("give", F.least(F.round(want) - F.col("before"), F.col("words").cast("double"))).where(
        (F.col("give") > 0) & (F.col("words") > 0))
    taken = stored(each.select("sid", "block", "pass", "order", "slice", F.col("give").cast("long").alias("give"), "words"),
                   "mix-blocks")
    quota = {r["sid"]: r["q"] for r in taken.groupBy("sid").agg(F.count("*").alias("q")).collect()}
    tree = splitting_tree([quota.get(i, 0) for i in range(len(sources))], shards)
    ends = np.cumsum(tree, axis=0)
    deal = spark.createDataFrame([(i, [int(x) for x in ends[:, i]]) for i in range(len(sources))], "sid int, ends array<long>")
    shard = F.size(F.filter("ends", lambda x: x <= F.col("number"))).cast("int")
    numbered = _before(taken, ["sid"], ["order", "block"], F.lit(1), "number")
    dealt = numbered.join(_small(deal, len(sources) * shards), "sid").select(
        "sid", "block", F.struct("pass", shard.alias("shard"), "give", (F.col("give") < F.col("words")).alias("part")).alias("t"))
    by_block = dealt.groupBy("sid", "block").agg(F.array_sort(F.collect_list("t")).alias("t"))  # one for each pass
    full = placed.join(by_block.select(F.col("sid").alias("s"), F.col("block").alias("b"), "t"),
                       (F.col("sid") == F.col("s")) & (F.col("block") == F.col("b")), "left")
    # only the blocks at a pass's border need the words before each document
    border = F.exists(F.coalesce("t", F.array()), lambda t: t.part)
    whole = full.where(~border).withColumn("before", F.array(*[F.lit(0).cast("long")] * passes))
    cut = full.where(border)
    counts = []
    for p in range(passes):
        w = Window.partitionBy("sid", "block").orderBy(_unit(F.lit("doc"), F.lit(p), "doc_id", "text_hash"), "doc_id",
                                                       "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts.append(F.sum("size").over(w) - F.col("size"))
    cut = cut.withColumn("before", F.array(*counts))
    both = whole.unionByName(cut)
    # a document of the border block is taken if more than half of it lies within what the block gives
    copies = F.transform(
        F.filter(F.coalesce("t", F.array()), lambda t: (F.col("size") > 0) & (
            ~t.part | (F.col("before")[t["pass"]] * 2 + F.col("size") <= t.give * 2))),
        lambda t: F.struct(t["pass"].alias("pass"), t.shard.alias("shard"),
                           _unit(F.lit("key"), t["pass"], F.col("doc_id"), F.col("text_hash")).alias("key")))
    return both.select("doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """Contract query."""
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).alias("taken"),
                             "source", "copies")


def mixed(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """The mix itself: every column of ``docs``, a row for each copy taken. A shard is a run of whole partitions, so written
    files follow the shards in order, and its documents lie in the order of their random keys. The number of partitions
    is a multiple of ``shards`` and grows with the input's splits. Repeated rows are told apart by their place among
    equals, which the plan keeps in number."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    plain = plain.withColumn("d_id", F.col(f"c{position(docs, 'doc_id')}").cast("long")).withColumn(
        "d_hash", F.xxhash64(F.coalesce(F.col(f"c{position(docs, 'text')}"), F.lit(""))))
    same = Window.partitionBy("d_id", "d_hash").orderBy(F.lit(0))
    plain = plain.withColumn("d_twin", F.row_number().over(same))
    rows = plan(docs, shards=shards, **options).select("doc_id", "text_hash", "copies")
    rows = rows.withColumn("twin", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("copies")))
    key = plain.d_id.eqNullSafe(rows.doc_id) & (plain.d_hash == rows.text_hash) & (plain.d_twin == rows.twin)
    out = plain.join(rows.where("size(copies) > 0"), key).withColumn("copy", F.explode("copies"))
    # equal parts of a shard by the first bits of the key, a hash that the place among equals is mixed into
    each = -(-split_count(docs) // shards)
    place = F.shiftrightunsigned(F.xxhash64("copy.key", "twin"), 1)
    part = F.shiftright(F.shiftright(place, 32) * F.lit(each).cast("long"), 31)
    out = out.withColumn("place", place).repartitionById(shards * each, (F.col("copy.shard") * each + part).cast("int"))
    out = out.sortWithinPartitions("copy.shard", "place")
    return out.select(*plain.columns[:len(names)]).toDF(*names)
