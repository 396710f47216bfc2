"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ``k`` least distinct 64-bit hashes of a text's shingles (five words ``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased; a shorter text is one shingle, a text without words none). Sketches of parts merge into the sketch of their
union, and two of them estimate resemblance, containment and the number of distinct shingles; a sketch with fewer than
``k`` hashes is the whole set, so its estimates are exact.

``next_documents`` gives each document the one after it in descending doc_id without a global sort in one task: rows are
dealt to ranges of doc_id whose bounds are approximate quantiles, and each range gets one more row, the first of the
range after it (one a range is collected). Texts are shuffled once.

Nulls and ties: null text as empty; null ids come last; rows with one id are ordered by text hash, equal rows follow each
other. Empty table: no rows. A single row is its own successor. Other columns are never read.
"""
from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockgrid.llm.common import documents, slices, split_count, words

K = 256
SHINGLE = 5


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, known: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(h) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(h))):
        out = _mixed(out ^ h[i:i + n]) + np.uint64(i + 1)
    return out


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct values, rising."""
    if len(hashes) > 8 * k:
        some = np.unique(hashes[hashes <= np.partition(hashes, 4 * k)[4 * k]])
        if len(some) >= k:
            return some[:k]
    return np.unique(hashes)[:k]


def merge_two(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the two shingle sets; two empty sets are alike."""
    union = merge_two(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1.0) / 2.0 ** 64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    n = distinct_shingles(a, k)
    if not n:
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_shingles(merge_two(a, b, k), k) / n)


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def merge(sketches: DataFrame, by: str, k: int = K) -> DataFrame:
    """Sketch of the union for each value of ``by`` from rows of ``by`` and ``fingerprint``. Hashes are exploded, made
    distinct with a partial step, and the k least are kept with a limit inside every task before the shuffle."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            hs = [(np.asarray(from_text(s)) ^ np.uint64(1 << 63)).view(np.int64) for s in f["fingerprint"]]
            yield pd.DataFrame({by: np.repeat(f[by].to_numpy(object), [len(h) for h in hs]),
                                "h": np.concatenate([np.zeros(0, np.int64), *hs])})

    kind = sketches.schema[by].dataType.simpleString()
    each = sketches.select(by, "fingerprint").where("fingerprint is not null").mapInPandas(run, f"`{by}` {kind}, h long").distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy("h"))
    least = each.withColumn("r", rank).where(F.col("r") <= k).groupBy(by).agg(F.array_sort(F.collect_list("h")).alias("h"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [to_text(np.asarray(h, np.int64).view(np.uint64) ^ np.uint64(1 << 63)) for h in f["h"]]
            yield pd.DataFrame({by: f[by], "fingerprint": texts})

    return least.mapInPandas(write, f"`{by}` {kind}, fingerprint string")


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``value``, by a coarse and a fine step; -1 for null."""
    if not bounds:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    step = math.isqrt(len(bounds)) + 1
    runs = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = F.size(F.filter(array([r[0] for r in runs]), lambda b: b <= value))
    fine = F.element_at(F.array(*[array(r) for r in runs]), F.greatest(coarse, F.lit(1)))
    inside = F.size(F.filter(fine, lambda b: b <= value))
    found = F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + inside)
    return F.when(value.isNull(), F.lit(-1)).otherwise(found.cast("int"))


def next_documents(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows of ``range``, ``doc_id``, ``text`` and ``guest``, where a range's rows lie together in one partition in
    descending order, followed by a guest: a copy of the row that comes after them. Also the number of ranges."""
    d = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    n = split_count(d)
    bounds = sorted({int(q) for q in d.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})
    d = d.withColumn("range", _range_of(F.col("doc_id"), bounds))
    firsts = d.groupBy("range").agg(F.min(F.struct((-F.col("doc_id")).alias("minus"), "text_hash")).alias("f")).collect()
    firsts.sort(key=lambda r: -r["range"])
    rows = [(None if r["f"]["minus"] is None else -r["f"]["minus"], r["f"]["text_hash"], firsts[i - 1]["range"])
            for i, r in enumerate(firsts)]  # the range before, and the last one for the first
    heads = d.sparkSession.createDataFrame(rows, "i long, h long, host int")
    guests = d.join(F.broadcast(heads), d.doc_id.eqNullSafe(heads.i) & (d.text_hash == heads.h))  # one a range
    guests = guests.select("doc_id", "text", "text_hash", F.col("host").alias("range"), F.lit(True).alias("guest"))
    every = d.withColumn("guest", F.lit(False)).select("doc_id", "text", "text_hash", "range", "guest").unionByName(guests)
    dealt = every.repartition(n, "range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text_hash")
    return dealt.select("range", "doc_id", "text", "guest"), n


def fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Contract query: each text, its edited text and the next document's, compared by sketch."""
    dealt, _ = next_documents(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        held = None  # the row that waits for its successor: (range, id, text, sketch)
        for part in slices(batches):
            out = []
            for where, ident, text, guest in zip(*[part.column(c).to_pylist() for c in ("range", "doc_id", "text", "guest")]):
                mine = bottom(shingle_hashes(text, known, shingle), k)
                if held is not None and held[0] == where:
                    _, before, old, sketch = held
                    half = len(old) // 2
                    edited = old[:len(old) - half] + text[:half]
                    other = bottom(shingle_hashes(edited, known, shingle), k)
                    out.append((before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                to_text(sketch), to_text(other), resemblance(sketch, other, k), resemblance(sketch, mine, k),
                                distinct_shingles(sketch, k)))
                held = None if guest else (where, ident, text, mine)
            cols = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names=NAMES)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double, distinct_shingles double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
         "distinct_shingles"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
