"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

* Features of a text, all taken from the whole text: its wording, as counts of words and of letter trigrams in ``TERMS``
  hash slots each, damped and weighted by inverse document frequency, which one pass counts over all documents; and its
  shape, as counts of character-class trigrams (what is shouted, cut up by symbols, tabulated or repeated shows there in
  any language) and a few shares of its words and lines.
* Latent space: truncated SVD of the weighted features of a labelled sample, at most ``per_class`` rows of each label,
  chosen by hash. That bound is the only sampling; it also bounds what is broadcast.
* Score: exact cosines of every document with all labelled vectors, in blocks; the ``neighbours`` most alike vote for
  their label with weight similarity ** ``sharpness`` times their class's share, as classes are sampled evenly.

Two passes over the texts (document frequencies, scores), no shuffle of them. Labels: rows with null id or quality are dropped; conflicting labels of an id
count as their mean, rounded up. Null or empty text: scored like any text, by its (empty) features. No labelled rows:
score 1 for all, as nothing speaks against a text. Repeated rows are scored alike. Ties go to the earlier sample row.
Empty table: no rows. lang, source, other columns and the id are never inputs of a score.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockgrid.llm.common import documents, pick, remainder, slices

#: Character classes besides lower, upper, digit, beyond ASCII, blank, line end and the rest.
GROUPS = [b"!", b"|", b"*%&$#^~@`=+", b".,;:?", b"-_\"'()[]{}<>/\\"]
CLASSES = 12
STATS = 10
TERMS = 4096    # hash slots for words, and as many for letter trigrams
LEXICAL = 1.0   # length of each of the two wording parts of a vector


def _class_table() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[97:123], t[65:91], t[48:58], t[128:] = 1, 2, 3, 4
    t[32], t[10] = 5, 6
    for i, g in enumerate(GROUPS):
        t[list(g)] = 7 + i
    return t


TABLE = _class_table()
SHAPE = CLASSES ** 3 + STATS
WIDTH = SHAPE + 2 * TERMS
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _slots(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX[3]
    return ((h >> np.uint64(40)) % np.uint64(TERMS)).astype(np.int64)


def terms(text: str) -> np.ndarray:
    """Counts of lower-cased words and of trigrams within them (with word ends) by hash slot. A word is a run of ASCII
    letters and digits and of anything beyond ASCII."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], (c >= 128) | WORD[np.minimum(c, 127)], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turns[::2], turns[1::2]
    out = np.zeros(2 * TERMS, np.float32)
    if len(start):
        size = end - start
        letters = c[inside[1:-1]].astype(np.uint64) + np.uint64(1)
        first = np.cumsum(size) - size
        place = (np.arange(len(letters)) - np.repeat(first, size)).astype(np.uint64)
        whole = np.add.reduceat(_spread(letters * MIX[0] + place * MIX[1]), first)
        out[:TERMS] = np.bincount(_slots(whole), minlength=TERMS)
        padded = np.zeros(len(letters) + len(size) + 1, np.uint64)  # a zero before, between and after words
        padded[1 + np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
        grams = padded[:-2] * MIX[0] + padded[1:-1] * MIX[1] + padded[2:] * MIX[2]
        out[TERMS:] = np.bincount(_slots(_spread(grams[padded[1:-1] != 0])), minlength=TERMS)
    return out


def _spread(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * MIX[3]


WORD = np.array([chr(i).isalnum() for i in range(128)])


def features(text: str) -> np.ndarray:
    """Shares of character-class trigrams (square root), word statistics and damped counts of terms of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    c = TABLE[np.frombuffer(raw, np.uint8)]
    out = np.zeros(WIDTH, np.float32)
    out[SHAPE:] = np.log1p(terms(text))
    if len(c) > 2:
        counts = np.bincount(c[:-2] * CLASSES ** 2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES ** 3)
        out[:CLASSES ** 3] = np.sqrt(counts / (len(c) - 2))
    ws = raw.split()
    if ws:
        n, kinds = len(ws), set(ws)
        twins = sum(a == b for a, b in zip(ws, ws[1:])) / n
        size = np.fromiter(map(len, ws), np.int64, n)
        upper = sum(map(bytes.isupper, ws)) / n
        plain = sum(map(bytes.isalnum, ws)) / n
        lines = [x for x in raw.split(b"\n") if x]
        out[CLASSES ** 3:SHAPE] = (twins, upper, 1 - plain, len(kinds) / n, min(1.0, np.log1p(n) / 10), min(1.0, size.mean() / 20),
                              min(1.0, size.std() / 10), 1 - len(set(lines)) / len(lines), min(1.0, 100 / n) if n < 100 else 0.0, 1.0)
    return out


def by_frequency(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """``x`` itself, each of its two wording parts weighted and brought to length ``LEXICAL``."""
    for a in (SHAPE, SHAPE + TERMS):
        part = x[:, a:a + TERMS]
        part *= idf[a - SHAPE:a - SHAPE + TERMS]
        part *= LEXICAL / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-12)[:, None]
    return x


@dataclass(frozen=True)
class QualityModel:
    idf: np.ndarray        # of each term slot
    weights: np.ndarray    # of each feature
    mean: np.ndarray
    axes: np.ndarray       # features x latent
    vectors: np.ndarray    # labelled x latent, unit length
    labels: np.ndarray
    shares: np.ndarray     # vote weight of each labelled row

    def project(self, x: np.ndarray) -> np.ndarray:
        z = by_frequency(x * self.weights, self.idf)
        z -= self.mean
        z = z @ self.axes
        return z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-12)

    def score(self, x: np.ndarray, neighbours: int, sharpness: float, block: int = 512) -> np.ndarray:
        if not len(self.labels):
            return np.ones(len(x))
        k = min(neighbours, len(self.labels))
        out = np.empty(len(x))
        for i in range(0, len(x), block):
            cosine = self.project(x[i:i + block]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            like = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6) ** sharpness * self.shares[near]
            out[i:i + block] = (like * self.labels[near]).sum(axis=1) / like.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def fit(x: np.ndarray, labels: np.ndarray, shares: np.ndarray, idf: np.ndarray, latent: int = 48,
        seed: int = 5) -> QualityModel:
    """Truncated SVD by a randomised range finder with power steps. ``x`` is used up."""
    if not len(labels):
        empty = np.zeros((WIDTH, 1), np.float32)
        return QualityModel(idf, np.ones(WIDTH, np.float32), np.zeros(WIDTH, np.float32), empty, np.zeros((0, 1)), labels, shares)
    spread = x.std(axis=0)
    weights = (1.0 / np.sqrt(spread + 0.02)).astype(np.float32)  # rare, telling features weigh more
    weights[CLASSES ** 3:] *= 1.5
    weights[SHAPE:] = 1.0
    x *= weights
    a = by_frequency(x, idf)
    mean = a.mean(axis=0)
    a -= mean
    k = min(latent, *a.shape)
    y = a @ np.random.default_rng(seed).standard_normal((a.shape[1], min(k + 8, a.shape[1]))).astype(np.float32)
    for _ in range(3):
        y = a @ (a.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    axes = np.linalg.svd(q.T @ a, full_matrices=False)[2][:k].T.astype(np.float32)
    z = a @ axes
    z /= np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-12)
    return QualityModel(idf, weights, mean.astype(np.float32), axes, z.astype(np.float32), labels.astype(np.float64), shares)


def labelled(docs: DataFrame, labels: DataFrame, per_class: int, modulus: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and vote weights of at most ``per_class`` rows of each label, chosen by hash threshold."""
    own = pick(labels, "doc_id", "quality").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    own = own.where("doc_id is not null and quality is not null").where(remainder(modulus) != 0)
    own = own.groupBy("doc_id").agg(F.ceil(F.avg("quality")).cast("int").alias("quality"))
    own = own.withColumn("h", F.xxhash64("doc_id", F.lit("quality")).cast("double") / F.lit(2.0 ** 64) + F.lit(0.5))
    counts = {r["quality"]: r["n"] for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0), np.zeros(0)
    keep = None
    for q, n in counts.items():
        part = (F.col("quality") == q) & (F.col("h") < F.lit(1.0 * per_class / n))
        keep = part if keep is None else keep | part
    ids = own.where(keep).orderBy("h", "doc_id").limit(2 * per_class * len(counts)).select(F.col("doc_id").alias("i"), "quality", "h")
    some = documents(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("i")).select("text", "quality", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            xs = [features(t) for t in part.column("text").to_pylist()]
            at = [np.flatnonzero(x) for x in xs]
            yield pa.RecordBatch.from_arrays(
                [part.column("quality"), part.column("h"), pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()),
                 pa.array([x[i].tobytes() for x, i in zip(xs, at)], pa.binary())], names=["quality", "h", "at", "x"])

    rows = some.mapInArrow(run, "quality int, h double, at binary, x binary").orderBy("h", "at", "x").limit(
        2 * per_class * len(counts)).collect()
    x, y = np.zeros((len(rows), WIDTH), np.float32), np.array([r["quality"] for r in rows], np.int64)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], np.float32)
    taken = {q: max(1, int((y == q).sum())) for q in counts}
    return x, y, np.array([counts[q] / taken[q] for q in y], np.float64)


def frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each term slot over all rows; a row per task and slot is summed in Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * TERMS + 1, np.int64)
        for part in slices(batches):
            for t in part.column("text").to_pylist():
                n[:-1] += terms(t) > 0
            n[-1] += len(part)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["slot", "n"])

    counts = np.zeros(2 * TERMS + 1)
    for r in docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    return (1.0 + np.log((1.0 + counts[-1]) / (1.0 + counts[:-1]))).astype(np.float32)


def quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, neighbours: int = 15, sharpness: float = 8.0,
            threshold: float = 0.3, modulus: int = 5) -> DataFrame:
    """Contract query: ``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``."""
    d = documents(docs)
    x, y, shares = labelled(docs, labels, per_class, modulus)
    model = fit(x, y, shares, frequencies(d) if len(y) else np.ones(2 * TERMS, np.float32))
    del x
    shared = d.sparkSession.sparkContext.broadcast(model)  # at most 2 x per_class latent vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4_000_000):
            scores = [np.zeros(0)]
            for i in range(0, len(part), 256):
                x = np.stack([features(t) for t in part.column("text").slice(i, 256).to_pylist()])
                scores.append(shared.value.score(x, neighbours, sharpness))
            scores = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = d.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder(modulus) == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
