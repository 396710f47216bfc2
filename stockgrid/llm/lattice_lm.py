"""LM scoring by a subword lattice.

An existing tokenizer's pieces (never trained here) span a lattice over every word; a unigram probability of each piece
weights all segmentations, and a forward recursion in log space returns the marginal probability of the word. The lattice
of a word of the training texts has one more edge, over the whole word, weighted by its relative frequency; the pieces
share the probability that such edges leave, which is the share of training words seen once (Good-Turing). A text's words
are independent, so its log probability is the sum over its words plus the end's.

Piece probabilities start from the vocabulary's own scores and are re-estimated by expected counts over all distinct
training words, ``rounds`` passes: what the pieces have to explain are words not seen before. Words, pieces and end are
one distribution that sums to one; single bytes are pieces, so no text has probability zero.

Jobs: distinct words meet in buckets (``dictionary``), where counts are summed and each word is scored once; the answers
return to the chunks and are summed by document. What the driver gets: one number per piece of the fixed vocabulary and
the corpus totals.

Null or empty text: the end alone. No training rows: counts are 0, the pieces keep their first probabilities. Repeated
rows: one row each. Empty table: no rows. Other columns are never read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from stockgrid.llm.common import documents, remainder, split_count, stored, words
from stockgrid.llm.dictionary import answered, bodies, dictionaries, merged, pack_words, rejoined, unpack, unpack_words

WIDE = 64          # longer words, and lengths that few words have, go one by one
FEW = 6


def read_pieces(path: str) -> dict[bytes, float]:
    """Pieces of a sentencepiece model as bytes (the word mark as a blank) with a first weight from their scores.
    Blanks inside or at the end, control and unknown pieces can't occur in a word and are left out."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = sp.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode("utf-8")
        if b" " in raw[1:]:
            continue
        # merge scores are ranks below zero: taken as the places of a Zipf law
        out[raw] = max(out.get(raw, 0.0), 1.0 / (10.0 - min(0.0, sp.get_score(i))))
    for b in range(256):
        out.setdefault(bytes([b]), 1e-6)
    return out


class Lattice:
    """Piece weights with a vectorised lookup by rolling hash."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, log_p: dict[bytes, float]):
        self.pieces = list(log_p)
        self.number = {p: i for i, p in enumerate(self.pieces)}
        self.log_p = np.array([log_p[p] for p in self.pieces])
        self.lengths = sorted({len(p) for p in self.pieces})
        self.by_length = {}
        for n in self.lengths:
            own = [p for p in self.pieces if len(p) == n]
            h = self._roll(np.frombuffer(b"".join(own), np.uint8).reshape(len(own), n))[n]
            order = np.argsort(h)
            ids = np.array([self.number[p] for p in own])[order]
            self.by_length[n] = (h[order], ids)

    def _roll(self, m: np.ndarray) -> dict[int, np.ndarray]:
        """Hashes of all windows by length; a matrix of one window's width gives a column."""
        wide = m.astype(np.uint64) + np.uint64(1)
        h, out = np.zeros((m.shape[0], m.shape[1] + 1), np.uint64), {}
        for n in range(1, (self.lengths[-1] if self.lengths else 0) + 1):
            if n > m.shape[1]:
                break
            h = h[:, :m.shape[1] - n + 1] * self.BASE + wide[:, n - 1:]
            out[n] = h[:, 0] if n == m.shape[1] else h
        return out

    def edges(self, m: np.ndarray) -> dict[int, np.ndarray]:
        """Piece numbers (-1: none) by length and start for words of equal length, the rows of ``m``."""
        found = {}
        for n, h in self._roll(m).items():
            if n not in self.by_length:
                continue
            table, ids = self.by_length[n]
            h = h.reshape(m.shape[0], -1)
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[at] == h
            if hit.any():
                found[n] = np.where(hit, ids[at], -1)
        return found

    def forward(self, edges: dict[int, np.ndarray], rows: int, size: int) -> np.ndarray:
        w = np.append(self.log_p, -np.inf)
        a = np.full((size + 1, rows), -np.inf)
        a[0] = 0.0
        for j in range(1, size + 1):
            terms = [a[j - n] + w[e[:, j - n]] for n, e in edges.items() if n <= j]
            a[j] = np.logaddexp.reduce(terms) if terms else -np.inf
        return a

    def backward(self, edges: dict[int, np.ndarray], rows: int, size: int) -> np.ndarray:
        w = np.append(self.log_p, -np.inf)
        b = np.full((size + 1, rows), -np.inf)
        b[size] = 0.0
        for i in range(size - 1, -1, -1):
            terms = [b[i + n] + w[e[:, i]] for n, e in edges.items() if i + n <= size]
            b[i] = np.logaddexp.reduce(terms) if terms else -np.inf
        return b

    def _groups(self, spelled: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        order = np.argsort(size, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
            n = int(size[part[0]])
            if n > WIDE or len(part) < FEW:
                for i in part:
                    yield np.array([i]), None
                continue
            for i in range(0, len(part), 8192):
                some = part[i:i + 8192]
                yield some, np.frombuffer(b"".join([spelled[j] for j in some]), np.uint8).reshape(len(some), n)

    def _alone(self, word: bytes) -> list[list[tuple[int, int]]]:
        """(stop, piece) edges from each position of one word."""
        n = len(word)
        return [[(i + k, self.number[word[i:i + k]]) for k in self.lengths if i + k <= n and word[i:i + k] in self.number]
                for i in range(n)]

    @staticmethod
    def _sum(terms: list[float]) -> float:
        top = max(terms, default=-math.inf)
        return top if top == -math.inf else top + math.log(sum(math.exp(t - top) for t in terms))

    def _forward_alone(self, edges: list[list[tuple[int, int]]]) -> list[float]:
        into: list[list[float]] = [[] for _ in range(len(edges) + 1)]
        a = [0.0] * (len(edges) + 1)
        for i, out in enumerate(edges):
            if i:
                a[i] = self._sum(into[i])
            for stop, p in out:
                into[stop].append(a[i] + self.log_p[p])
            into[i] = []
        a[-1] = self._sum(into[-1])
        return a

    def marginals(self, some_words: list[bytes]) -> np.ndarray:
        """Log probability of each word over all its segmentations."""
        spelled = [b" " + w for w in some_words]
        out = np.empty(len(spelled))
        for rows, m in self._groups(spelled):
            if m is None:
                out[rows[0]] = self._forward_alone(self._alone(spelled[rows[0]]))[-1]
            else:
                out[rows] = self.forward(self.edges(m), len(rows), m.shape[1])[-1]
        return out

    def expected(self, some_words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, weighted by their counts."""
        spelled = [b" " + w for w in some_words]
        total = np.zeros(len(self.pieces))
        for rows, m in self._groups(spelled):
            if m is None:
                edges = self._alone(spelled[rows[0]])
                a = self._forward_alone(edges)
                n = len(edges)
                b = [-math.inf] * n + [0.0]
                for i in range(n - 1, -1, -1):
                    b[i] = self._sum([self.log_p[p] + b[stop] for stop, p in edges[i]])
                for i, out in enumerate(edges):
                    for stop, p in out:
                        total[p] += counts[rows[0]] * math.exp(a[i] + self.log_p[p] + b[stop] - a[-1])
                continue
            edges, size = self.edges(m), m.shape[1]
            a, b = self.forward(edges, len(rows), size), self.backward(edges, len(rows), size)
            for n, e in edges.items():
                row, at = np.nonzero(e >= 0)
                p = e[row, at]
                use = np.exp(a[at, row] + self.log_p[p] + b[at + n, row] - a[-1, row]) * counts[rows[row]]
                total += np.bincount(p, use, len(self.pieces))
        return total


def normalised(weights: dict[bytes, float]) -> dict[bytes, float]:
    total = sum(weights.values())
    return {p: math.log(w / total) for p, w in weights.items()}


@lru_cache(maxsize=2)
def _lattice(items: tuple) -> Lattice:
    return Lattice(dict(items))


def _floats(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a, np.float64).tobytes())


def _from_floats(blobs: list[bytes]) -> np.ndarray:
    raw = b"".join(zstandard.ZstdDecompressor().decompress(b) for b in blobs)
    return np.frombuffer(raw, np.float64)


def _vocabulary(frame: pd.DataFrame) -> pd.DataFrame:
    """Training words of one bucket with their counts."""
    at, numbers = merged([unpack_words(t, n, True) for t, n in zip(frame["words"], frame["lengths"])])
    c = np.zeros(len(at), np.int64)
    for ns, packed in zip(numbers, frame["counts"]):
        c[ns] += unpack(packed)
    every = list(at)
    seen = np.flatnonzero(c)
    text, lengths = pack_words([every[i] for i in seen])
    return pd.DataFrame({"words": [text], "lengths": [lengths], "counts": [c[seen].astype("<i8").tobytes()],
                         "n": [int(c.sum())], "v": [len(seen)], "once": [int((c == 1).sum())]})


def score(docs: DataFrame, pieces: dict[bytes, float], learn_modulus: int = 7, held_remainder: int = 2, rounds: int = 2) -> DataFrame:
    """Contract query. ``pieces``: existing vocabulary with first weights (``read_pieces``)."""
    d = documents(docs).withColumn("learn", remainder(learn_modulus) != held_remainder)
    context = d.sparkSession.sparkContext
    buckets = split_count(d)
    dicts = stored(dictionaries(d, words, buckets), "lm-words")
    known = stored(dicts.groupBy("bucket").applyInPandas(
        _vocabulary, "words binary, lengths binary, counts binary, n long, v long, once long"), "lm-counts")
    ends = d.where("learn").count()
    total = known.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once")]).collect()[0]
    n_all, v_all = total["n"] + ends, total["v"] + (1 if ends else 0)
    log_p = normalised(pieces)
    for _ in range(rounds if total["v"] else 0):
        sent = context.broadcast(tuple(log_p.items()))  # the vocabulary: a fixed size

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lattice = _lattice(sent.value)
            uses = np.zeros(len(lattice.pieces))
            for frame in frames:
                for text, lengths in zip(frame["words"], frame["lengths"]):
                    some = unpack_words(text, lengths, True)
                    uses += lattice.expected(some, np.ones(len(some)))
            used = np.flatnonzero(uses)
            yield pd.DataFrame({"piece": used, "uses": uses[used]})

        sums = known.repartition(buckets).mapInPandas(count, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("u"))
        uses = {r["piece"]: r["u"] for r in sums.collect()}
        # a small part of a use for every piece keeps unseen texts possible
        log_p = normalised({p: uses.get(i, 0.0) + 0.01 for i, p in enumerate(log_p)})
    model = context.broadcast(tuple(log_p.items()))
    floor = n_all + v_all + 1
    new = min(max(total["once"] / max(total["n"], 1), 1e-3), 1 - 1e-3)
    pieces_share, all_share = math.log(0.5 + new * total["n"]), math.log(n_all + 1)

    def answer(lists: list[list[bytes]], counts: list[bytes]) -> list[list[bytes]]:
        at, numbers = merged(lists)
        c = np.zeros(len(at), np.int64)
        for ns, packed in zip(numbers, counts):
            c[ns] += unpack(packed)
        base = np.log10((c + 1) / floor)
        subword = pieces_share + _lattice(model.value).marginals(list(at))
        with np.errstate(divide="ignore"):
            own = (np.logaddexp(np.log(c * (1 - new)), subword) - all_share) / math.log(10)
        return [[_floats(base[ns]), _floats(own[ns]), _floats(c[ns] > 0)] for ns in numbers]

    end_base, end_score = math.log10((ends + 1) / floor), math.log10((ends + 0.5) / (n_all + 1))

    def finish(names: list, sizes: np.ndarray, numbers: np.ndarray, got: list[list[bytes]]) -> pd.DataFrame:
        base, own, seen = (_from_floats(column)[numbers] for column in got)
        text = np.repeat(np.arange(len(sizes)), sizes)
        by_text = lambda x: np.bincount(text, x, len(sizes))
        return pd.DataFrame({
            "doc_id": pd.array(names, "Int64"), "n_tokens": sizes + 1, "n_known": by_text(seen).astype(np.int64) + (ends > 0),
            "base_score": by_text(base) + end_base, "score": by_text(own) + end_score})

    answers = answered(dicts, answer, 3, as_bytes=True)
    out = rejoined(bodies(d.drop("learn"), words, buckets), answers, 3, finish,
                   "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (remainder(learn_modulus) == held_remainder).alias("held_out"), "n_tokens", "n_known",
                      F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
