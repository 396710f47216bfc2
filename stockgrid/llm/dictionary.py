"""Global distinct-word shuffle, packed.

A word occurs in most texts, so exploding texts into (document, position, word) rows would move many times the corpus.
Here the positions stay with a chunk (consecutive documents of one input split, about ``CHUNK`` bytes): a chunk keeps its
tokens as numbers of its own dictionary, and only the dictionary's distinct words are dealt to buckets by word hash, where
equal words of all chunks meet and are worked on once. The answers return to their chunk and are laid out by position.

* ``dictionaries``: (chunk, bucket, words): a chunk's distinct words of one bucket, packed.
* ``bodies``: one row a chunk: document ids, token numbers by position, and the bucket of every word.
* ``answered`` runs a function on each bucket; ``rejoined`` brings answers and bodies together by chunk.

A word of any frequency has one entry a chunk, so no bucket is hot, and both tables grow in proportion to the input. The
chunk's name is a hash of its ids and texts: both passes over the input name chunks by content, and a chunk without its
answers is an error, never a silent gap.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from stockgrid.llm.common import give_back

CHUNK = 8 << 20
Tokens = Callable[[str], list]


class Numbered(dict):
    """Numbers its keys in order of first use."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def pack(a: np.ndarray) -> bytes:
    """Compressed integers, byte planes apart (small numbers leave the upper planes empty)."""
    a = np.ascontiguousarray(a, np.uint32)
    planes = a.view(np.uint8).reshape(-1, 4).T.tobytes() if len(a) else b""
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def pack_words(words: list) -> tuple[bytes, bytes]:
    """(compressed text, packed lengths) of str or bytes words."""
    raw = b"".join(words) if words and isinstance(words[0], bytes) else "".join(words).encode("utf-8", "surrogatepass")
    return zstandard.ZstdCompressor(level=3).compress(raw), pack(np.fromiter(map(len, words), np.int64, len(words)))


def unpack_words(text: bytes, lengths: bytes, as_bytes: bool) -> list:
    raw = zstandard.ZstdDecompressor().decompress(text)
    whole = raw if as_bytes else raw.decode("utf-8", "surrogatepass")
    ends = np.cumsum(unpack(lengths)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[str, list]]:
    give_back()
    held: dict[str, list] = {}
    bytes_held = 0
    for batch in batches:
        names = batch.schema.names
        texts = batch.column("text")
        rest = {n: batch.column(n).to_pylist() for n in names if n != "text"}
        for i in range(len(batch)):
            t = texts[i].as_py() or ""
            for n in rest:
                held.setdefault(n, []).append(rest[n][i])
            held.setdefault("text", []).append(t)
            bytes_held += len(t) + 64
            if bytes_held >= size:
                yield held
                held, bytes_held = {}, 0
    if held:
        yield held


def _numbered(chunk: dict[str, list], tokens: Tokens):
    """(name, words, token numbers of each document)."""
    name = xxhash.xxh3_128()
    at = Numbered()
    per_doc = []
    for ident, text in zip(chunk["doc_id"], chunk["text"]):
        name.update(f"{ident}:{len(text)}:".encode())
        name.update(text.encode("utf-8", "surrogatepass"))
        ts = tokens(text)
        per_doc.append(np.fromiter(map(at.__getitem__, ts), np.int64, len(ts)))
    return name.digest(), list(at), per_doc


def _bucket(words: list, buckets: int) -> np.ndarray:
    raw = words if words and isinstance(words[0], bytes) else [w.encode("utf-8", "surrogatepass") for w in words]
    return np.fromiter(map(zlib.crc32, raw), np.int64, len(words)) % buckets


def dictionaries(docs: DataFrame, tokens: Tokens, buckets: int, size: int = CHUNK) -> DataFrame:
    """``chunk``, ``bucket``, ``words``, ``lengths`` and ``counts`` (occurrences in documents whose ``learn`` is true;
    null if the frame has no such column). ``docs`` has ``doc_id``, ``text`` and maybe ``learn``."""
    learn = "learn" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            name, words, per_doc = _numbered(chunk, tokens)
            of = _bucket(words, buckets)
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=buckets))
            counts = None
            if learn:
                some = [ids for ids, use in zip(per_doc, chunk["learn"]) if use]
                counts = np.bincount(np.concatenate(some) if some else np.zeros(0, np.int64), minlength=len(words))
            rows = []
            for b, (a, e) in enumerate(zip([0, *ends], ends)):
                if e > a:
                    own = order[a:e]
                    text, lengths = pack_words([words[i] for i in own])
                    rows.append((name, b, text, lengths, pack(counts[own]) if learn else None))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["chunk", "bucket", "words", "lengths", "counts"])

    return docs.mapInArrow(run, "chunk binary, bucket int, words binary, lengths binary, counts binary")


def bodies(docs: DataFrame, tokens: Tokens, buckets: int, size: int = CHUNK) -> DataFrame:
    """``chunk``, ``ids`` (the documents' ids in order), ``sizes`` (their token counts), ``numbers`` (all tokens, as ranks
    by frequency) and ``of`` (the bucket of the word of each rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            name, words, per_doc = _numbered(chunk, tokens)
            flat = np.concatenate(per_doc)
            by_use = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty_like(by_use)
            rank[by_use] = np.arange(len(by_use))
            of = _bucket(words, buckets)
            # words of a bucket travel in order of first use: tell each rank its place among them
            place = np.empty(len(words), np.int64)
            place[np.argsort(of, kind="stable")] = np.arange(len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.binary()), pa.array([chunk["doc_id"]], pa.list_(pa.int64())),
                 pa.array([pack(np.array([len(x) for x in per_doc]))], pa.binary()),
                 pa.array([pack(rank[flat])], pa.binary()), pa.array([pack(place[by_use])], pa.binary())],
                names=["chunk", "ids", "sizes", "numbers", "places"])

    return docs.mapInArrow(run, "chunk binary, ids array<long>, sizes binary, numbers binary, places binary")


def merged(lists: list[list]) -> tuple[Numbered, list[np.ndarray]]:
    """Distinct words of all lists, and each list as numbers of them."""
    at = Numbered()
    return at, [np.fromiter(map(at.__getitem__, ws), np.int64, len(ws)) for ws in lists]


def answered(dicts: DataFrame, answer: Callable[[list[list], list], list[list[bytes]]], columns: int, as_bytes: bool) -> DataFrame:
    """Run ``answer`` on each bucket: it gets the word lists (and packed counts) of all chunks and returns, for each
    list, ``columns`` packed columns. Result: ``chunk``, ``bucket``, ``a0``, ``a1``, ..."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()
        lists = [unpack_words(t, n, as_bytes) for t, n in zip(frame["words"], frame["lengths"])]
        out = answer(lists, list(frame["counts"]))
        made = {"chunk": frame["chunk"], "bucket": frame["bucket"]}
        return pd.DataFrame(made | {f"a{j}": [o[j] for o in out] for j in range(columns)})

    schema = "chunk binary, bucket int, " + ", ".join(f"a{j} binary" for j in range(columns))
    return dicts.groupBy("bucket").applyInPandas(run, schema)


def rejoined(body: DataFrame, answers: DataFrame, columns: int, finish, schema: str) -> DataFrame:
    """Bring the answers of a chunk's buckets to its body. ``finish(ids, sizes, numbers, answers)`` returns a frame:
    ``numbers`` are word numbers by position, ``answers[j]`` the list of column j's values of all buckets in order, which
    laid end to end are in order of word number."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            raise RuntimeError("answers for a chunk that no pass over the documents has made again")
        right = right.drop_duplicates("bucket").sort_values("bucket")  # equal chunks have equal answers
        got = [list(right[f"a{j}"]) for j in range(columns)]
        out = []
        for row in left.itertuples(index=False):
            places = unpack(row.places)
            if len(places) and right.empty:
                raise RuntimeError("a chunk without its answers")
            out.append(finish(list(row.ids), unpack(row.sizes), places[unpack(row.numbers)], got))
        return pd.concat(out, ignore_index=True)

    return body.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, schema)
