"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Pre-tokens with their positions stay packed in chunks, every distinct pre-token of the corpus is encoded once in its
bucket, the ids join back by chunk and are reassembled by position (``dictionary``). Decoding joins each id with the
token-byte table, which is as large as the vocabulary and so is broadcast.

Null or empty texts: no tokens (digests of no bytes). Ids may be null or repeat: one row a row. A vocabulary that lacks a
needed single byte is an error. Empty table: no rows. Other columns are never read.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from stockgrid.llm.common import documents, split_count
from stockgrid.llm.dictionary import answered, bodies, dictionaries, merged, pack, rejoined, unpack

LONG = 400


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file, read on the driver (its path is the driver's)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def _class(prop: str, last: int) -> str:
    """The code points up to ``last`` of a Unicode property as the inside of a character class."""
    every = "".join(chr(c) for c in range(last + 1) if not 0xD800 <= c < 0xE000)
    spans = [(m.group()[0], m.group()[-1]) for m in regex.finditer(rf"\p{{{prop}}}+", every)]
    return "".join(f"\\U{ord(a):08x}-\\U{ord(b):08x}" for a, b in spans)


#: Largest code point of the texts that each written-out pattern serves: short classes match much faster.
PLANES = (0x7F, 0xFFFF, 0x10FFFF)


def splitters(pattern: str) -> list[str]:
    r"""The pre-token pattern with ``\p{L}``, ``\p{N}``, ``\s`` and ``\S`` written out as code point ranges, for each of
    ``PLANES``: the same matches as the original, at the speed of plain character classes."""
    out = []
    for last in PLANES:
        space, letter, number = _class("White_Space", last), _class("L", last), _class("N", last)
        p = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]")
        out.append(p.replace(r"\p{N}", f"[{number}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))
    return out


def pre_tokens(text: str, written: list[str]) -> list[str]:
    """The matches of the pattern in ``text``. Compiling happens once a process: re keeps compiled patterns."""
    plane = 0 if text.isascii() else 1 if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else 2
    return re.compile(written[plane]).findall(text)


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of least rank (leftmost of equals) until no pair is in the vocabulary."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return _encode_long(word, ranks)
    none = len(ranks) + (1 << 30)
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i:i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs over a linked list, for very long words."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i:i + 2]], i, i + 2) for i in range(n - 1) if word[i:i + 2] in ranks]
    heapq.heapify(heap)
    live = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not live[i] or j >= n or end[j] != stop or end[i] != j:
            continue
        live[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n:
                piece = word[a:end[after[a]]]
                if piece in ranks:
                    heapq.heappush(heap, (ranks[piece], a, end[after[a]]))
    return [ranks[word[i:end[i]]] for i in range(n) if live[i]]


def spread(offsets: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Indices of the items ``offsets[c] .. offsets[c] + lengths[c]`` for each c of ``chosen``, end to end."""
    n = lengths[chosen]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[chosen] - ends + n, n)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` digest for every row."""
    d = documents(docs)
    buckets = split_count(d)
    written = splitters(pattern)
    shared = d.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary: as large as its file

    def tokens(text: str) -> list[str]:
        return pre_tokens(text, written)

    def answer(lists: list[list[str]], _: list) -> list[list[bytes]]:
        at, numbers = merged(lists)
        table = shared.value
        ids = [encode_word(w.encode("utf-8", "surrogatepass"), table) for w in at]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.array([i for x in ids for i in x], np.int64)
        offsets = np.cumsum(lengths) - lengths
        return [[pack(lengths[ns]), pack(flat[spread(offsets, lengths, ns)])] for ns in numbers]

    def finish(names: list, sizes: np.ndarray, numbers: np.ndarray, got: list[list[bytes]]) -> pd.DataFrame:
        lengths, flat = (np.concatenate([np.zeros(0, np.int64), *map(unpack, column)]) for column in got)
        offsets = np.cumsum(lengths) - lengths
        by_id = token_bytes(shared.value)
        ids, decoded, ends = [], [], np.cumsum(sizes)
        for a, b in zip(ends - sizes, ends):
            own = flat[spread(offsets, lengths, numbers[a:b])]
            ids.append(own.astype("<u4").tobytes())
            decoded.append(hashlib.sha256(b"".join(map(by_id.__getitem__, own.tolist()))).hexdigest())
        return pd.DataFrame({"doc_id": pd.array(names, "Int64"), "n_tokens": [len(x) // 4 for x in ids], "ids": ids,
                             "decoded": decoded})

    answers = answered(dictionaries(d, tokens, buckets), answer, 2, as_bytes=False)
    return rejoined(bodies(d, tokens, buckets), answers, 2, finish, "doc_id long, n_tokens long, ids binary, decoded string")


_TABLES: dict[int, dict[int, bytes]] = {}


def token_bytes(ranks: dict[bytes, int]) -> dict[int, bytes]:
    """The token-byte table, made once a process for a vocabulary."""
    if id(ranks) not in _TABLES:
        _TABLES.clear()
        _TABLES[id(ranks)] = {r: b for b, r in ranks.items()}
    return _TABLES[id(ranks)]


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id`` and ``bytes`` for rows of ``doc_id`` and ``ids`` as ``encode`` gives them."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(frames):
        for frame in frames:
            by_id = token_bytes(shared.value)
            made = [b"".join(map(by_id.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "bytes": made})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, bytes binary")


def byte_bpe(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Contract query: digests of ids and of decoded bytes."""
    return encode(docs, ranks, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                               F.col("decoded").alias("decoded_sha256"))
