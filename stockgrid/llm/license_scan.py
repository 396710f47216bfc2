"""License scans: exact set-similarity join of text blocks with license templates.

A text's words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased) are cut into blocks of ``block`` words, each
starting half a block after the one before, so that any run of ``block / 2 + 1`` words lies whole in some block. A block
meets a template if it holds at least ``threshold`` of the template's distinct words. Every such pair is found:

* the templates' words are put in one global order, rarest first, by their occurrences in all texts (counted in Spark;
  ties by the word). Other words can't add to an overlap, so a block is the set of its template words;
* prefix filter: a template of n words that needs an overlap of m can only be met by a block that holds one of the
  template's first n - m + 1 words; those make an inverted index, which travels to the tasks;
* length filter: the block needs m template words in all;
* positional filter: if the first shared word is the i-th of the template and the j-th of the block, the overlap is at
  most 1 + min(n - i - 1, size - j - 1);
* pairs that pass are verified by their full overlap.

The template table is a parameter, not corpus data: it is read to the driver and may hold ``MOST_WORDS`` words; a larger
one raises (split it and union the results).

Defined results: a null or empty text has no words, no places, null first and last word, empty label strings and score 0.
Repeated rows and equal or null ids are scanned each by itself. An empty table gives no rows. Texts are read in pieces of
bounded size with the blocks carried over, so a long text needs no more memory than its template words. Further columns
play no part.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockgrid.llm.common import documents, pick, slices

THRESHOLD, BLOCK = 0.85, 48
MOST_WORDS = 1_000_000

# Fixed values of the contract: base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices that the public licenses and their stewards ask to be used, in lower case without punctuation.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("reserved", "copyright all rights reserved"),
]

HITS = "doc_id long, label string, template int, first_word long, end_word long, containment double"
REPORT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, n_blocks long")

_KEEP = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
PIECE = 1 << 22


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "label string, text string")


def word_runs(text: str) -> Iterable[list[bytes]]:
    """The text's words in order, in lists from pieces of about ``PIECE`` bytes."""
    data = text.encode("utf-8", "surrogatepass").translate(_KEEP)
    at = 0
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def known_words(text: str, rank: dict[bytes, int]) -> tuple[list[tuple[int, int]], int]:
    """(position, rank) of the words in ``rank``, and the number of all words."""
    hits, n = [], 0
    for run in word_runs(text):
        hits += [(n + i, rank[w]) for i, w in enumerate(run) if w in rank]
        n += len(run)
    return hits, n


def phrase_places(hits: list[tuple[int, int]], phrases: list[tuple[list[int], str]]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand one after the other."""
    out = []
    for k, (at, r) in enumerate(hits):
        for ranks, label in phrases:
            if r == ranks[0] and hits[k:k + len(ranks)] == [(at + i, x) for i, x in enumerate(ranks)]:
                out.append((at, label))
    return out


class Index:
    """Templates in the global word order with the inverted index of their prefixes."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], counts: dict[bytes, int], threshold: float,
                 further: Iterable[bytes] = ()):
        words = {w for _, t in templates for w in t} | set(further)
        self.rank = {w: i for i, w in enumerate(sorted(words, key=lambda w: (counts.get(w, 0), w)))}
        self.labels = [label for label, _ in templates]
        self.sets = [sorted({self.rank[w] for w in t}) for _, t in templates]
        # the smallest overlap m with m / n >= threshold
        self.need = [next(m for m in range(1, len(s) + 1) if m / len(s) >= threshold) if s else 0 for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (s, need) in enumerate(zip(self.sets, self.need)):
            for i, r in enumerate(s[:len(s) - need + 1] if s else []):
                self.prefix.setdefault(r, []).append((t, i))

    def matches(self, hits: list[tuple[int, int]], n_words: int, block: int) -> Iterable[tuple[int, int, int, float]]:
        """(template, first word, end word, containment) of every block that meets a template."""
        step = block // 2
        last = max(0, -(-(n_words - block) // step)) if n_words > block else 0
        starts = sorted({b for at, r in hits if r in self.prefix
                         for b in range(max(0, (at - block) // step + 1), min(last, at // step) + 1)})
        lo = 0
        for b in starts:
            first, end = b * step, min(b * step + block, n_words)
            while lo < len(hits) and hits[lo][0] < first:
                lo += 1
            hi = lo
            while hi < len(hits) and hits[hi][0] < end:
                hi += 1
            found = sorted({r for _, r in hits[lo:hi]})
            size, have, tried = len(found), set(found), set()
            for j, r in enumerate(found):
                for t, i in self.prefix.get(r, ()):
                    if t in tried:
                        continue
                    tried.add(t)  # r is the first word that the two share, as both are in the global order
                    need, n = self.need[t], len(self.sets[t])
                    if size < need or 1 + min(n - i - 1, size - j - 1) < need:
                        continue
                    overlap = sum(x in have for x in self.sets[t])
                    if overlap >= need:
                        yield t, first, end, overlap / n


def read_templates(templates: DataFrame) -> list[tuple[str, list[bytes]]]:
    rows = pick(templates, "label", "text").where("label is not null and text is not null").distinct()
    most = rows.limit(MOST_WORDS + 1).collect()
    out = sorted((r["label"], [w for run in word_runs(r["text"]) for w in run]) for r in most)
    if len(most) > MOST_WORDS or sum(len(t) for _, t in out) > MOST_WORDS:
        raise ValueError(f"the template table holds over {MOST_WORDS} words: split it and unite the results")
    return [(label, t) for label, t in out if t]


def build_index(docs: DataFrame, templates: DataFrame, threshold: float, further: Iterable[bytes] = ()) -> Index:
    """The index over the templates, ordered by how often their words occur in all of ``docs``. ``further`` words get a
    place in the order as well."""
    listed = read_templates(templates)
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in listed for w in t} | set(further)))}

    def count(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros(len(vocabulary), np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                hits, _ = known_words(text, vocabulary)
                total += np.bincount([r for _, r in hits], minlength=len(vocabulary)) if hits else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["word", "n"])

    counted = documents(docs).select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    names = list(vocabulary)
    counts = {names[r["word"]]: r["n"] for r in counted.collect()}  # a row a word of the vocabulary
    return Index(listed, counts, threshold, further)


def _checked(threshold: float, block: int) -> None:
    if not 0 < threshold <= 1 or block < 2 or block % 2:
        raise ValueError("the threshold lies in (0, 1] and a block has an even number of words")


def find(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """A row for every pair of a block and a template that it meets, with the block's words from ``first_word`` up to
    ``end_word``, not included."""
    _checked(threshold, block)
    index = build_index(docs, templates, threshold)

    def scan(batches):
        import pyarrow as pa
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                hits, n = known_words(text, index.rank)
                rows += [(doc_id, index.labels[t], t, a, e, c) for t, a, e, c in index.matches(hits, n, block)]
            yield _batch(rows, HITS, pa)

    return documents(docs).mapInArrow(scan, HITS)


def _batch(rows: list[tuple], schema: str, pa):
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, (_, k) in zip(columns, fields)],
                                      names=[n for n, _ in fields])


def license_scan(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD,
                 block: int = BLOCK) -> DataFrame:
    """One row for each document: base phrases, all labels, and the best containment (1 where a phrase stands)."""
    _checked(threshold, block)
    templates = default_templates(docs.sparkSession) if templates is None else templates
    index = build_index(docs, templates, threshold, {w.encode() for p in PHRASES for w in p.split()})
    phrases = [([index.rank[w.encode()] for w in p.split()], label) for p, label in PHRASES.items()]

    def scan(batches):
        import pyarrow as pa
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                hits, n = known_words(text, index.rank)
                places = phrase_places(hits, phrases)
                base = {label for _, label in places}
                labels, score, n_blocks = set(base), 1.0 if base else 0.0, 0
                for t, _, _, contained in index.matches(hits, n, block):
                    labels.add(index.labels[t])
                    score, n_blocks = max(score, contained), n_blocks + 1
                starts = [at for at, _ in places]
                rows.append((doc_id, n, len(places), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted(base)), ",".join(sorted(labels)), score, n_blocks))
            yield _batch(rows, REPORT, pa)

    return documents(docs).mapInArrow(scan, REPORT)
