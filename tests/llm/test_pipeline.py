"""The pipeline's stages: columns, what goes and what stays."""
from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from llm.edge import frame

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_edge_rows(spark):
    docs = frame(spark).toDF(*COLUMNS, "a", "b", "c", "d").select(*COLUMNS)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        rows = [r.asDict() for r in docs.collect()]
        seen[name] = rows
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
            docs = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows],
                                         "doc_id long, text string, lang string, source string, n_chars long")
    identified = Counter(r["doc_id"] for r in seen["language_id"])
    assert not set(identified) & {3, 4, 6, 7} and identified[2] == 3 and identified[None] == 2
    single = Counter(r["doc_id"] for r in seen["simhash_near_dedup"])
    assert single[1] == 1 and single[2] == 1 and single[None] == 1
    assert len(seen["secret_scans"]) == len(seen["simhash_near_dedup"])
    assert not any("hunter22" in r["text"] for r in seen["secret_scans"])
    mixed = Counter((r["doc_id"], r["text"]) for r in seen["mix_sources"])
    done = Counter((r["doc_id"], r["decoded_sha256"]) for r in seen["byte_level_bpe"])
    assert done == Counter({(i, hashlib.sha256(t.encode()).hexdigest()): n for (i, t), n in mixed.items()})


def test_run_on_the_small_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.select("doc_id", "n_tokens").collect()
    assert 0 < len(rows) <= 400 and max(Counter(r["doc_id"] for r in rows).values()) <= 2


def test_mixed_language_documents_stay(spark):
    words = {"en": "the cat and the dog are in the house with the man", "de": "der hund und die katze sind in dem haus mit dem mann",
             "fr": "le chien et la souris sont dans la maison avec les enfants"}
    learn = [(100 + 10 * i + j, " ".join([t] * 5), g, "a", 0) for i, (g, t) in enumerate(words.items()) for j in range(10)]
    two, three = [" ".join(" ".join([words[g]] * 2) for g in some) for some in (("en", "de"), ("en", "de", "fr"))]
    rows = [(1, two, None, "a", 0), (2, three, None, "a", 0), (3, "in die la", None, "a", 0), (4, "12 - 34", None, "a", 0),
            (5, None, None, "a", 0)]
    docs = spark.createDataFrame(learn + rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.language_id(spark, docs, None).collect()}
    assert kept == {r[0]: r[1] for r in learn + rows[:3]}
