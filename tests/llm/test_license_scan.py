"""License scans against every block and template compared as sets."""
from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from llm.edge import LONG, frame, texts
from stockgrid.llm import license_scan

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text))


def blocks(n, block):
    step, at = block // 2, 0
    while True:
        yield at, min(at + block, n)
        if at + block >= n:
            return
        at += step


def brute(text, templates, threshold, block):
    w, out = words(text), Counter()
    for label, t in templates:
        need = set(words(t))
        for a, e in blocks(len(w), block) if w else ():
            got = len(need & set(w[a:e])) / len(need)
            if got >= threshold:
                out[label, a, e, round(got, 9)] += 1
    return out


def base(text):
    w = words(text)
    return [(i, label) for i in range(len(w)) for p, label in license_scan.PHRASES.items() if w[i:i + len(p.split())] == p.split()]


def some_texts(rng, templates, n=60):
    rows = []
    for i in range(n):
        out = [rng.choice(["the", "a", "of", "été", "x1", "work", "license", "by", "cc", "under"]) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(templates)[1].split()
            t = [x for x in t if rng.random() > 0.1]
            at = rng.randint(0, len(out))
            out[at:at] = [x.upper() if rng.random() < 0.3 else x for x in t]
        rows.append((i, rng.choice([" ", ", ", "\n", " - "]).join(out), "en", "a"))
    return rows


@pytest.mark.parametrize("threshold,block", [(0.85, 48), (0.5, 8), (1.0, 32), (0.34, 2)])
def test_pairs_equal_all_pairs(spark, threshold, block):
    rows = some_texts(random.Random(4), license_scan.TEMPLATES)
    found = Counter()
    templates = license_scan.default_templates(spark)
    for r in license_scan.find(frame(spark, rows), templates, threshold, block).collect():
        found[r["doc_id"], r["label"], r["first_word"], r["end_word"], round(r["containment"], 9)] += 1
    want = Counter()
    for i, t, *_ in rows:
        for k, n in brute(t, license_scan.TEMPLATES, threshold, block).items():
            want[(i, *k)] += n
    assert found == want and want


def test_report_on_edge_and_license_rows(spark):
    rows = [(i, t, "en", "a") for i, t in texts()] + some_texts(random.Random(6), license_scan.TEMPLATES, 30)
    rows += [(70, "Licensed under CC BY-NC 4.0. All rights\nreserved! CC BY", "en", "a"), (71, "cc by cc by general public license", "en", "a"),
             (72, "Der Hund mit der Katze, under the License", "de", "a"), (73, LONG + "Released under the MIT License.", "en", "a")]
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_blocks"))
                  for r in license_scan.license_scan(frame(spark, rows)).collect())
    want, scores = Counter(), {}
    for i, t, *_ in rows:
        places, near = base(t or ""), brute(t or "", license_scan.TEMPLATES, license_scan.THRESHOLD, license_scan.BLOCK)
        at, low = [a for a, _ in places], sorted({x for _, x in places})
        want[i, len(words(t or "")), len(at), min(at, default=None), max(at, default=None), ",".join(low),
             ",".join(sorted({*low, *[k[0] for k in near]})), sum(near.values())] += 1
        scores.setdefault(i, []).append(1.0 if low else max((k[3] for k in near), default=0.0))
    assert got == want
    for r in license_scan.license_scan(frame(spark, rows)).collect():
        assert any(math.isclose(r["score"], s, abs_tol=1e-8) for s in scores[r["doc_id"]])
    by_id = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert by_id[70]["labels"] == "cc-by,cc-by-nc,reserved" and by_id[72]["labels"] == "" and by_id[73]["labels"] == "mit"


def test_pieces_of_a_long_text(monkeypatch):
    text = "Alpha, bêta; CC BY gamma " * 50
    whole = license_scan.known_words(text, {b"cc": 0, b"by": 1})
    for size in (1, 7, 64):
        monkeypatch.setattr(license_scan, "PIECE", size)
        assert license_scan.known_words(text, {b"cc": 0, b"by": 1}) == whole
    assert whole[1] == len(words(text))


def test_templates_null_empty_and_too_many(spark, monkeypatch):
    templates = spark.createDataFrame([(None, "x y"), ("a", None), ("b", "  "), ("c", "one two"), ("c", "one two")], "label string, text string")
    docs = frame(spark, [(1, "one two", "en", "a")])
    assert [(r["label"], r["containment"]) for r in license_scan.find(docs, templates).collect()] == [("c", 1.0)]
    none = templates.where("false")
    assert license_scan.find(docs, none).collect() == []
    assert license_scan.license_scan(frame(spark, [])).collect() == []
    monkeypatch.setattr(license_scan, "MOST_WORDS", 1)
    with pytest.raises(ValueError, match="template table"):
        license_scan.find(docs, templates)
    with pytest.raises(ValueError, match="threshold"):
        license_scan.find(docs, none, threshold=0.0)
