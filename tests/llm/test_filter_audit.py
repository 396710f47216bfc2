"""The filter audit against a plain count over every document, order and step."""
from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb

from llm.edge import ROWS, frame
from stockgrid.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, QUALITY string"


def plain(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    ids = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            ids[t or ""].add(i)
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and min(ids[t]) < i}
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(mine)
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                    sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley"))
            for r in df.collect()}


def test_counts_equal_a_plain_walk(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = ROWS + [(20, long, "en", "a"), (21, long, "fr", "a"), (22, long + " #", "en", "a"), (23, long.upper(), "", "a"),
                   (20, long, "en", "a"), (None, long, None, "a"), (19, long, "de", "a"), (24, "a b " * 200, "en", "a")]
    labels = [(20, 1, 0), (20, 0, 1), (2, 1, 1), (None, 1, 1), (9, None, 1), (24, 1, None), (77, 1, 1)]
    frame_l = spark.createDataFrame([(*x, "clash") for x in labels], LABELS.replace("QUALITY", "more"))
    got = result(filter_audit.filter_audit(frame(spark, rows), frame_l))
    assert got == plain(rows, labels) and len(got) == 600 * len({r[2] or "" for r in rows})


def test_sql_and_hot_copies(spark):
    rows = [(i, "the same text " * 80 if i % 3 else f"{'x ' * (i % 250)}{i}", ["en", "de", None][i % 3], "a") for i in range(900)]
    labels = [(i, i % 2, i % 5 == 0 and 1 or 0) for i in range(0, 900, 4)]
    got = result(filter_audit.filter_audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [r[:3] for r in rows])
    con.execute("create table labels(doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", labels)
    assert got == {r[:3]: r[3:] for r in con.execute(filter_audit.AUDIT_SQL).fetchall()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(frame(spark, []), none).collect() == []
    assert len(filter_audit.filter_audit(frame(spark), none).collect()) == 600 * len({r[2] or "" for r in ROWS})
