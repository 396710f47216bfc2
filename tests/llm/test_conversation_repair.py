"""Conversation repair against every edit sequence of short conversations, and in small segments."""
from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache
from itertools import product

from stockgrid.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, ROLE_ string, n long, cost double"
LEGAL = re.compile(r"(s?(ua)+)?")


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5, 0.5) for r in rows], SCHEMA)


def damage(rows):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        mine = out.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(t, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(m, key=lambda r: (r[0] is not None, r[0] or 0, f"{r[1]}:{r[2]}", r[1])) for c, m in out.items()}


@cache
def all_inserts():
    return [""] + ["I" * k for k in (1, 2, 3)]


def brute(rows):
    """Of all sequences with up to three Inserts in every place the cheapest, ASCII-least one."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen
                      else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    for edits in product("DKR", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits)):
            continue
        for gaps in product(all_inserts(), repeat=len(rows) + 1):
            letters = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:]))
            cost = sum({"D": 3, "I": 2, "K": 0, "R": 2}[x] for x in letters)
            cost += sum(f == "truncated" and e != "D" for f, e in zip(faults, edits))
            if best is not None and (cost, letters) >= best[:2]:
                continue
            # every choice of roles for I and R
            it, free = iter(rows), []
            for x in letters:
                row = None if x == "I" else next(it)
                if x == "K":
                    free.append([f"{row[1]}:{row[2]}"])
                elif x != "D":
                    free.append([f"{r}:{row[2] if row else ''}" for r in ("user", "assistant")])
            good = [lines for lines in product(*free) if LEGAL.fullmatch("".join(x.partition(":")[0][:1] or "-" for x in lines))]
            if good:
                best = (cost, letters, good[0])
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1],
            hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def result(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
            for r in df.collect()}


def some_rows(seed, n, most):
    rng, out = random.Random(seed), []
    for c in range(n):
        for _ in range(rng.randint(1, most)):
            out.append((c, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]),
                        rng.choice(["Yes.", "No!", "cut", "  \n", "", None, "One. two? \t", "été \U0001f600", "half\nline"])))
    return out + [(None, 1, "user", "Hi."), (None, 2, "assistant", "cut"), (10 ** 6, 3, "system", "Be kind.")]


def test_every_sequence_of_short_conversations(spark):
    rows = some_rows(1, 60, 3)
    got = result(cr.conversation_repair(table(spark, rows)))
    assert got == {c: brute(m) for c, m in damage(rows).items()}


def test_segments_give_the_same(spark):
    rows = some_rows(2, 40, 9)
    damaged = cr.damaged(table(spark, rows))
    want = result(cr.repair_rows(damaged))
    assert set(want) == set(damage(rows))
    for k in (1, 2, 5):
        assert result(cr.repair_rows(damaged, segment_rows=k)) == want


def test_hot_conversation_and_hot_row(spark):
    rng = random.Random(5)
    hot = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Text {t}.", f"cut {t}", " "])) for t in range(3000)]
    hot += [(1, 77, "user", "Same.")] * 500 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    damaged = cr.damaged(table(spark, hot))
    small = result(cr.repair_rows(damaged, segment_rows=200))
    assert small == result(cr.repair_rows(damaged, segment_rows=10 ** 6))
    rows = damage(hot)[1]
    assert len(small[1][6].replace("I", "")) == len(rows) and small[1][1] == sum(not r[2].strip() for r in rows)


def test_open_ends_keep_every_possible_least():
    """Chained segments against whole rows, where one segment's repair is a prefix of another's."""
    rng = random.Random(9)
    for _ in range(300):
        rows = [{"turn": i, "role": rng.choice(["user", "assistant", "system", "x"]), "text": "t", "n": rng.choice([1, 1, 2]),
                 "blank": False, "must_go": rng.random() < 0.2, "truncated": rng.random() < 0.3} for i in range(rng.randint(1, 12))]
        for r in rows:
            r["truncated"] &= not r["must_go"]
        cut = sorted(rng.choices(range(len(rows) + 1), k=3))
        parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])]
        cost, steps = cr.chain([cr.transfers(p) for p in parts])
        assert (cost, "".join(x for _, x in steps)) == cr.repair(rows)
        assert [x for p, (s, y) in zip(parts, steps) for x in cr.replay(p, s, y)] == list(cr.replay(rows, 0, cr.repair(rows)[1]))


def test_empty_and_fully_dropped(spark):
    assert cr.conversation_repair(table(spark, [])).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert result(cr.conversation_repair(table(spark, [(gone, 0, "user", "Hi.")]))) == {gone: empty}


def test_very_long_text(spark):
    c = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    rows = [(c, 0, "user", "word " * 400_000 + "."), (c, 1, "assistant", "x" * 1_000_000)]
    got = result(cr.conversation_repair(table(spark, rows)))
    lines = "\n".join(f"{r[2]}:{r[3]}" for r in rows)
    assert got == {c: (0, 0, 0, 1, 0, 1, "KK", hashlib.sha256(lines.encode()).hexdigest())}
