"""Conversation structure repair: the cheapest edits that make a conversation's roles follow ``(s?(ua)+)?``.

Edits are Keep (0), Rerole to user or assistant (2), Delete (3) and Insert of an empty-text user or assistant (2); a
truncated row that stays adds 1. A state of the role order fixes the role of every Insert and Rerole, so an edit sequence
is its initials, the audit. A sequence's weight is one integer: its high digits are the cost, its low digits the audit,
one hexadecimal digit a letter (D < I < K < R as 1 to 4) from the most significant place of a fixed width on, with zeros
behind its end. The smaller integer is the cheaper repair or, of equal cost, the ASCII-least audit, so the plain minimum
over a DAG of (row, state) from the last row back decides everything.

Rows are taken by turn, nulls first; rows of one turn by their ``role:text``, then by role. Equal rows of a turn are counted
before any shuffle, and the rows are dealt by ranges of that order. A task solves every conversation that lies inside its
range at once. A conversation that crosses ranges or has over ``SEGMENT_ROWS`` rows (or ``SEGMENT_BYTES`` of text) is cut in
segments: each gives, for every pair of states, the weights that no continuation can make worse than another (the least
weight, and those it is a prefix of); those are chained per conversation, and the segments are repaired in parallel. What
one task must see of one conversation is what the result row holds: its audit, and its repaired text as a stream, since
SHA-256 reads it in order.

Defined results: null role and text are one space; a null ``conv_id`` is a conversation of its own, and null ids and turns
count as one space in the text that decides the damage. Role initials are the first code point, so ``User`` is neither user
nor assistant. A role of no character makes every adjacent pair illegal. An empty table gives no rows. Further columns play
no part.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from stockgrid.llm.common import give_back, pick, slices, small_batches, stored

SEGMENT_ROWS, SEGMENT_BYTES = 1000, 8_000_000

REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SPACE = " \t\n\x0b\f\r"

# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; conversations may end in 0 and 3
START, ENDS = 0, (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FORCED = {0: "user", 1: "user", 2: "assistant", 3: "user"}  # the role of an Insert or Rerole
AFTER = {q: NEXT[q, FORCED[q][0]] for q in FORCED}
LETTERS, COSTS = {"D": 1, "I": 2, "K": 3, "R": 4}, {"D": 3, "I": 2, "K": 0, "R": 2}


class Weights:
    """Weights of edit sequences with at most ``width`` letters: (integer, number of letters)."""

    def __init__(self, width: int):
        self.bits = 4 * width
        self.mask = (1 << self.bits) - 1
        self.digits: dict[str, int] = {}

    def put(self, letters: str, cost: int, rest: tuple[int, int]) -> tuple[int, int]:
        """``letters`` at ``cost`` before the sequence ``rest``: its digits move down by as many places."""
        weight, n = rest
        if letters not in self.digits:
            self.digits[letters] = int("".join(str(LETTERS[x]) for x in letters), 16)
        m = len(letters)
        low = (self.digits[letters] << (self.bits - 4 * m)) | ((weight & self.mask) >> (4 * m))
        return (((weight >> self.bits) + cost) << self.bits) | low, n + m

    def read(self, entry: tuple[int, int]) -> tuple[int, str]:
        weight, n = entry
        text = f"{(weight & self.mask) >> (self.bits - 4 * n):0{n}x}" if n else ""
        return weight >> self.bits, text.translate({ord(str(v)): k for k, v in LETTERS.items()})

    def open_ended(self, entries: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Those that may be least when something follows: the least, and equally cheap ones that it is a prefix of (and
        so on); any other stays larger whatever follows."""
        entries = sorted(set(entries), key=lambda e: (e[0], e[1]))
        kept = entries[:1]
        for e in entries[1:]:
            w, n = kept[-1]
            if e[0] >> (self.bits - 4 * n) != w >> (self.bits - 4 * n):
                break  # of higher cost, or apart from the least within its letters; so are all behind it
            kept.append(e)
        return kept


def row_edits(row: dict, state: int) -> Iterator[tuple[str, int, int]]:
    """(letters, cost, next state) of what can be done with a row and its ``n - 1`` copies, which must go."""
    more = row["n"] - 1
    yield "D" * row["n"], 3 * row["n"], state
    if row["must_go"]:
        return
    extra = 3 * more + (1 if row["truncated"] else 0)
    kept = NEXT.get((state, row["role"][:1]))
    if kept is not None:
        yield "K" + "D" * more, extra, kept
    yield "R" + "D" * more, 2 + extra, AFTER[state]


def solve(rows: list[dict], w: Weights, end: dict[int, list[tuple[int, int]]], least, insert_at_end: bool) -> dict:
    """For every state before ``rows`` the least weights up to the end, whose weights by state are ``end``."""
    best = with_inserts(end, w, least) if insert_at_end else end
    for row in reversed(rows):
        found = {}
        for q in range(4):
            options = [w.put(x, c, e) for x, c, to in row_edits(row, q) for e in best.get(to, ())]
            if options:
                found[q] = least(options)
        best = with_inserts(found, w, least)
    return best


def with_inserts(best: dict, w: Weights, least) -> dict:
    """Up to two Inserts before; a third would come back to a state already passed."""
    out = {}
    for q in range(4):
        one, two = AFTER[q], AFTER[AFTER[q]]
        options = (list(best.get(q, ())) + [w.put("I", 2, e) for e in best.get(one, ())]
                   + [w.put("II", 4, e) for e in best.get(two, ())])
        if options:
            out[q] = least(options)
    return out


def width_of(rows: list[dict]) -> int:
    return sum(r["n"] for r in rows) + 2 * len(rows) + 2


def repair(rows: list[dict]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    w = Weights(width_of(rows))
    return w.read(solve(rows, w, {q: [(0, 0)] for q in ENDS}, lambda e: [min(e)], True)[START][0])


def transfers(rows: list[dict]) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, letters) that the rest of a conversation may need of a segment."""
    w = Weights(width_of(rows))
    out = []
    for t in range(4):
        for s, entries in solve(rows, w, {t: [(0, 0)]}, w.open_ended, False).items():
            out += [(s, t, *w.read(e)) for e in entries]
    return out


def chain(segments: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """The cost of a conversation in segments, and (state before, letters) of each segment."""
    w = Weights(sum(max(len(x) for *_, x in s) for s in segments) + 2)
    best = with_inserts({q: [(0, 0)] for q in ENDS}, w, lambda e: [min(e)])
    tail = {q: w.read(best[q][0])[1] for q in best}  # Inserts behind the last row
    steps = []
    for segment in reversed(segments):
        found: dict[int, list] = {}
        for s, t, cost, letters in segment:
            if t in best:
                new = (*w.put(letters, cost, best[t][0]), t, letters) if letters else (*best[t][0], t, letters)
                if s not in found or new[0] < found[s][0]:
                    found[s] = new
        steps.append(found)
        best = {s: [new[:2]] for s, new in found.items()}
    state, out = START, []
    for found in reversed(steps):
        _, _, t, letters = found[state]
        out.append((state, letters))
        state = t
    out[-1] = (out[-1][0], out[-1][1] + tail[state])
    return w.read(best[START][0])[0], out


def replay(rows: Iterable[dict], state: int, letters: str) -> Iterator[str]:
    """The repaired ``role:text`` lines."""
    copies = (r for r in rows for _ in range(r["n"]))
    for x in letters:
        row = None if x == "I" else next(copies)
        if x == "D":
            continue
        role = row["role"] if x == "K" else FORCED[state]
        yield f"{role}:{'' if row is None else row['text']}"
        state = NEXT[state, role[:1]]


def tally(rows: list[dict]) -> dict:
    """What a conversation's counts need of a run of its rows."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "lo": None, "hi": None,
           "first": None, "last": None}
    for r in rows:
        out["blank"] += r["n"] if r["blank"] else 0
        out["duplicate"] += 0 if r["blank"] else r["n"] if r["must_go"] else r["n"] - 1
        out["truncated"] += r["truncated"]
        one = r["role"][:1]
        out["illegal"] += r["n"] - 1 + (out["first"] is not None and out["last"] + one not in ("su", "ua", "au"))
        out["first"], out["last"] = one if out["first"] is None else out["first"], one
        if r["turn"] is not None:
            out["turns"] += r["turn"] != out["hi"]
            out["lo"], out["hi"] = r["turn"] if out["lo"] is None else out["lo"], r["turn"]
    return out


def merged(a: dict, b: dict) -> dict:
    """The tally of two adjacent runs, of ``a`` first."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    if a["first"] is not None and b["first"] is not None:
        out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    if a["hi"] is not None and a["hi"] == b["lo"]:
        out["turns"] -= 1
    out["first"] = b["first"] if a["first"] is None else a["first"]
    out["last"] = a["last"] if b["first"] is None else b["last"]
    out["lo"] = b["lo"] if a["lo"] is None else a["lo"]
    out["hi"] = a["hi"] if b["hi"] is None else b["hi"]
    return out


def gaps(t: dict) -> int:
    return 0 if t["lo"] is None else t["hi"] - t["lo"] + 1 - t["turns"]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: each row after damage with its number of copies (0: a dropped row, kept as a mark
    of its conversation)."""
    c = pick(conversations, "conv_id", "turn", "role", "text")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = c.withColumn("kind", F.crc32(name.cast("binary")) % 20)
    kind, gone = F.col("kind"), F.col("kind") == 0
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return c.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(~gone, F.col("turn").cast("long")).alias("turn"),
        F.when(gone, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(gone | (kind == 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(gone, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (as of ``damaged``) with equal rows counted together and ``blank``, ``must_go``, ``truncated``."""
    digest = F.unhex(F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256))
    # role and text that come at several turns of a conversation, with their first turn
    twice = rows.where("n > 0").select(digest.alias("digest"), "turn").groupBy("digest").agg(
        F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.max(F.col("turn").isNull()).alias("has_null")).where(
        "lo < hi OR (has_null AND hi IS NOT NULL)").select(
        F.col("digest").alias("seen"), F.when(~F.col("has_null"), F.col("lo")).alias("first_turn"))
    # written first, so that the join below deals both sides anew and AQE can split a hot digest
    twice = stored(twice, "repair-twice")
    body = F.rtrim("text", F.lit(_SPACE))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    found = counted.withColumn("digest", digest).join(twice, F.col("digest") == F.col("seen"), "left")
    found = found.withColumn("blank", body == "").withColumn(
        "must_go", F.col("blank") | (F.col("seen").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))))
    return found.select("conv_id", "turn", "role", "text", "n", "blank", "must_go", (
        ~F.col("must_go") & ~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"))


PASS = ("conv_id long, part int, seq int, tally string, cost long, audit string, sha string, transfers string, "
        "rows array<struct<turn long, role string, text string, n long, blank boolean, must_go boolean, truncated boolean>>")
_FIELDS = ["turn", "role", "text", "n", "blank", "must_go", "truncated"]


def _types():
    import pyarrow as pa
    row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()),
                     ("blank", pa.bool_()), ("must_go", pa.bool_()), ("truncated", pa.bool_())])
    return pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("tally", pa.string()),
                      ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()), ("transfers", pa.string()),
                      ("rows", pa.list_(row))])


def _segments(batches, segment_rows: int, segment_bytes: int):
    """(conv_id, part, rows, begins, ends) of sorted Arrow batches: runs of one conversation; ``ends`` is None at the end
    of the partition, where the conversation may go on elsewhere."""
    part = conv = None
    rows, size, begins, any_row = [], 0, False, False
    for batch in slices(batches):
        for r in batch.to_pylist():
            if any_row and r["conv_id"] != conv:
                yield conv, part, rows, begins, True
                rows, size, begins = [], 0, True
            elif any_row and (len(rows) >= segment_rows or size >= segment_bytes):
                yield conv, part, rows, begins, False
                rows, size, begins = [], 0, False
            conv, part, any_row = r["conv_id"], r["part"], True
            if r["n"]:
                rows.append({k: r[k] for k in _FIELDS})
                size += len(r["text"]) + len(r["role"])
    if any_row:
        yield conv, part, rows, begins, None


def passes(rows: DataFrame, segment_rows: int, segment_bytes: int) -> DataFrame:
    """A row for each conversation that lies inside a range, with its result, and for each segment of the others."""
    line = F.concat("role", F.lit(":"), "text")
    ranged = rows.withColumn("line", F.substring(line, 1, 80)).repartitionByRange("conv_id", "turn", "line").withColumn(
        "part", F.spark_partition_id()).sortWithinPartitions("conv_id", "turn", line, "role").select("part", "conv_id", *_FIELDS)

    def run(batches):
        import pyarrow as pa
        schema, out, held = _types(), [], 0
        for seq, (conv, part, run_, begins, ends) in enumerate(_segments(batches, segment_rows, segment_bytes)):
            row = dict.fromkeys(schema.names) | {"conv_id": conv, "part": part, "seq": seq, "tally": json.dumps(tally(run_))}
            if begins and ends:
                row["cost"], row["audit"] = repair(run_)
                row["sha"] = hashlib.sha256("\n".join(replay(run_, START, row["audit"])).encode()).hexdigest()
            else:
                row["transfers"], row["rows"] = json.dumps(transfers(run_)), run_
                held += sum(len(r["text"]) for r in run_)
            out.append(row)
            if len(out) >= 1000 or held >= segment_bytes:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)
        give_back()

    return ranged.mapInArrow(run, PASS)


CHAINED = "part int, seq int, state int, letters string, place long, tally string, cost long"


def _chained(table):
    import pyarrow as pa
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    cost, steps = chain([json.loads(r["transfers"]) for r in rows])
    total = json.loads(rows[0]["tally"])
    for r in rows[1:]:
        total = merged(total, json.loads(r["tally"]))
    out = [{"part": r["part"], "seq": r["seq"], "state": s, "letters": x, "place": i,
            "tally": json.dumps(total) if i == 0 else None, "cost": cost if i == 0 else None}
           for i, (r, (s, x)) in enumerate(zip(rows, steps))]
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("state", pa.int32()),
                                                ("letters", pa.string()), ("place", pa.int64()), ("tally", pa.string()),
                                                ("cost", pa.int64())]))


def _pieces(batches):
    """The repaired lines of each segment as one string (null: no line)."""
    import pyarrow as pa
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            lines = list(replay(r["rows"], r["state"], r["letters"]))
            out.append("\n".join(lines) if lines else None)
        keep = ["conv_id", "place", "tally", "cost", "letters"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(out, pa.string())], names=keep + ["piece"])


def _joined(batches):
    """One row for each conversation from its segments, which come in order and are read as a stream."""
    import pyarrow as pa
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()),
                        ("repaired_sha256", pa.string())])
    row, audit, sha, lines = None, [], None, False
    for batch in batches:
        for r in batch.to_pylist():
            if r["place"] == 0:
                if row is not None:
                    yield _finish(row, audit, sha, schema)
                row, audit, sha, lines = r, [], hashlib.sha256(), False
            audit.append(r["letters"])
            if r["piece"] is not None:
                sha.update(("\n" if lines else "").encode() + r["piece"].encode())
                lines = True
    if row is not None:
        yield _finish(row, audit, sha, schema)


def _finish(row: dict, audit: list[str], sha, schema):
    import pyarrow as pa
    t = json.loads(row["tally"])
    return pa.RecordBatch.from_pylist([{
        "conv_id": row["conv_id"], "gaps": gaps(t), **{c: t[c] for c in COUNTS[1:-1]}, "cost": row["cost"],
        "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema)


def repair_rows(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The report for ``rows`` of (conv_id, turn, role, text, n)."""
    done = stored(passes(faults(small_batches(rows)), segment_rows, segment_bytes), "repair-passes")
    number = "long"
    t = F.from_json("tally", "blank long, duplicate long, truncated long, illegal long, turns long, lo long, hi long")
    whole = done.where("audit IS NOT NULL").withColumn("t", t).select(
        "conv_id", F.coalesce(F.col("t.hi") - F.col("t.lo") + 1 - F.col("t.turns"), F.lit(0)).cast(number).alias("gaps"),
        *[F.col(f"t.{c}").alias(c) for c in COUNTS[1:-1]], "cost", "audit", F.col("sha").alias("repaired_sha256"))
    cut = done.where("audit IS NULL")
    steps = cut.select("conv_id", "part", "seq", "tally", "transfers").groupBy("conv_id").applyInArrow(_chained, CHAINED)
    steps = stored(steps, "repair-steps")
    pieces = cut.select("conv_id", "part", "seq", "rows").join(steps, ["part", "seq"]).mapInArrow(
        _pieces, "conv_id long, place long, tally string, cost long, letters string, piece string")
    across = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_joined, REPORT)
    return whole.unionByName(across)


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of the damaged table."""
    return repair_rows(damaged(conversations))
