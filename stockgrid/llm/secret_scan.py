"""Secret scans: patterns find the parts of credentials, an interval join links complementary parts.

Parts (code point spans, end exclusive), found in every whole text, leftmost and non-overlapping per kind:

* base kinds, always reported: ``assign`` (a secret assigned to a telling name), ``access`` (AKIA identifiers), ``hex``;
* weak kinds, reported only when a complementary part lies in the same scope: ``ident`` (user or client names, other
  access identifiers), ``opaque`` (long mixed-class tokens), ``endpoint`` (URLs, host assignments, IPv4 addresses),
  ``token`` (other long tokens: upper-case hex, base32, base36, long words). What base spans cover of a weak span is cut
  out of it; each rest that has a letter or digit is a part.

Roles are identifier (access, ident), secret (assign, hex, opaque), token and endpoint. Secrets complement identifiers and
endpoints; tokens, which may be plain words or paths, only identifiers that they don't overlap. Two parts are linked if
at most ``scope`` code points lie between them. The join is on (document, cell), a
cell being ``scope`` code points of the text, so a key has a bounded number of parts however long the text is or however
many parts it has; nothing is capped.

Null or empty texts have no parts (counts 0, empty spans). Rows are told apart by doc_id and text hash: repeated rows
give equal results, one row each. Empty table: no rows. Other columns are never read, except by ``mask``.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from stockgrid.llm.common import documents, position, slices, small_batches, stored

KINDS = ["assign", "access", "hex", "ident", "opaque", "endpoint", "token"]
BASE = 3
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "opaque": "secret",
        "endpoint": "endpoint", "token": "token"}
SCOPE = 240


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _names(*names: str) -> str:
    return "(?:" + "|".join(re.sub(r"[a-z]+", lambda m: _either_case(m.group()), n) for n in names) + ")"


SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = re.compile(_names("password", "passwd", "secret", "token", "api_?key") + SET + r"([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")   # as AKIA[A-Z0-9]+ of 20 characters or more: runs are maximal either way
HEX = re.compile(r"[0-9a-f]{24,}")          # as [0-9a-f]+ of 24 characters or more
IDENT = re.compile(_names("username", "user", "login", "client_?id", "account", "access_?key(?:_?id)?") + SET
                   + r"[A-Za-z0-9+/_.@=-]{3,}|\bA(?:SIA|ROA|IDA)[A-Z0-9]{16,}")
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]{4,}|" + _names("endpoint", "host(?:name)?", "server", "url")
                      + SET + r"[A-Za-z0-9.:/_-]{4,}|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b")
# A linear-time screen for texts that hold a base part, or an unlinked token that needs a closer look.
SCREEN = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|A(?:SIA|ROA|IDA)[A-Z0-9]{16}|[A-Za-z0-9+/_-]{20}"

Part = tuple[int, int, int]  # kind, start, end


def base_parts(text: str) -> list[Part]:
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(1, *m.span()) for m in ACCESS.finditer(text)] + [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda p: (p[1], p[0]))


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def weak_parts(text: str, base: list[Part]) -> list[Part]:
    """Weak candidates. Without a secret, base or opaque, or a token and an identifier, none can have a complement that
    matters."""
    long = [(4 if _mixed(m.group()) else 6, *m.span()) for m in OPAQUE.finditer(text) if _has_value(m.group())]
    if not long and not base:
        return []
    ident = [(3, *m.span()) for m in IDENT.finditer(text)]
    if not ident and not any(k == 1 for k, *_ in base):
        long = [p for p in long if p[0] == 4]
        if not long and not base:
            return []
    weak = ident + long + [(5, *m.span()) for m in ENDPOINT.finditer(text)]
    return list(_cut_out(text, weak, base)) if base else weak


def _has_value(span: str) -> bool:
    return any(c.isalnum() for c in span)


def _cut_out(text: str, weak: list[Part], base: list[Part]) -> Iterator[Part]:
    """What is left of weak spans outside base spans (which come by start)."""
    merged: list[list[int]] = []
    for _, a, b in base:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    for kind, a, b in weak:
        i = max(0, bisect_right(starts, a) - 1)
        rest = []
        while i < len(merged) and merged[i][0] < b:
            if merged[i][1] > a:
                rest.append((a, merged[i][0]))
                a = merged[i][1]
            i += 1
        for x, y in [*rest, (a, b)]:
            if x < y and (not rest or _has_value(text[x:y])):
                yield kind, x, y


def parts(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: ``doc_id``, ``text_hash``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and
    ``parts`` (array of kind, start, end; kind is an index into ``KINDS``)."""
    d = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    nothing = (0, 0, 0, hashlib.sha256(b"").hexdigest(), [])
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(kind)]
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "parts"]

    def scan(text: str) -> tuple:
        base = base_parts(text)
        digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        found = [{"kind": k, "start": a, "end": b} for k, a, b in [*base, *weak_parts(text, base)]]
        return (*[sum(k == i for k, *_ in base) for i in range(BASE)], digest, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text = part.column("text")
            rows = [nothing] * len(part)
            hits = np.flatnonzero(pc.match_substring_regex(text, SCREEN).to_numpy(zero_copy_only=False))
            for i, t in zip(hits, text.take(pa.array(hits)).to_pylist()):
                rows[i] = scan(t)
            cols = [pa.array([r[j] for r in rows], types[j]) for j in range(len(types))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *cols],
                                             names=["doc_id", "text_hash", *names])

    return d.mapInArrow(run, "doc_id long, text_hash long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                             "parts array<struct<kind:int,start:long,end:long>>")


def links(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Interval join of complementary parts: ``doc_id``, ``text_hash``, the secret's and the other part's kind and span,
    and ``gap``, the code points between them (0 if they touch or overlap)."""
    roles = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    each = found.select("doc_id", "text_hash", F.explode("parts").alias("p")).select("doc_id", "text_hash", "p.*").distinct()
    each = each.withColumn("role", roles[F.col("kind")])
    cell = lambda c: F.floor(c / F.lit(scope))
    reach = F.sequence(cell(F.greatest(F.col("start") - scope, F.lit(0))), cell(F.col("end") + scope))
    secrets = each.where("role in ('secret', 'token')").select(
        F.col("role").alias("secret_role"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("kind").alias("secret_kind"),
        F.col("start").alias("secret_start"), F.col("end").alias("secret_end"), F.explode(reach).alias("c"))
    others = each.where("role in ('identifier', 'endpoint')").withColumn("c", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    gap = F.greatest(F.col("secret_start") - F.col("end"), F.col("start") - F.col("secret_end"), F.lit(0))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    apart = (F.col("secret_start") >= F.col("end")) | (F.col("start") >= F.col("secret_end"))
    fits = (F.col("secret_role") == "secret") | ((F.col("role") == "identifier") & apart)
    pairs = others.join(secrets, same & (others.c == secrets.c) & (gap <= scope) & fits).select(
        "doc_id", "text_hash", "secret_kind", "secret_start", "secret_end", "kind", "start", "end", gap.alias("gap"))
    return pairs.distinct()


def linked_weak(pairs: DataFrame) -> DataFrame:
    """The weak parts that occur in a link: ``doc_id``, ``text_hash``, ``kind``, ``start``, ``end``."""
    secret = pairs.select("doc_id", "text_hash", F.col("secret_kind").alias("kind"), F.col("secret_start").alias("start"),
                          F.col("secret_end").alias("end"))
    return secret.unionByName(pairs.select("doc_id", "text_hash", "kind", "start", "end")).where(
        F.col("kind") >= BASE).distinct()


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``parts`` with all reported spans (array ``found`` by start, then kind) in place of the candidates."""
    found = stored(parts(docs), "secret-parts")
    weak = linked_weak(links(found.where("size(parts) > 0"), scope)).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("weak")).select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "weak")  # a text's own parts: bounded by the text
    base = F.transform(F.filter("parts", lambda p: p.kind < BASE), lambda p: F.struct(p.start, p.kind, p.end))
    joined = found.join(weak, found.doc_id.eqNullSafe(weak.d) & (found.text_hash == weak.h), "left")
    whole = F.array_sort(F.concat(base, F.coalesce("weak", F.expr("array()").cast(
        "array<struct<start:long,kind:int,end:long>>"))))
    return joined.select("doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256", whole.alias("found"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """Contract query."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform("found", lambda p: F.concat_ws(
        ":", kinds[p.kind], p.start.cast("string"), p.end.cast("string"))), ",")
    return report(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))


@F.arrow_udf(StringType())
def _without(texts: pa.Array, starts: pa.Array, kinds: pa.Array, ends: pa.Array) -> pa.Array:
    """Texts with their spans (by start) replaced, in one walk from left to right; null where there are no spans."""
    out = []
    for text, spans in zip(texts, zip(starts.to_pylist(), kinds.to_pylist(), ends.to_pylist())):
        if spans[0] is None:
            out.append(None)
            continue
        text, at, pieces = text.as_py(), 0, []
        for start, kind, end in zip(*spans):
            if end > at:
                pieces += [text[at:max(at, start)], "<", KINDS[kind], ">"]
                at = end
        out.append("".join(pieces) + text[at:])
    return pa.array(out, pa.string())


def mask(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The rows of ``docs``, all columns, with every reported span of ``text`` replaced by ``<kind>`` and ``n_chars``,
    if there is such a column, counted anew. Null texts stay null; of overlapping spans each hides what is left of it.

    Only texts with spans go to a Python task, where each is walked once. The spans are stored first, so that Spark knows
    their size and broadcasts them while it is small; beyond that the join shuffles the texts."""
    names = docs.columns
    plain = small_batches(docs).toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{position(docs, 'text')}"
    plain = plain.withColumn("d_id", F.col(f"c{position(docs, 'doc_id')}").cast("long")).withColumn(
        "d_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    spans = report(docs, scope).where("size(found) > 0").select(
        F.coalesce("doc_id", F.lit(0)).alias("s_id"), F.col("doc_id").isNull().alias("s_none"), "text_hash", "found")
    spans = stored(spans.dropDuplicates(["s_id", "s_none", "text_hash"]), "secret-spans")
    same = (F.coalesce("d_id", F.lit(0)) == spans.s_id) & (plain.d_id.isNull() == spans.s_none) & (
        plain.d_hash == spans.text_hash)
    joined = plain.join(spans, same, "left")
    hidden = _without(F.when(F.col("found").isNotNull(), F.col(text)), "found.start", "found.kind", "found.end")
    joined = joined.withColumn(text, F.coalesce(hidden, F.col(text)))
    if (n := position(docs, "n_chars")) is not None:
        counted = F.length(F.col(text)).cast(docs.schema.fields[n].dataType)
        joined = joined.withColumn(f"c{n}", F.when(F.col("found").isNull(), F.col(f"c{n}")).otherwise(counted))
    return joined.select(*plain.columns[:len(names)]).toDF(*names)
