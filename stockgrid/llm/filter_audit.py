"""Filter interaction audit: what each of five text filters removes in every order they can be applied in.

A document's failures are a five-bit mask, and what any order does to a document depends on its mask alone. So the corpus
is reduced to cells (part, mask, quality label, toxic label) with row counts, at most 128 a part, and only cells meet the
120 orders: a higher-order SQL fold over the array of orders turns a cell into 600 structs (order, step), weighted with
the cell's count, and the structs of a part's cells are added element by element.

Defined results: a null text is the empty text, a null ``lang`` the part ``''``. A null ``doc_id`` is no smaller and no
larger than any other, so such a row neither fails filter E nor makes another fail it, and no label belongs to it.
Equal ids with equal texts are separate documents of which none is smaller. A document is good (toxic) if any label row of
its id says ``quality`` (``toxic``) = 1. An empty table has no parts and gives no rows. Further columns play no part.
"""
from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window, functions as F

from stockgrid.llm.common import documents, pick

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]

_BIT = "shiftleft(1, ascii(letter) - 65)"
_FAILS = f"(cell.mask & {_BIT}) != 0"
# one order, left to right: `gone` is whether an earlier filter has removed the cell's documents
_ONE_ORDER = f"""
aggregate(split(ord, ''), named_struct('gone', false, 'steps', {{none}}),
  (acc, letter) -> named_struct(
    'gone', acc.gone OR {_FAILS},
    'steps', concat(acc.steps, array(named_struct(
      'kept', if(acc.gone OR {_FAILS}, 0L, cell.n),
      'removed', if({_FAILS} AND NOT acc.gone, cell.n, 0L),
      'redundant', if({_FAILS} AND acc.gone, cell.n, 0L),
      'unique_fails', if(cell.mask = {_BIT}, cell.n, 0L),
      'good_lost', if({_FAILS} AND NOT acc.gone AND cell.good, cell.n, 0L),
      'toxic_lost', if({_FAILS} AND NOT acc.gone AND cell.toxic, cell.n, 0L))))),
  acc -> acc.steps)"""
_TYPE = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
_ZERO = "named_struct(" + ", ".join(f"'{c}', 0L" for c in COUNTS) + ")"
_ADD = "named_struct(" + ", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS) + ")"
_ALL_ORDERS = f"flatten(transform(orders, ord -> {_ONE_ORDER.format(none=f'cast(array() as {_TYPE})')}))"
_MERGED = f"""
aggregate(cells, array_repeat({_ZERO}, 600),
  (acc, cell) -> zip_with(acc, {_ALL_ORDERS}, (x, y) -> {_ADD}))"""


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``key`` (digest of the text) and ``mask`` of filters A to D, a row for each document."""
    d = documents(docs, "lang").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    d = d.withColumn("words", words).withColumn("n_words", F.size("words").cast("long"))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [F.col("n_words") < 200,
             F.size(F.array_distinct("words")).cast("long") * 100 < F.col("n_words") * 50,
             capitals.cast("long") * 100 > F.length("text").cast("long") * 3,
             F.col("text").rlike(r"[#$%&*|]")]
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) with the number ``n`` of documents; bit 16 of the mask is filter E.

    Copies are counted before any shuffle by text. All copies of a text share filters A to D, so a text's documents come
    down to a row for each part and label pair, and only those meet in a window."""
    marks = pick(labels, "doc_id", "quality", "toxic").where(F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good OR toxic")
    distinct = failures(docs).groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("n"))
    # rows without an id meet no label; their text's digest spreads them over the join's tasks
    known = distinct.withColumn("join_id", F.coalesce("doc_id", F.xxhash64("key"))).withColumn(
        "has_id", F.col("doc_id").isNotNull()).join(marks.withColumn("known", F.lit(True)),
        (F.col("join_id") == F.col("label_id")) & (F.col("has_id") == F.col("known")), "left")
    classes = known.groupBy("key", "mask", "part", F.coalesce("good", F.lit(False)).alias("good"),
                            F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"))
    first = F.when(F.col("low.doc_id") == F.min("low.doc_id").over(Window.partitionBy("key")), F.col("low.n")).otherwise(0)
    split = classes.withColumn("n_first", F.col("n_null") + F.coalesce(first, F.lit(0).cast("long"))).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask"), F.col("n_first").alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("n_first")).alias("n")))).alias("c"))
    return split.where("c.n > 0").groupBy("part", F.col("c.mask").alias("mask"), "good", "toxic").agg(
        F.sum("c.n").alias("n"))


def audit(cells_: DataFrame) -> DataFrame:
    """A row for each (part, filter_order, step) of ``cells``."""
    folded = cells_.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    folded = folded.withColumn("orders", F.array(*[F.lit(o) for o in ORDERS])).withColumn("at", F.expr(_MERGED))
    steps = folded.select("part", "orders", F.posexplode("at").alias("pos", "c")).select(
        "part", F.expr("orders[pos div 5]").alias("filter_order"), (F.col("pos") % 5 + 1).cast("int").alias("step"),
        *[F.col(f"c.{c}").alias(c) for c in COUNTS])
    letter = F.expr("substring(filter_order, step, 1)")
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(cells(docs, labels))


AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY t) AS low FROM d
), f AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS dd, coalesce(low < doc_id, false) AS e FROM m
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), g AS (
  SELECT part, a, b, c, dd, e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS o
  FROM letters p JOIN letters q ON q.x <> p.x JOIN letters r ON r.x NOT IN (p.x, q.x)
  JOIN letters s ON s.x NOT IN (p.x, q.x, r.x) JOIN letters u ON u.x NOT IN (p.x, q.x, r.x, s.x)
), bad AS (
  SELECT g.*, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN dd THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM g
), s AS (
  SELECT part, o, k, substr(o, k, 1) AS letter, fails, n, good, toxic, contains(fails, substr(o, k, 1)) AS hit,
         length(translate(substr(o, 1, k - 1), fails, '')) < k - 1 AS gone
  FROM bad, orders, range(1, 6) AS steps(k)
), r AS (
  SELECT part, o AS filter_order, k::INTEGER AS step, letter,
         sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN hit AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN hit AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
