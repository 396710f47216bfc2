"""Reconciliation from one stored copy of the sources and one table of keys.

Two jobs read them, each once, and give a row of metrics each:

* over the tagged source rows: the source totals, missing values per kind and column, and rows per required file;
* over the key table (one row per key of the sources or the master, with the grid's measures): the grid's totals and the
  counts of keys that lack a partner.

They run beside each other. The metrics hold a number per metric, kind, column and required file, so they are bounded by the
contracts and not by the data; as one local row they feed every report section, and the lists are read from the two tables.
Source and grid totals stay independent of each other: the first are sums over rows, the second over the finished grid.

The metrics are plain aggregates on purpose. Observed metrics of a job's earlier stages are added again when a lost executor
makes Spark repeat a task, and as they are evaluated row by row outside generated code they took 4.5 s at sf0.1 where this
aggregate over the stored rows takes 1.2 s.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.functions.exact import merged, states, total_sql, with_parts
from stockgrid.operators import grid as g
from stockgrid.operators import loading
from stockgrid.operators.aggregate import (
    CUSTOMER_ORDER_SUMS, KEY, ON_HAND_DATES, ON_HAND_SUMS, OPEN_ORDER_DATES, open_order_sums, unconfirmed,
)
from stockgrid.operators.quality import RECONCILED_METRICS, missing
from stockgrid.operators.target import TARGET_COLUMNS

FILE_COLUMNS = ("expected_plant", "observed_plant")  # of a row's file; null where the row came in no required file

_SOURCE = {f"source_{m}": f"CASE WHEN kind = '{kind}' THEN {col} END" for m, kind, col in RECONCILED_METRICS}
_GRID = {f"grid_{m}": f"CASE WHEN _active THEN {m} END" for m, _, _ in RECONCILED_METRICS}


@dataclass(frozen=True)
class Stored:
    """``rows``: the tagged sources; ``keys``: the key table; ``metrics``: one row; the contracts they were counted by."""

    rows: DataFrame
    keys: DataFrame
    metrics: DataFrame
    columns_by_kind: Mapping[str, Sequence[str]]
    required: Sequence[tuple[str, str]]


def _null_name(kind: str, column: str) -> str:
    return f"null_{kind}_{column}"


def source_metrics(rows: DataFrame, columns_by_kind: Mapping[str, Sequence[str]],
                   required: Sequence[tuple[str, str]]) -> DataFrame:
    """One row over the tagged rows (with ``FILE_COLUMNS``).

    Rows are first counted by kind and required plant (others count as null), so a row meets each column once and not once
    per kind, column and file; the few groups, bounded by the contracts, then give the one row."""
    numbers = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float")}
    wrong = F.col("observed_plant").isNotNull() & (F.col("observed_plant") != F.col("expected_plant"))
    columns = sorted({c for cs in columns_by_kind.values() for c in cs})
    kinds, plants = sorted({*columns_by_kind, *(k for k, _ in required)}), sorted({p for _, p in required})
    counts = with_parts(rows, _SOURCE).groupBy(
        F.when(F.col("kind").isin(kinds), F.col("kind")).alias("_kind"),
        F.when(F.col("expected_plant").isin(plants), F.col("expected_plant")).alias("_plant")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(wrong).alias("_wrong"),
        *[F.count_if(missing(c, c in numbers)).alias(f"_null_{c}") for c in columns], *states(_SOURCE))

    def total(c: str, of: Column | None = None) -> Column:
        return F.coalesce(F.sum(c if of is None else F.when(of, F.col(c))), F.lit(0).cast("long"))

    metrics = [total("_n").alias("n_rows"), *merged(_SOURCE)]
    for kind, own in columns_by_kind.items():
        metrics += [total(f"_null_{c}", F.col("_kind") == kind).alias(_null_name(kind, c)) for c in own]
    for kind, plant in required:
        of_file = (F.col("_kind") == kind) & (F.col("_plant") == plant)
        metrics += [total("_n", of_file).alias(f"rows_{kind}_{plant}"), total("_wrong", of_file).alias(f"wrong_{kind}_{plant}")]
    return counts.coalesce(1).agg(*metrics)


def key_table(rows: DataFrame, target: DataFrame, field_by_plant: dict[str, str] | None = None,
              pct: float = config.SAFETY_STOCK_PCT) -> DataFrame:
    """The grid's columns for every key of the sources or the master, with ``_active`` (the sources have it),
    ``_in_<kind>`` and ``_in_master``. One aggregation of the rows; the master joins on the same partitioning."""
    sums = ON_HAND_SUMS | CUSTOMER_ORDER_SUMS | open_order_sums(field_by_plant)
    agg = with_parts(rows, sums).groupBy(*KEY).agg(
        *states(sums), *[F.expr(e).alias(n) for n, e in (ON_HAND_DATES | OPEN_ORDER_DATES).items()],
        *[F.max(F.col("kind") == k).alias(f"_in_{k}") for k in config.KINDS])
    keyed = agg.selectExpr("*", *[f"{total_sql(n)} AS `{n}`" for n in sums], "true AS _active").withColumn(
        "Unconfirmed_Qty", unconfirmed())
    both = keyed.join(target.select(*TARGET_COLUMNS).withColumn("_in_master", F.lit(True)), KEY, "full")
    flags = ["_active", "_in_master", *[f"_in_{k}" for k in config.KINDS]]
    return g.finished(both, pct, extra=[F.coalesce(c, F.lit(False)).alias(c) for c in flags])


def key_metrics(keys: DataFrame) -> DataFrame:
    """One row over the key table."""
    active, known = F.col("_active"), F.col("_in_master")
    return with_parts(keys, _GRID).agg(
        F.count_if(active).alias("n_active"), F.count_if(active & ~known).alias("not_in_master"),
        F.count_if(known & ~active).alias("no_activity"), *states(_GRID),
        *[F.count_if(F.col(f"_in_{k}") & ~known).alias(f"unmatched_{k}") for k in config.KINDS])


def together(*jobs: Callable[[], object]) -> list:
    """Run independent jobs beside each other, as each alone may leave executors idle; the first error is raised."""
    out: list = [None] * len(jobs)

    def run(i: int) -> None:
        try:
            out[i] = jobs[i](), None
        except Exception as error:
            out[i] = None, error

    threads = [InheritableThread(target=run, args=(i,)) for i in range(len(jobs))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for _, error in out:
        if error is not None:
            raise error
    return [result for result, _ in out]


def store(rows: DataFrame, keys: DataFrame, columns_by_kind: Mapping[str, Sequence[str]],
          required: Sequence[tuple[str, str]]) -> Stored:
    """Take the metrics of ``rows`` and ``keys``. Both are read again for lists, so they should be stored tables; a caller
    that wants counts alone may pass the key table as a plan."""
    of_rows, of_keys = together(source_metrics(rows, columns_by_kind, required).first, key_metrics(keys).first)
    values = of_rows.asDict() | of_keys.asDict()
    schema = ", ".join(f"`{n}` {'double' if n.endswith('__far') else 'long'}" for n in values)
    metrics = rows.sparkSession.createDataFrame([tuple(values.values())], schema)
    return Stored(rows, keys, metrics, columns_by_kind, required)


def _inline(metrics: DataFrame, rows: list[dict[str, str]]) -> DataFrame:
    """One row of SQL expressions over the metrics row each."""
    structs = ", ".join("named_struct(" + ", ".join(f"'{k}', {e}" for k, e in r.items()) + ")" for r in rows)
    return metrics.selectExpr(f"inline(array({structs}))")


def grid(s: Stored) -> DataFrame:
    """E9 from the key table."""
    return s.keys.where("_active").select(*g.GRID_COLUMNS)


def variances(s: Stored) -> DataFrame:
    """K1: metric, source total, grid total and their difference, rounded to 6 places."""
    out = _inline(s.metrics, [{"metric": f"'{m}'", "source_total": total_sql(f"source_{m}"), "dashboard_total": total_sql(f"grid_{m}")}
                              for m, _, _ in RECONCILED_METRICS])
    return out.withColumn("variance", F.round(F.col("dashboard_total") - F.col("source_total"), 6))


def gate(s: Stored) -> DataFrame:
    """K2 from the metrics row alone."""
    from stockgrid.operators.quality import reconciliation_gate
    return reconciliation_gate(variances(s))


def null_counts(s: Stored) -> DataFrame:
    """D12 per kind and column."""
    return _inline(s.metrics, [{"kind": f"'{k}'", "column": f"'{c}'", "null_count": f"`{_null_name(k, c)}`"}
                               for k, cs in s.columns_by_kind.items() for c in cs])


def file_status(s: Stored) -> DataFrame:
    """A9 counts of every required file; a file without rows is missing."""
    status = (f"CASE WHEN n_rows = 0 THEN '{loading.STATUS_MISSING}' WHEN violating_rows > 0 THEN '{loading.STATUS_ERROR}' "
              f"ELSE '{loading.STATUS_VALID}' END")
    counts = _inline(s.metrics, [{"kind": f"'{k}'", "plant": f"'{p}'", "n_rows": f"`rows_{k}_{p}`", "violating_rows": f"`wrong_{k}_{p}`"}
                                 for k, p in s.required])
    return counts.selectExpr("kind", "plant", f"{status} AS status", "n_rows AS row_count", "violating_rows")


def violations(s: Stored) -> DataFrame:
    """A8 as rows: file, plant value and how many rows carry it; as many rows as there are wrong values."""
    return loading.violation_rows(s.rows.where("expected_plant IS NOT NULL"))


def status_with_values(s: Stored) -> DataFrame:
    """``file_status`` with the wrong plant values of a file in one text, as its audit line shows them."""
    values = violations(s).groupBy("kind", F.col("expected_plant").alias("plant")).agg(
        F.array_join(F.array_sort(F.collect_list("observed_plant")), ",").alias("violations"))
    error = F.concat(F.lit(loading.ERROR_PLANT_HEAD + "'"), F.array_join(F.split("violations", ","), "', '"),
                     F.lit("'" + loading.ERROR_PLANT_TAIL), F.col("plant"), F.lit("."))
    return file_status(s).join(values, ["kind", "plant"], "left").withColumn("error", error).withColumn(
        "violations", F.coalesce("violations", F.lit("")))


def unmatched_counts(s: Stored) -> DataFrame:
    return _inline(s.metrics, [{"kind": f"'{k}'", "n": f"`unmatched_{k}`"} for k in config.KINDS])


def unmatched(s: Stored) -> DataFrame:
    """(kind, key) pairs without a master row."""
    kinds = F.array(*[F.when(F.col(f"_in_{k}"), F.lit(k)) for k in config.KINDS])
    return s.keys.where("_active AND NOT _in_master").select(F.explode(F.array_compact(kinds)).alias("kind"), *KEY)


def not_in_master(s: Stored) -> DataFrame:
    """H2."""
    return s.keys.where("_active AND NOT _in_master").select(*KEY)


def no_activity(s: Stored) -> DataFrame:
    """H3."""
    return s.keys.where("_in_master AND NOT _active").select(*KEY)


def summary(s: Stored, duplicates: DataFrame) -> DataFrame:
    """K3 as (section, item, value) rows; ``duplicates`` is D11. All but the duplicates come from the metrics row."""
    def row(section: str, item: str, value: str) -> dict[str, str]:
        return {"section": f"'{section}'", "item": f"'{item}'", "value": f"CAST({value} AS DOUBLE)"}

    rows = []
    for k, p in s.required:
        rows += [row("row_count", f"{k}:{p}", f"`rows_{k}_{p}`"),
                 row("valid", f"{k}:{p}", f"CAST(`rows_{k}_{p}` > 0 AND `wrong_{k}_{p}` = 0 AS INT)"),
                 row("plant_violation_rows", f"{k}:{p}", f"IF(`rows_{k}_{p}` > 0, `wrong_{k}_{p}`, NULL)")]
    rows += [row("null_values", k, " + ".join(f"`{_null_name(k, c)}`" for c in cs)) for k, cs in s.columns_by_kind.items()]
    rows += [row("unmatched_keys", k, f"NULLIF(`unmatched_{k}`, 0)") for k in config.KINDS]
    rows += [row("keys_not_in_master", "all", "not_in_master"), row("master_keys_no_activity", "all", "no_activity")]
    sections = [_inline(s.metrics, rows).where("value IS NOT NULL"),  # no entry for absent files and complete kinds
                duplicates.selectExpr("'duplicate_rows'", "kind", "CAST(duplicate_rows AS DOUBLE)"),
                variances(s).selectExpr("'variance'", "metric", "variance"),
                gate(s).selectExpr("'gate'", "'passed'", "CAST(CAST(passed AS INT) AS DOUBLE)")]
    out = sections[0]
    for x in sections[1:]:
        out = out.union(x)
    return out


def unmatched_report(s: Stored) -> DataFrame:
    """Unmatched keys of each kind and master keys without activity, with the reason."""
    from stockgrid.operators.reports import REASON_MASTER, REASON_SOURCE
    sources = unmatched(s).select(F.col("kind").alias("Source"), *KEY, F.lit(REASON_SOURCE).alias("Reason"))
    return sources.unionByName(no_activity(s).select(F.lit("product_master").alias("Source"), *KEY, F.lit(REASON_MASTER).alias("Reason")))


def report(s: Stored, duplicates: DataFrame) -> DataFrame:
    """K3 whole, one row for every entry of the reconciliation report: files with status and row count, wrong plant values,
    duplicate rows, missing values per column, unmatched keys per kind, keys not in the master, master keys without
    activity, totals with their variances, and the gate."""
    none, text = "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)"

    def rows(df: DataFrame, section: str, source: str = text, plant: str = text, material: str = text, item: str = text,
             value: str = none, note: str = text) -> DataFrame:
        return df.selectExpr(f"'{section}' AS section", f"{source} AS source", f"{plant} AS plant", f"{material} AS material",
                             f"{item} AS item", f"CAST({value} AS DOUBLE) AS value", f"{note} AS note")

    parts = [
        rows(file_status(s), "file", "kind", "plant", value="row_count", note="status"),
        rows(violations(s), "plant_violation", "kind", "expected_plant", item="observed_plant", value="n_rows"),
        rows(duplicates, "duplicate_rows", "kind", value="duplicate_rows"),
        rows(null_counts(s), "missing_values", "kind", item="column", value="null_count"),
        rows(unmatched(s), "unmatched_key", "kind", "Plant", "Material"),
        rows(not_in_master(s), "not_in_master", plant="Plant", material="Material"),
        rows(no_activity(s), "no_activity", plant="Plant", material="Material"),
        rows(variances(s), "source_total", item="metric", value="source_total"),
        rows(variances(s), "dashboard_total", item="metric", value="dashboard_total"),
        rows(variances(s), "variance", item="metric", value="variance"),
        rows(gate(s), "gate", value="CAST(passed AS INT)", note="IF(passed, 'PASS', 'FAIL')"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
