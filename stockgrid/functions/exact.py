"""Order-independent sums that lose no value.

Double addition depends on the order rows reach an aggregate, so a distributed total would drift with partitioning and
break the zero-variance gate. A quantity is split into three parts, each written as a column before the aggregation:

* ``far``: the multiple of 2^60 in it (0 for nearly all quantities, which is stored as null; infinities as they are);
* ``w``: the whole units of the rest; ``p``: the fraction of the rest in 2^-40 parts of a unit.

``w`` and ``p`` are summed as an upper part and a lower 20-bit part in 64-bit integers: exact, associative, in whole-stage
codegen with fixed-width buffers (a DECIMAL sum would carry a BigDecimal per row). Lower parts overflow only beyond 8.8e12
rows, upper ones only beyond totals of 9.6e24 units. ``far`` is summed as a double, which is exact for multiples of 2^60
while their total stays below 2^113 (1e34). The five sums are a *state* of fixed width: states of parts of the rows add up
to the state of all rows, so they can be stored per batch and merged later. A state is recombined once per group in
DECIMAL(38,6), so a total, not each value, is rounded to the six places of the variance. An infinite total makes a variance
that is no number, which fails the gate. NaN counts as missing.
"""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ("wu", "wl", "pu", "pl", "far")

# one SQL expression (parsed once on the JVM side, instead of a py4j call per expression node)
_LIMIT = "1152921504606846976D"  # 2^60
_REST = f"(CASE WHEN ABS({{x}}) < {_LIMIT} THEN {{x}} WHEN ABS({{x}}) < DOUBLE('Infinity') THEN {{x}} % {_LIMIT} END)"
_WHOLE = f"FLOOR({_REST})"
_PARTS = f"CAST(RINT(({_REST} - FLOOR({_REST})) * 1099511627776D) AS BIGINT)"
_FAR = (f"CASE WHEN ABS({{x}}) >= {_LIMIT} AND ABS({{x}}) < DOUBLE('Infinity') THEN {{x}} - {{x}} % {_LIMIT} "
        f"WHEN ABS({{x}}) = DOUBLE('Infinity') THEN {{x}} END")
_SUMS = {"wu": "SUM(SHIFTRIGHT({w}, 20))", "wl": "SUM({w} & 1048575)", "pu": "SUM(SHIFTRIGHT({p}, 20))",
         "pl": "SUM({p} & 1048575)", "far": "SUM({far})"}
_JOINED = "(CAST({u} AS DECIMAL(38,0)) * 1048576 + CAST({l} AS DECIMAL(38,0)))"
_NEAR = (f"CAST({_JOINED.replace('{u}', '{wu}').replace('{l}', '{wl}')} + "
         f"{_JOINED.replace('{u}', '{pu}').replace('{l}', '{pl}')} / 1099511627776 AS DOUBLE)")
_TOTAL = f"(COALESCE({_NEAR}, CASE WHEN {{far}} IS NOT NULL THEN 0.0D END) + COALESCE({{far}}, 0.0D))"
# 0 where there is no value; as short as it can be, since Java compiles no method of over 8,000 bytes of code and the grid takes
# nine totals in one
_TOTAL_OR_ZERO = f"(COALESCE({_NEAR}, 0.0D) + COALESCE({{far}}, 0.0D))"


def _fill(template: str, values: Mapping[str, str]) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: values[m.group(1)], template)


def _sql_operand(c: str) -> str:
    expr = f"`{c}`" if re.fullmatch(r"\w+", c) else f"({c})"
    return f"CAST({expr} AS DOUBLE)"


def _part_names(out: str) -> dict[str, str]:
    return {k: f"`__{k}_{out}`" for k in ("w", "p", "far")}


def with_parts(df: DataFrame, sums: Mapping[str, str]) -> DataFrame:
    """``df`` with the three parts of every quantity of ``sums`` (name of the total -> column name or SQL expression)."""
    columns = ["*"]
    for out, c in sums.items():
        x, at = {"x": _sql_operand(c)}, _part_names(out)
        columns += [f"{_fill(_WHOLE, x)} AS {at['w']}", f"{_fill(_PARTS, x)} AS {at['p']}", f"{_fill(_FAR, x)} AS {at['far']}"]
    return df.selectExpr(*columns)


def state_names(out: str) -> list[str]:
    return [f"{out}__{s}" for s in STATE]


def states(sums: Mapping[str, str] | Sequence[str]) -> list[Column]:
    """Aggregates over the columns of ``with_parts``: the state of every total."""
    return [F.expr(_fill(_SUMS[s], _part_names(out))).alias(f"{out}__{s}") for out in sums for s in STATE]


def merged(sums: Mapping[str, str] | Sequence[str]) -> list[Column]:
    """Aggregates over stored states: the state of all their rows."""
    return [F.expr(f"SUM(`{n}`)").alias(n) for out in sums for n in state_names(out)]


def total_sql(out: str, zero: bool = True) -> str:
    """The total of a state, as SQL; without a value it is 0 or (``zero`` off) null."""
    return _fill(_TOTAL_OR_ZERO if zero else _TOTAL, {s: f"`{out}__{s}`" for s in STATE})


def grouped(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str], more: Mapping[str, str] | None = None) -> DataFrame:
    """``keys``, the exact ``sums`` and ``more`` aggregates (name -> SQL), one row a group."""
    more = more or {}
    agg = with_parts(df, sums).groupBy(*keys).agg(*states(sums), *[F.expr(e).alias(n) for n, e in more.items()])
    return agg.selectExpr(*[f"`{k}`" for k in keys], *[f"{total_sql(n)} AS `{n}`" for n in sums], *[f"`{n}`" for n in more])


def exact_total(c: str) -> Column:
    """Exact sum as one aggregate, rounded to six places; null when no value is present. ``c`` is a column name or a SQL
    expression. ``grouped`` is cheaper for several sums, as it splits each value once."""
    x = {"x": _sql_operand(c)}
    parts = {"w": _fill(_WHOLE, x), "p": _fill(_PARTS, x), "far": _fill(_FAR, x)}
    return F.expr(_fill(_TOTAL, {s: _fill(e, parts) for s, e in _SUMS.items()}))


def exact_sum(c: str) -> Column:
    """Sum with the all-missing-is-zero rule of the grid."""
    return F.coalesce(exact_total(c), F.lit(0.0))
