"""Property tests: the Spark grid against a brute-force computation in plain
Python on random small inputs (null plants, missing quantities, unknown
plants, keys without a target)."""
from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from fixtures import CO_SCHEMA, OH_SCHEMA, OO_SCHEMA, TARGET_SCHEMA
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stockgrid.functions import exact_sum
from stockgrid.operators.aggregate import tag_sources
from stockgrid.operators.grid import ordering_grid

PLANTS = [None, "2910", "2920", "2930", "2999"]
MATS = ["M1", "M2", "M3"]
qty = st.one_of(st.none(), st.integers(0, 40).map(float), st.sampled_from([0.5, 2.25, 7.125]))
day = st.one_of(st.none(), st.integers(0, 60).map(lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)))
ALLOC = {"2910": 3, "2920": 4, "2930": 4}  # index of po_qty / po_request_qty in an open-order row


def _sum(values):
    return float(sum((Decimal(str(v)) for v in values if v is not None), Decimal(0)))


def brute(co, oh, oo, tg, pct=0.2):
    keys = {(r[0], r[1]) for r in co + oh + oo}
    out = {}
    for k in keys:
        c = [r for r in co if (r[0], r[1]) == k]
        h = [r for r in oh if (r[0], r[1]) == k]
        o = [r for r in oo if (r[0], r[1]) == k]
        ordered, confirmed = _sum(r[2] for r in c), _sum(r[3] for r in c)
        unr = _sum(r[2] for r in h)
        open_po = _sum(r[2] for r in o)
        alloc = _sum(r[ALLOC[k[0]]] for r in o) if k[0] in ALLOC else 0.0
        expiry = min([r[5] for r in h if r[5] is not None], default=None)
        avail = unr + open_po
        bal = avail - ordered
        uncon = max(ordered - confirmed, 0.0)
        t = tg.get(k)
        target = t[1] if t else None
        supplier = t[0] if t else None
        if target is None:
            sugg, safety = None, None
        else:
            sugg = float(math.ceil(max(target - avail + uncon + 0.0, 0)))
            safety = target * pct
        if supplier is None or target is None:
            risk = "Review"
        elif bal < 0:
            risk = "Critical"
        elif bal < safety:
            risk = "At Risk"
        else:
            risk = "Covered"
        out[k] = (unr, ordered, confirmed, uncon, open_po, alloc, expiry, avail, bal, sugg, safety, risk)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(co=st.lists(st.tuples(st.sampled_from(PLANTS), st.sampled_from(MATS), qty, qty), max_size=8),
       oh=st.lists(st.tuples(st.sampled_from(PLANTS), st.sampled_from(MATS), qty, qty, qty, day), max_size=8),
       oo=st.lists(st.tuples(st.sampled_from(PLANTS), st.sampled_from(MATS), qty, qty, qty, qty, day), max_size=8),
       tg=st.dictionaries(st.tuples(st.sampled_from(PLANTS[1:]), st.sampled_from(MATS)),
                          st.tuples(st.one_of(st.none(), st.just("S")), st.one_of(st.none(), qty.filter(
                              lambda v: v is not None))), max_size=6))
def test_grid_matches_brute_force(spark, co, oh, oo, tg):
    if not (co or oh or oo):
        return
    tagged = tag_sources(spark.createDataFrame(co, CO_SCHEMA), spark.createDataFrame(oh, OH_SCHEMA),
                         spark.createDataFrame(oo, OO_SCHEMA))
    target = spark.createDataFrame([(p, m, s, "t", "d", v) for (p, m), (s, v) in tg.items()], TARGET_SCHEMA)
    got = {(r.Plant, r.Material): (r.Unrestricted_On_Hand, r.Customer_Order_Qty, r.Confirmed_Qty,
                                   r.Unconfirmed_Qty, r.Open_PO_Qty, r.Allocation_Qty, r.Earliest_Expiry_Date,
                                   r.Available_Plus_Incoming, r.Projected_Balance, r.Suggested_Order_Qty,
                                   r.Safety_Stock, r.Risk_Status)
           for r in ordering_grid(tagged, target).collect()}
    assert got == brute(co, oh, oo, tg)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.decimals(min_value=-10**9, max_value=10**9, places=6,
                                                  allow_nan=False, allow_infinity=False)), max_size=30))
def test_exact_sum_equals_decimal_sum(spark, values):
    rows = [(None if v is None else float(v),) for v in values]
    df = spark.createDataFrame(rows or [(None,)], "x double")
    expected = float(sum((Decimal(repr(float(v))).quantize(Decimal("0.000001")) for v in values if v is not None),
                         Decimal(0)))
    assert df.agg(exact_sum("x").alias("s")).first().s == expected


GRID_SCHEMA = ("Plant string, Material string, Supplier string, Description string, Risk_Status string, "
               "Next_PO_Delivery_Date timestamp_ntz")
PATTERNS = ["ring|bolt", "10(0|1)", "a.c", "^M", "RED"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from([None, "2910", "2920"]),
                               st.sampled_from([None, "1001", "100999", "M1", "abc"]),
                               st.sampled_from([None, "S1", "S2", "S3"]),
                               st.sampled_from([None, "Red Ring", "blue bolt", "x", "A-C plate"]),
                               st.sampled_from(["Critical", "At Risk", "Review", "Covered"]), day),
                     min_size=1, max_size=12),
       plant=st.sampled_from([None, "2910", "2920"]),
       suppliers=st.one_of(st.none(), st.lists(st.sampled_from(["S1", "S2", "S3"]), min_size=1, max_size=2)),
       mpat=st.one_of(st.none(), st.sampled_from(PATTERNS)),
       dpat=st.one_of(st.none(), st.sampled_from(PATTERNS)),
       action=st.booleans(),
       months=st.one_of(st.none(), st.lists(st.sampled_from(["2026-01", "2026-02", "2026-03"]), min_size=1,
                                               max_size=2)))
def test_filters_match_brute_force(spark, rows, plant, suppliers, mpat, dpat, action, months):
    import re

    from stockgrid.operators.views import filter_grid
    df = spark.createDataFrame(rows, GRID_SCHEMA)
    got = sorted(map(tuple, filter_grid(df, plant=plant, suppliers=suppliers, material_pattern=mpat,
                                        description_pattern=dpat, action_only=action,
                                        months=months).collect()), key=repr)

    def keep(r):
        p, m, s, d, risk, when = r
        if plant and p != plant:
            return False
        if suppliers and s not in suppliers:
            return False
        if mpat and not (m is not None and re.search(mpat, m, re.IGNORECASE)):
            return False
        if dpat and not (d is not None and re.search(dpat, d, re.IGNORECASE)):
            return False
        if action and risk not in ("Critical", "At Risk", "Review"):
            return False
        if months and not (when is not None and when.strftime("%Y-%m") in months):
            return False
        return True

    assert got == sorted((r for r in rows if keep(r)), key=repr)
