"""Export-side report queries."""
from __future__ import annotations

from stockgrid import config
from stockgrid.operators import onepass, quality, reports
from stockgrid.plans.core import load_target
from stockgrid.plans.oracle_base import with_views
from stockgrid.plans.quality import (
    _DUP_SQL, _LOAD_SQL, _NULL_SQL, _PLANT_SQL, _SRC_KEYS, _UNMATCHED_SQL, _VARIANCE_SQL,
)
from stockgrid.plans.registry import query
from stockgrid.plans.views import _KPI_SQL, dashboard_grid
from stockgrid.sources import testdata as td

# configured supplier order for the fixture tables (brands; one unknown)
FIXTURE_SUPPLIERS = ("Brand#1", "Brand#ALT", "Brand#13", "Brand#99", "Brand#7")
REFRESHED = "2026-08-19 12:00:00 EDT"


REQUIRED = [(k, p) for k in config.KINDS for p in config.PLANTS]
_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus",
                 "l_shipdate", "o_orderstatus", "Plant", "Material"]


def _stored(spark, sf_dir, lists: bool = False):
    """The lineitem-orders join written once; from it the metrics with the key table (written too where ``lists`` are read
    from it) and, beside them, the duplicates (D11) of the rows as uploads carry them."""
    lines = reports.materialize(spark, td.lines(spark, sf_dir).select(*_LINE_COLUMNS), "report-lines")
    rows = td.rows_with_files(lines)

    def metrics() -> onepass.Stored:
        keys = onepass.key_table(rows, load_target(spark, sf_dir))
        if lists:
            keys = reports.materialize(spark, keys, "report-keys")
        return onepass.store(rows, keys, td.KIND_COLUMNS, REQUIRED)

    return onepass.together(metrics, lambda: quality.duplicate_rows(td.resent(rows), td.KIND_COLUMNS))


_EXPORT_SQL = """Supplier as "Supplier",
  Plant as "Plant",
  Material as "SAP Material",
  TOL_Material as "TOL Material",
  Description as "Description",
  Target_Stock as "Target Stock (Forecast Baseline)",
  Customer_Order_Qty as "Customer Order Qty",
  Confirmed_Qty as "Confirmed Qty",
  Unconfirmed_Qty as "Unconfirmed Qty",
  Unrestricted_On_Hand as "Unrestricted On Hand",
  Open_PO_Qty as "Open PO Qty",
  Allocation_Qty as "Allocation Qty (plant policy)",
  Inbound_Delivery_Qty as "Inbound Delivery Qty",
  Available_Plus_Incoming as "Available + Incoming",
  Projected_Balance as "Projected Balance",
  Suggested_Order_Qty as "Suggested Order Qty",
  Risk_Status as "Risk / Status",
  Next_PO_Delivery_Date as "Next PO Delivery Date",
  Earliest_Expiry_Date as "Earliest Expiry Date"
"""


@query("export_grid", "L3", with_views(f"select {_EXPORT_SQL} from grid_ovr", "grid_ovr"))
def q_export_grid(spark, sf_dir):
    return reports.export_grid(dashboard_grid(spark, sf_dir))


_KPIS = (
    ("active_materials", "Active materials"),
    ("total_unrestricted_on_hand", "Total unrestricted on-hand"),
    ("total_open_po_qty", "Total open PO quantity"),
    ("total_customer_order_qty", "Total customer-order quantity"),
    ("total_confirmed_qty", "Total confirmed customer-order quantity"),
    ("total_unconfirmed_qty", "Unconfirmed quantity"),
    ("materials_at_risk", "Materials at risk (Critical + At Risk)"),
    ("total_suggested_order_qty", "Suggested order quantity (total)"),
)
_EXEC_SQL = "select 'KPI' as section, ordinal, label, value from (" + " union all ".join(
    f"select {i} as ordinal, '{label}' as label, cast({c} as double) as value from ({_KPI_SQL}) k"
    for i, (c, label) in enumerate(_KPIS)) + ") x union all " + \
    f"select 'Materials by Risk / Status', 0, Risk_Status, cast(count(*) as double) from grid_ovr group by Risk_Status"


@query("executive_summary", "L4", with_views(_EXEC_SQL, "grid_ovr"))
def q_executive_summary(spark, sf_dir):
    return reports.executive_summary(dashboard_grid(spark, sf_dir))


_SUP_VALUES = ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(FIXTURE_SUPPLIERS))


@query("supplier_sections", "L5", with_views(f"""
select d.ordinal, d.supplier, coalesce(c.n, 0) as n_rows
from (values {_SUP_VALUES}) d(ordinal, supplier)
left join (select Supplier, count(*) as n from grid_ovr group by Supplier) c on c.Supplier = d.supplier
""", "grid_ovr"))
def q_supplier_sections(spark, sf_dir):
    return reports.supplier_sections(spark, dashboard_grid(spark, sf_dir), FIXTURE_SUPPLIERS)


_MASTER_NO_ACT_SQL = f"select Plant, Material from target except select Plant, Material from ({_SRC_KEYS}) s"


@query("unmatched_report", "I2", with_views(f"""
select kind as Source, Plant, Material, 'In SAP source, not in product master' as Reason from ({_UNMATCHED_SQL}) u
union all
select 'product_master', Plant, Material, 'In product master, no current SAP activity' from ({_MASTER_NO_ACT_SQL}) m
""", *config.KINDS, "target"))
def q_unmatched_report(spark, sf_dir):
    # both parts read the distinct source keys: checkpoint that key-level set
    # once instead of scanning and joining the sources twice
    keys = td.source_rows(spark, sf_dir).select("kind", "Plant", "Material").distinct().checkpoint(eager=True)
    return reports.unmatched_report(keys, load_target(spark, sf_dir))


_SUMMARY_SQL = f"""
select 'row_count' as section, kind || ':' || plant as item, cast(row_count as double) as value from ({_LOAD_SQL}) a
union all select 'valid', kind || ':' || plant, cast(status = 'Valid' as int) from ({_LOAD_SQL}) b
union all select 'plant_violation_rows', kind || ':' || expected_plant, violating_rows from ({_PLANT_SQL}) c
union all select 'duplicate_rows', kind, duplicate_rows from ({_DUP_SQL}) d
union all select 'null_values', kind, sum(null_count) from ({_NULL_SQL}) e group by kind
union all select 'unmatched_keys', kind, count(*) from ({_UNMATCHED_SQL}) f group by kind
union all select 'keys_not_in_master', 'all', count(*) from
  (select Plant, Material from ({_SRC_KEYS}) s except select Plant, Material from target) g
union all select 'master_keys_no_activity', 'all', count(*) from ({_MASTER_NO_ACT_SQL}) h
union all select 'variance', metric, variance from ({_VARIANCE_SQL}) i
union all select 'gate', 'passed', cast(coalesce(bool_and(abs(variance) < 1e-6), true) as int)
  from ({_VARIANCE_SQL}) j
"""


@query("reconciliation_summary", "K3", with_views(_SUMMARY_SQL, *config.KINDS, "grid", "target",
                                                    "required_files", "file_rows"))
def q_reconciliation_summary(spark, sf_dir):
    return onepass.summary(*_stored(spark, sf_dir))


_TEXT, _NONE = "cast(null as varchar)", "cast(null as double)"
_FILE_SQL = """
select r.kind, r.plant, count(f.kind) as n_rows,
  count(*) filter (where f.observed_plant is not null and f.observed_plant <> f.expected_plant) as n_wrong
from required_files r left join file_rows f on f.kind = r.kind and f.expected_plant = r.plant group by r.kind, r.plant
"""
_REPORT_SQL = f"""
select 'file' as section, kind as source, plant as plant, {_TEXT} as material, {_TEXT} as item, cast(n_rows as double) as value,
  case when n_rows = 0 then 'Missing' when n_wrong > 0 then 'Error' else 'Valid' end as note from ({_FILE_SQL}) a
union all select 'plant_violation', kind, expected_plant, null, observed_plant, count(*), null from file_rows
  where observed_plant is not null and observed_plant <> expected_plant group by kind, expected_plant, observed_plant
union all select 'duplicate_rows', kind, null, null, null, duplicate_rows, null from ({_DUP_SQL}) b
union all select 'missing_values', kind, null, null, "column", null_count, null from ({_NULL_SQL}) c
union all select 'unmatched_key', kind, Plant, Material, null, null, null from ({_UNMATCHED_SQL}) d
union all select 'not_in_master', null, Plant, Material, null, null, null from
  (select Plant, Material from ({_SRC_KEYS}) s except select Plant, Material from target) e
union all select 'no_activity', null, Plant, Material, null, null, null from ({_MASTER_NO_ACT_SQL}) f
union all select 'source_total', null, null, null, metric, source_total, null from ({_VARIANCE_SQL}) g
union all select 'dashboard_total', null, null, null, metric, dashboard_total, null from ({_VARIANCE_SQL}) h
union all select 'variance', null, null, null, metric, variance, null from ({_VARIANCE_SQL}) i
union all select 'gate', null, null, null, null, cast(bool_and(abs(variance) < 0.000001) as int),
  case when bool_and(abs(variance) < 0.000001) then 'PASS' else 'FAIL' end from ({_VARIANCE_SQL}) j
"""


@query("reconciliation_report", "K3", with_views(_REPORT_SQL, *config.KINDS, "grid", "target", "required_files", "file_rows"))
def q_reconciliation_report(spark, sf_dir):
    return onepass.report(*_stored(spark, sf_dir, lists=True))


def _fmt(c: str) -> str:
    return f"format('{{:,.2f}}', {c})"


_FILE_NAME_SQL = "case " + " ".join(
    f"when kind = '{k}' and plant = '{p}' then '{f}'" for f, (k, p) in config.UPLOAD_FILE_MAP.items()) + " end"
_KIND_NO_SQL = "case kind when 'customer_orders' then 1 when 'on_hand' then 2 else 3 end"
_METRIC_NO_SQL = "case metric " + " ".join(
    f"when '{m}' then {i + 1}" for i, (m, _, _) in enumerate(quality.RECONCILED_METRICS)) + " end"
_UNMATCHED_COUNTS_SQL = f"""
select k.kind, coalesce(u.n, 0) as n from (values ('customer_orders'), ('on_hand'), ('open_orders')) k(kind)
left join (select kind, count(*) as n from ({_UNMATCHED_SQL}) x group by kind) u on u.kind = k.kind
"""

_AUDIT_SQL = f"""
select 0 as section_no, 0 as line_no, 'ORDERING DASHBOARD -- AUDIT REPORT' as line
union all select 0, 1, 'Refreshed: {REFRESHED}'
union all select 0, 2, 'Reconciliation: ' || case when coalesce(bool_and(abs(variance) < 1e-6), true)
  then 'PASS' else 'FAIL' end from ({_VARIANCE_SQL}) v
union all select 0, 3, ''
union all select 1, 0, '-- Grand total variances --'
union all select 2, 0, ''
union all select 2, 1, '-- Duplicate row counts (preserved, not deleted) --'
union all select 3, 0, ''
union all select 3, 1, '-- File / schema validation --'
union all select 4, 0, ''
union all select 4, 1, '-- Unmatched materials --'
union all select 1, {_METRIC_NO_SQL}, '  ' || metric || ': source=' || {_fmt('source_total')}
  || ' dashboard=' || {_fmt('dashboard_total')} || ' variance=' || {_fmt('variance')} from ({_VARIANCE_SQL}) w
union all select 2, {_KIND_NO_SQL} + 1, '  ' || kind || ': ' || cast(duplicate_rows as varchar) from ({_DUP_SQL}) d
union all select 3, {_KIND_NO_SQL} * 3 + case plant when '2910' then 1 when '2920' then 2 else 3 end - 2,
  '  ' || {_FILE_NAME_SQL} || ': ' || status || case when violations <> '' then
  ' -- Plant column contains unexpected value(s) [''' || replace(violations, ',', ''', ''') ||
  '''] for a file mapped to plant ' || plant || '.' else '' end from ({_LOAD_SQL}) l
union all select 4, {_KIND_NO_SQL} + 1, '  ' || kind || ': ' || cast(n as varchar)
  || ' material(s) in source not in product master' from ({_UNMATCHED_COUNTS_SQL}) u
union all select 4, 5, '  product_master: ' || cast(count(*) as varchar)
  || ' material(s) with no current SAP activity' from ({_MASTER_NO_ACT_SQL}) m
union all select 5, 0, ''
union all select 5, 1, '-- Reference workbook audit --'
union all select 5, 2, '  Sheets: ' || cast(count(distinct sheet) as varchar) from cells
union all select 5, 3, '  Formulas: ' || cast(count(*) filter (where starts_with(coalesce(formula, value), '=')) as varchar) from cells
union all select 5, 4, '  #REF! error formulas (never translated into dashboard logic): ' || cast(count(*) filter (where starts_with(coalesce(formula, value), '=')
  and contains(coalesce(formula, value), '#REF!')) as varchar) from cells
"""


@query("audit_lines", "L6", with_views(_AUDIT_SQL, *config.KINDS, "grid", "target", "required_files",
                                        "file_rows", "cells"))
def q_audit_lines(spark, sf_dir):
    from stockgrid.operators.master_build import workbook_totals
    from stockgrid.sources.cells import cells_table
    s, duplicates = _stored(spark, sf_dir)
    no_activity = s.metrics.selectExpr("no_activity AS n")
    return reports.audit_lines(spark, onepass.variances(s), duplicates, onepass.status_with_values(s),
                               onepass.unmatched_counts(s), no_activity, REFRESHED, workbook_totals(cells_table(spark, sf_dir)))
