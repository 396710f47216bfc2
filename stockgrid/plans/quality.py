"""Reconciliation, data-quality and load-validation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.functions import coerce_numeric, coerce_timestamp, normalize_identifier
from stockgrid.operators import loading, quality
from stockgrid.operators.reports import materialize
from stockgrid.plans.core import load_grid, load_target
from stockgrid.plans.oracle_base import with_views, xsum
from stockgrid.plans.registry import query
from stockgrid.sources import testdata as td

_DUP_SQL = """
select kind, cast(coalesce(sum(case when n > 1 then n end), 0) as bigint) as duplicate_rows from (
  select 'customer_orders' as kind, count(*) as n
  from (select * from customer_orders union all select * from customer_orders where sales_order % 40 = 5) a
  group by Plant, Material, sales_order, order_qty, confirmed_qty, requested_date
  union all
  select 'on_hand', count(*) from (select * from on_hand union all select * from on_hand where batch % 40 = 5) b
  group by Plant, Material, batch, unrestricted, quality, blocked, expiry
  union all
  select 'open_orders', count(*)
  from (select * from open_orders union all select * from open_orders where po_number % 40 = 5) c
  group by Plant, Material, po_number, open_po_qty, po_qty, po_request_qty, inbound_qty, delivery_date
) x group by kind
"""


@query("duplicate_rows", "D11", with_views(_DUP_SQL, *config.KINDS))
def q_duplicate_rows(spark, sf_dir):
    """The rows are read twice, for their hashes and for the comparison: the join that gives them is written once."""
    lines = materialize(spark, td.lines(spark, sf_dir).drop("l_partkey", "l_suppkey"), "duplicate-lines")
    return quality.duplicate_rows(td.resent(td.source_rows_from(lines)), td.KIND_COLUMNS)


_SOURCE_COLUMNS = {
    "customer_orders": "Plant Material sales_order order_qty confirmed_qty requested_date",
    "on_hand": "Plant Material batch unrestricted quality blocked expiry",
    "open_orders": "Plant Material po_number open_po_qty po_qty po_request_qty inbound_qty delivery_date",
}
_NULL_SQL = " union all ".join(
    f"select '{k}' as kind, '{c}' as \"column\", count(*) filter (where {c} is null) as null_count from {k}"
    for k, columns in _SOURCE_COLUMNS.items() for c in columns.split())


@query("null_counts", "D12", with_views(_NULL_SQL, *config.KINDS))
def q_null_counts(spark, sf_dir):
    return quality.null_counts(spark, td.source_rows(spark, sf_dir), td.KIND_COLUMNS)


@query("null_counts_nonzero", "B13", with_views(f"select * from ({_NULL_SQL}) x where null_count > 0",
                                                  *config.KINDS))
def q_null_counts_nonzero(spark, sf_dir):
    return quality.null_counts(spark, td.source_rows(spark, sf_dir), td.KIND_COLUMNS).filter(
        F.col("null_count") > 0)


_UNMATCHED_SQL = " union all ".join(
    f"select distinct '{k}' as kind, Plant, Material from {k} s where not exists "
    f"(select 1 from target t where t.Plant = s.Plant and t.Material = s.Material)" for k in config.KINDS)


@query("unmatched_by_source", "C5", with_views(_UNMATCHED_SQL, *config.KINDS, "target"))
def q_unmatched_by_source(spark, sf_dir):
    return quality.unmatched_by_source(td.source_rows(spark, sf_dir), load_target(spark, sf_dir))


_SRC_KEYS = " union ".join(f"select Plant, Material from {k}" for k in config.KINDS)


@query("sources_not_in_master", "H2/G2", with_views(
    f"select Plant, Material from ({_SRC_KEYS}) s except select Plant, Material from target",
    *config.KINDS, "target"))
def q_sources_not_in_master(spark, sf_dir):
    return quality.sorted_keys(
        quality.sources_not_in_master(td.source_rows(spark, sf_dir), load_target(spark, sf_dir)))


@query("master_no_activity", "H3/G2", with_views(
    f"select Plant, Material from target except select Plant, Material from ({_SRC_KEYS}) s",
    *config.KINDS, "target"))
def q_master_no_activity(spark, sf_dir):
    return quality.sorted_keys(
        quality.master_no_activity(td.source_rows(spark, sf_dir), load_target(spark, sf_dir)))


_VARIANCE_SQL = f"""
select s.metric, s.source_total, d.dashboard_total,
  round(d.dashboard_total - s.source_total, 6) as variance
from (select 'Unrestricted_On_Hand' as metric, {xsum('unrestricted')} as source_total from on_hand
      union all select 'Customer_Order_Qty', {xsum('order_qty')} from customer_orders
      union all select 'Confirmed_Qty', {xsum('confirmed_qty')} from customer_orders
      union all select 'Open_PO_Qty', {xsum('open_po_qty')} from open_orders) s
join (select 'Unrestricted_On_Hand' as metric, {xsum('Unrestricted_On_Hand')} as dashboard_total from grid
      union all select 'Customer_Order_Qty', {xsum('Customer_Order_Qty')} from grid
      union all select 'Confirmed_Qty', {xsum('Confirmed_Qty')} from grid
      union all select 'Open_PO_Qty', {xsum('Open_PO_Qty')} from grid) d on s.metric = d.metric
"""


@query("reconciliation_variance", "D10/K1/C6", with_views(_VARIANCE_SQL, *config.KINDS, "grid"))
def q_reconciliation_variance(spark, sf_dir):
    from stockgrid.operators.grid import ordering_grid
    from stockgrid.plans.core import load_target
    tagged = td.source_rows(spark, sf_dir)
    return quality.reconciliation_variance(tagged, ordering_grid(tagged, load_target(spark, sf_dir)))


@query("reconciliation_gate", "K2", with_views(
    "select coalesce(bool_and(abs(variance) < 1e-6), true) as passed, count(*) as n_metrics, "
    "count(*) filter (where not (abs(variance) < 1e-6)) as n_failing from (" + _VARIANCE_SQL + ") v",
    *config.KINDS, "grid"))
def q_reconciliation_gate(spark, sf_dir):
    return quality.reconciliation_gate(q_reconciliation_variance(spark, sf_dir))


# --- load / files / headers ---------------------------------------------------

_ON_HAND = ("Material", "Material Description", "Plant", "Plant Name", "Storage Location", "Stock in Quality Inspection",
            "Unrestricted Stock", "Batch", "Blocked Stock", "Production Date", "Shelf Life Expiration Date")
_EXP_VALUES = ", ".join(f"('{n}')" for n in _ON_HAND)
_EXP_LIST = "[" + ", ".join(f"'{n}'" for n in _ON_HAND) + "]"
_HEADER_SQL = f"""
select f.file_id,
  coalesce(m.v, '') as missing_columns, coalesce(x.v, '') as extra_columns,
  coalesce(d.v, '') as duplicated_columns,
  (m.v is null and x.v is null and d.v is null and not f.same) as reordered,
  (m.v is null and x.v is null and d.v is null and f.same) as ok,
  case when m.v is not null or x.v is not null or d.v is not null then 'mismatch'
       when not f.same then 'reordered' else 'ok' end as result
from (select file_id, list(name order by ordinal, name) = {_EXP_LIST} as same from headers group by file_id) f
left join (select fi.file_id, string_agg(e.name, ',' order by e.name) as v
           from (select distinct file_id from headers) fi cross join (values {_EXP_VALUES}) e(name)
           where not exists (select 1 from headers h where h.file_id = fi.file_id and h.name = e.name)
           group by fi.file_id) m on m.file_id = f.file_id
left join (select file_id, string_agg(distinct name, ',' order by name) as v from headers
           where name not in (select name from (values {_EXP_VALUES}) e(name)) group by file_id) x
  on x.file_id = f.file_id
left join (select file_id, string_agg(name, ',' order by name) as v from
             (select file_id, name from headers group by file_id, name having count(*) > 1) y
           group by file_id) d on d.file_id = f.file_id
"""


@query("header_validation", "A4", with_views(_HEADER_SQL, "headers"))
def q_header_validation(spark, sf_dir):
    return loading.header_validation(td.headers(spark, sf_dir), config.ON_HAND_HEADERS).drop("message", "received", "expected")


_CONTRACT_VALUES = ", ".join(f"('{k}', {i + 1}, '{n}')" for k in config.KINDS for i, n in enumerate(config.HEADERS_BY_KIND[k]))
_KIND_HEADERS_SQL = f"""
select c.kind, p_partkey as file_id, case when p_partkey % 5 = 3 and c.i <= 2 then 3 - c.i else c.i end as ordinal,
  case when p_partkey % 5 = 2 and c.i = 1 then c.n || ' No.' else c.n end as name
from part cross join (values {_CONTRACT_VALUES}) c(kind, i, n)
where not (p_partkey % 5 = 1 and c.i = case c.kind when 'on_hand' then 11 when 'open_orders' then 28 else 31 end)
union all select k.kind, p_partkey, 32, 'Material' from part
  cross join (values ('customer_orders'), ('on_hand'), ('open_orders')) k(kind) where p_partkey % 5 = 4
"""
_QUOTED = "'[''' || array_to_string({c}, ''', ''') || ''']'"
_CONTRACTS_SQL = f"""
select * from (
with contract as (
  select k as kind, i, n as name from (values {_CONTRACT_VALUES}) c(k, i, n)
), expected as (
  select kind, list(name order by i) as names from contract group by kind
), received as (
  select kind, file_id, list(name order by ordinal, name) as names from kind_headers group by kind, file_id
), parts as (
  select r.kind, r.file_id, r.names as received, e.names as expected,
    list_filter(e.names, lambda x: not list_contains(r.names, x)) as miss,
    list_filter(r.names, lambda x: not list_contains(e.names, x)) as extra,
    (select coalesce(list(d.n order by d.n), []) from (select u.n from (select unnest(r.names) as n) u group by u.n having count(*) > 1) d) as dup
  from received r join expected e on e.kind = r.kind
)
select kind, file_id, case when len(miss) + len(extra) + len(dup) > 0 then 'mismatch'
    when received <> expected then 'reordered' else 'ok' end as result,
  case when len(miss) + len(extra) + len(dup) > 0 then 'Schema mismatch -- ' || concat_ws('; ',
      case when len(miss) > 0 then 'missing columns: ' || {_QUOTED.format(c='miss')} end,
      case when len(extra) > 0 then 'unexpected columns: ' || {_QUOTED.format(c='extra')} end,
      case when len(dup) > 0 then 'duplicated columns: ' || {_QUOTED.format(c='dup')} end)
    when received <> expected then 'Columns present but reordered relative to the expected schema.'
    else 'Schema OK.' end as message,
  array_to_string(received, '|') as received, array_to_string(expected, '|') as expected
from parts) c
"""


@query("header_contracts", "A4", with_views(_CONTRACTS_SQL, "kind_headers", extra={"kind_headers": _KIND_HEADERS_SQL}))
def q_header_contracts(spark, sf_dir):
    """Every file's header against the contract of its kind, with the message and both headers."""
    headers, out = td.kind_headers(spark, sf_dir), None
    for kind in config.KINDS:
        one = loading.header_validation(headers.where(F.col("kind") == kind), config.HEADERS_BY_KIND[kind]).select(
            F.lit(kind).alias("kind"), "file_id", "result", "message", F.array_join("received", "|").alias("received"),
            F.array_join("expected", "|").alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out


_PLANT_SQL = """
select kind, expected_plant, count(*) as row_count,
  coalesce(string_agg(distinct observed_plant, ',' order by observed_plant)
           filter (where observed_plant is not null and observed_plant <> expected_plant), '') as violations,
  count(*) filter (where observed_plant is not null and observed_plant <> expected_plant) as violating_rows
from file_rows group by kind, expected_plant
"""


@query("plant_violations", "A8", with_views(_PLANT_SQL, "file_rows"))
def q_plant_violations(spark, sf_dir):
    return loading.plant_violations(td.file_rows(spark, sf_dir))


@query("plant_violation_rows", "A8", with_views(
    "select kind, expected_plant, observed_plant, count(*) as n_rows from file_rows where observed_plant is not null "
    "and observed_plant <> expected_plant group by kind, expected_plant, observed_plant", "file_rows"))
def q_plant_violation_rows(spark, sf_dir):
    return loading.violation_rows(td.file_rows(spark, sf_dir))


_LOAD_SQL = f"""
select r.kind, r.plant,
  case when p.row_count is null then 'Missing' when p.violations <> '' then 'Error' else 'Valid' end as status,
  coalesce(p.row_count, 0) as row_count, coalesce(p.violations, '') as violations
from required_files r left join ({_PLANT_SQL}) p on r.kind = p.kind and r.plant = p.expected_plant
"""


@query("load_status", "A9", with_views(_LOAD_SQL, "required_files", "file_rows"))
def q_load_status(spark, sf_dir):
    return loading.load_status(td.required_files(spark), td.file_rows(spark, sf_dir))


@query("load_gate", "A9", with_views(
    "select count(*) as n_required, count(*) filter (where status = 'Valid') as n_valid, "
    f"coalesce(bool_and(status = 'Valid'), false) as all_valid from ({_LOAD_SQL}) s",
    "required_files", "file_rows"))
def q_load_gate(spark, sf_dir):
    return loading.load_gate(loading.load_status(td.required_files(spark), td.file_rows(spark, sf_dir)))


_WS = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query("normalize_identifiers", "A5", with_views(f"""
select p_partkey, id_text,
  case when s = '' or lower(s) = 'nan' then null
       when regexp_matches(s, '^[0-9]+\\.0$') then left(s, length(s) - 2) else s end as identifier
from (select p_partkey, id_text, {_WS.format(c='id_text')} as s from raw_text) x
""", "raw_text"))
def q_normalize_identifiers(spark, sf_dir):
    rt = td.raw_text(spark, sf_dir)
    return rt.select("p_partkey", "id_text", normalize_identifier("id_text").alias("identifier"))


@query("coerce_numeric", "A6", with_views(f"""
select p_partkey, num_text,
  case when regexp_matches(s, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
       then try_cast(s as double) end as value
from (select p_partkey, num_text, {_WS.format(c='num_text')} as s from raw_text) x
""", "raw_text"))
def q_coerce_numeric(spark, sf_dir):
    rt = td.raw_text(spark, sf_dir)
    return rt.select("p_partkey", "num_text", coerce_numeric("num_text").alias("value"))


@query("coerce_dates", "A7", with_views(f"""
select p_partkey, date_text,
  case when regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
       then coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y-%m-%dT%H:%M:%S'),
                     try_strptime(s, '%Y-%m-%d %H:%M:%S.%f'), try_strptime(s, '%Y-%m-%dT%H:%M:%S.%fZ'),
                     try_strptime(s, '%Y-%m-%d %H:%M'), try_strptime(s, '%Y-%m-%d'))
       when regexp_matches(s, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}')
       then coalesce(try_strptime(s, '%m/%d/%Y %H:%M:%S'), try_strptime(s, '%m/%d/%Y %H:%M'),
                     try_strptime(s, '%m/%d/%Y')) end as value
from (select p_partkey, date_text, {_WS.format(c='date_text')} as s from raw_text) x
""", "raw_text"))
def q_coerce_dates(spark, sf_dir):
    rt = td.raw_text(spark, sf_dir)
    return rt.select("p_partkey", "date_text", coerce_timestamp("date_text").alias("value"))
