"""Shared SQL views for the DuckDB oracle.

These restate the fixture rules and the grid in the classic join form
(three aggregates, key union, null-safe left joins, window-ranked target)
so the oracle stays independent of the Spark plans it checks.
"""
from __future__ import annotations

XSUM = "coalesce(cast(sum(try_cast({c} as decimal(28,6))) as double), 0.0)"
XTOT = "cast(sum(try_cast({c} as decimal(28,6))) as double)"


def xsum(c: str) -> str:
    return XSUM.format(c=c)


def xtot(c: str) -> str:
    return XTOT.format(c=c)


VIEWS: dict[str, str] = {}

VIEWS["lines"] = """
select l.*, o.o_orderstatus,
  case when l.l_suppkey % 33 = 7 then null when l.l_suppkey % 3 = 0 then '2910'
       when l.l_suppkey % 3 = 1 then '2920' else '2930' end as Plant,
  concat('100', cast(l.l_partkey as varchar)) as Material
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
"""

VIEWS["customer_orders"] = """
select Plant, Material, l_orderkey as sales_order, l_quantity as order_qty,
  case when l_linestatus = 'F' then l_quantity end as confirmed_qty, l_shipdate as requested_date
from lines where l_returnflag = 'N'
"""

VIEWS["on_hand"] = """
select Plant, Material, l_orderkey as batch,
  case when l_linestatus = 'F' then l_quantity else cast(0 as double) end as unrestricted,
  case when l_linestatus = 'O' and o_orderstatus = 'P' then l_quantity end as quality,
  case when l_linestatus = 'O' and o_orderstatus = 'O' then l_quantity end as blocked,
  case when l_linenumber <> 1 then l_shipdate end as expiry
from lines where l_returnflag = 'R'
"""

VIEWS["open_orders"] = """
select Plant, Material, l_orderkey as po_number,
  case when l_linestatus = 'O' then l_quantity else cast(0 as double) end as open_po_qty,
  l_quantity as po_qty, cast(floor(l_quantity * 0.75) as double) as po_request_qty,
  case when o_orderstatus = 'P' then l_quantity end as inbound_qty, l_shipdate as delivery_date
from lines where l_returnflag = 'A'
"""

VIEWS["product_master"] = """
select pl.Plant, concat('100', cast(p_partkey as varchar)) as Material, p_brand as Supplier,
  cast(p_partkey as varchar) as TOL_Material, p_name as Description,
  case when p_size % 10 = 1 then null else cast(p_size * 4.5 as double) end as Latest_Forecast_Qty
from part cross join (select '2910' as Plant union all select '2920' union all select '2930') pl
where p_size % 10 <> 0
union all
select '2910', concat('100', cast(p_partkey as varchar)), 'Brand#ALT', cast(p_partkey as varchar),
  p_name, cast(p_size * 3.0 as double) from part where p_partkey % 7 = 0
union all
select '2930', concat('900', cast(p_partkey as varchar)), p_brand, cast(p_partkey as varchar),
  p_name, cast(p_size * 2.0 as double) from part where p_partkey % 20 = 0
"""

VIEWS["master_ranked"] = """
select *, row_number() over (partition by Plant, Material
  order by Latest_Forecast_Qty desc nulls last, Supplier asc nulls first,
           TOL_Material asc nulls first, Description asc nulls first) as rn
from product_master where Plant is not null and Material is not null
"""

VIEWS["target"] = """
select Plant, Material, Supplier, TOL_Material, Description, Latest_Forecast_Qty as Target_Stock
from master_ranked where rn = 1
"""

VIEWS["oh_agg"] = f"""
select Plant, Material, {xsum('unrestricted')} as Unrestricted_On_Hand,
  {xsum('quality')} as Quality_Inspection_Qty, {xsum('blocked')} as Blocked_Stock_Qty,
  min(expiry) as Earliest_Expiry_Date
from on_hand group by Plant, Material
"""

VIEWS["co_agg"] = f"""
select Plant, Material, Customer_Order_Qty, Confirmed_Qty,
  greatest(Customer_Order_Qty - Confirmed_Qty, 0.0) as Unconfirmed_Qty
from (select Plant, Material, {xsum('order_qty')} as Customer_Order_Qty,
        {xsum('confirmed_qty')} as Confirmed_Qty
      from customer_orders group by Plant, Material) t
"""

VIEWS["alloc"] = f"""
select Plant, Material, {xsum('po_qty')} as Allocation_Qty from open_orders where Plant = '2910' group by Plant, Material
union all
select Plant, Material, {xsum('po_request_qty')} from open_orders where Plant = '2920' group by Plant, Material
union all
select Plant, Material, {xsum('po_request_qty')} from open_orders where Plant = '2930' group by Plant, Material
"""

VIEWS["oo_agg"] = f"""
select a.*, al.Allocation_Qty from (
  select Plant, Material, {xsum('open_po_qty')} as Open_PO_Qty, {xsum('po_request_qty')} as PO_Request_Qty,
    {xsum('inbound_qty')} as Inbound_Delivery_Qty, min(delivery_date) as Next_PO_Delivery_Date
  from open_orders group by Plant, Material) a
left join alloc al on a.Plant = al.Plant and a.Material = al.Material
"""

VIEWS["grid_keys"] = """
select Plant, Material from oh_agg union select Plant, Material from co_agg
union select Plant, Material from oo_agg
"""

VIEWS["grid_base"] = """
select k.Plant, k.Material,
  coalesce(oh.Unrestricted_On_Hand, 0.0) as Unrestricted_On_Hand,
  coalesce(oh.Quality_Inspection_Qty, 0.0) as Quality_Inspection_Qty,
  coalesce(oh.Blocked_Stock_Qty, 0.0) as Blocked_Stock_Qty,
  oh.Earliest_Expiry_Date,
  coalesce(co.Customer_Order_Qty, 0.0) as Customer_Order_Qty,
  coalesce(co.Confirmed_Qty, 0.0) as Confirmed_Qty,
  coalesce(co.Unconfirmed_Qty, 0.0) as Unconfirmed_Qty,
  coalesce(oo.Open_PO_Qty, 0.0) as Open_PO_Qty,
  coalesce(oo.PO_Request_Qty, 0.0) as PO_Request_Qty,
  coalesce(oo.Inbound_Delivery_Qty, 0.0) as Inbound_Delivery_Qty,
  oo.Next_PO_Delivery_Date,
  coalesce(oo.Allocation_Qty, 0.0) as Allocation_Qty,
  t.Supplier, t.TOL_Material, t.Description, t.Target_Stock
from grid_keys k
left join oh_agg oh on k.Plant is not distinct from oh.Plant and k.Material is not distinct from oh.Material
left join co_agg co on k.Plant is not distinct from co.Plant and k.Material is not distinct from co.Material
left join oo_agg oo on k.Plant is not distinct from oo.Plant and k.Material is not distinct from oo.Material
left join target t on k.Plant = t.Plant and k.Material = t.Material
"""

VIEWS["grid_pos"] = """
select *, Unrestricted_On_Hand + Open_PO_Qty as Available_Plus_Incoming,
  Unrestricted_On_Hand + Open_PO_Qty - Customer_Order_Qty as Projected_Balance,
  cast(0.0 as double) as Manual_Override, '' as Planner_Note
from grid_base
"""

GRID_SELECT = """
select Plant, Material, Unrestricted_On_Hand, Quality_Inspection_Qty, Blocked_Stock_Qty,
  Earliest_Expiry_Date, Customer_Order_Qty, Confirmed_Qty, Unconfirmed_Qty, Open_PO_Qty,
  PO_Request_Qty, Inbound_Delivery_Qty, Next_PO_Delivery_Date, Allocation_Qty, Supplier,
  TOL_Material, Description, Target_Stock, Available_Plus_Incoming, Projected_Balance,
  Manual_Override, Planner_Note,
  Target_Stock is not null as Has_Target,
  case when Target_Stock is not null then cast(ceil(greatest(Target_Stock - Available_Plus_Incoming
       + Unconfirmed_Qty + Manual_Override, 0.0)) as double) end as Suggested_Order_Qty,
  case when Target_Stock is not null then Target_Stock * 0.2 end as Safety_Stock,
  case when Supplier is null or Target_Stock is null then 'Review'
       when Projected_Balance < 0 then 'Critical'
       when Projected_Balance < Target_Stock * 0.2 then 'At Risk'
       else 'Covered' end as Risk_Status
from {src}
"""

VIEWS["grid"] = GRID_SELECT.format(src="grid_pos")

# planner override log and latest override per key
VIEWS["override_log"] = """
select event_id, ts,
  case when user_id % 3 = 0 then '2910' when user_id % 3 = 1 then '2920' else '2930' end as Plant,
  concat('100', cast(user_id as varchar)) as Material,
  value - 50 as Manual_Override, event_type as Planner_Note
from events
"""

VIEWS["latest_overrides"] = """
select Plant, Material, Manual_Override, Planner_Note from (
  select *, row_number() over (partition by Plant, Material order by ts desc, event_id desc) as rn
  from override_log) x where rn = 1
"""

VIEWS["grid_ovr_pos"] = """
select g.Plant, g.Material, g.Unrestricted_On_Hand, g.Quality_Inspection_Qty, g.Blocked_Stock_Qty,
  g.Earliest_Expiry_Date, g.Customer_Order_Qty, g.Confirmed_Qty, g.Unconfirmed_Qty, g.Open_PO_Qty,
  g.PO_Request_Qty, g.Inbound_Delivery_Qty, g.Next_PO_Delivery_Date, g.Allocation_Qty, g.Supplier,
  g.TOL_Material, g.Description, g.Target_Stock, g.Available_Plus_Incoming, g.Projected_Balance,
  coalesce(o.Manual_Override, g.Manual_Override) as Manual_Override,
  coalesce(o.Planner_Note, g.Planner_Note) as Planner_Note
from grid g left join latest_overrides o on g.Plant = o.Plant and g.Material = o.Material
"""

VIEWS["grid_ovr"] = GRID_SELECT.format(src="grid_ovr_pos")

# dirty text, files, headers
VIEWS["raw_text"] = """
select p_partkey,
  case p_partkey % 6 when 0 then concat(chr(9), '100', cast(p_partkey as varchar), '.0 ')
    when 1 then concat(' PO-', cast(p_partkey as varchar))
    when 2 then 'NaN' when 3 then '  ' when 4 then concat(cast(p_partkey as varchar), '.05')
    else cast(p_partkey as varchar) end as id_text,
  case p_size % 7 when 0 then '1d' when 1 then '1,234' when 2 then 'NaN' when 3 then ' 12 '
    when 4 then '1e3' when 5 then '' else cast(p_size as varchar) end as num_text,
  case p_size % 13 when 0 then 'bad' when 1 then '45000' when 2 then null when 3 then '2026-02-30'
    when 4 then '2026-03-' || dd || 'T02:30:15' when 5 then ' 2026-03-' || dd || ' 02:30:15.125 '
    when 6 then '2026-03-' || dd || 'T02:30:15.250Z' when 7 then '2026-03-' || dd || ' 23:59'
    when 8 then '3/' || cast(p_partkey % 28 + 1 as varchar) || '/2026' when 9 then '03/' || dd || '/2026 7:05'
    when 10 then '12/' || dd || '/2025 17:05:09' when 11 then '2026-09-01 25:00:00'
    else '2026-09-' || dd end as date_text
from (select *, lpad(cast(p_partkey % 28 + 1 as varchar), 2, '0') as dd from part) p
"""

VIEWS["required_files"] = """
select k.kind, p.plant from (values ('customer_orders'), ('on_hand'), ('open_orders')) as k(kind)
cross join (values ('2910'), ('2920'), ('2930')) as p(plant)
"""

VIEWS["file_rows"] = """
select * from (
  select case l_returnflag when 'N' then 'customer_orders' when 'R' then 'on_hand' else 'open_orders' end as kind,
    case when l_suppkey % 3 = 0 then '2910' when l_suppkey % 3 = 1 then '2920' else '2930' end as expected_plant,
    case when l_returnflag = 'R' and l_suppkey % 3 = 1 and l_partkey % 40 = 0 then '2999' else Plant end as observed_plant
  from lines) x
where not (kind = 'open_orders' and expected_plant = '2930')
"""

VIEWS["headers"] = """
with e as (select * from (values (1, 'Material'), (2, 'Material Description'), (3, 'Plant'), (4, 'Plant Name'),
  (5, 'Storage Location'), (6, 'Stock in Quality Inspection'), (7, 'Unrestricted Stock'), (8, 'Batch'),
  (9, 'Blocked Stock'), (10, 'Production Date'), (11, 'Shelf Life Expiration Date')) as t(ord, name))
select p_partkey as file_id,
  case when p_partkey % 5 = 3 and ord = 1 then 2 when p_partkey % 5 = 3 and ord = 2 then 1 else ord end as ordinal,
  case when p_partkey % 5 = 2 and ord = 1 then 'Material Number' else name end as name
from part cross join e where not (p_partkey % 5 = 1 and ord = 11)
union all
select p_partkey, 12, 'Material' from part where p_partkey % 5 = 4
"""

VIEWS["cells"] = """
with r as (
  select p_brand as sheet, cast(3 + row_number() over (partition by p_brand order by p_partkey) as int) as row_no,
         p_partkey, p_name, p_size from part),
s as (select distinct p_brand as sheet from part),
h as (select * from (values (1, 'Plant #'), (2, 'SAP #'), (3, 'TOL #'), (4, 'Product'), (5, 'Forecast AS400'),
      (6, '2024 Forecast'), (7, 'Current Month'), (9, 'SAP #')) as t(col_no, label))
select sheet, 3 as row_no, col_no, label as value, cast(null as varchar) as formula from s cross join h
  where not (col_no = 2 and sheet in ('Brand#2', 'Brand#5'))
union all
select sheet, row_no, 1, case p_partkey % 3 when 0 then '2910' when 1 then '2920.0' else '2930' end, null
  from r where p_partkey % 11 <> 0
union all
select sheet, row_no, 2, concat('100', cast(p_partkey as varchar), '.0'), concat('=100&C', cast(row_no as varchar))
  from r where sheet not in ('Brand#2', 'Brand#5') and p_partkey % 17 <> 0
union all
select sheet, row_no, 3, cast(p_partkey as varchar), null from r where p_partkey % 13 <> 0
union all
select sheet, row_no, 4, concat(' ', p_name, ' '), null from r
union all
select sheet, row_no, 5, cast(p_size as varchar), null from r where p_size % 5 <> 0
union all
select sheet, row_no, 6, case p_size % 4 when 0 then '#REF!' when 1 then 'n/a' when 2 then ' '
  else cast(p_size * 2 as varchar) end, null from r
union all
select sheet, row_no, 7, '#REF!', '=XLOOKUP(#REF!,A1)' from r where p_partkey % 3 = 0
"""

# views each view depends on (for building minimal WITH clauses)
DEPENDS = {
    "lines": [], "customer_orders": ["lines"], "on_hand": ["lines"], "open_orders": ["lines"],
    "product_master": [], "master_ranked": ["product_master"], "target": ["master_ranked"],
    "oh_agg": ["on_hand"], "co_agg": ["customer_orders"], "alloc": ["open_orders"],
    "oo_agg": ["open_orders", "alloc"], "grid_keys": ["oh_agg", "co_agg", "oo_agg"],
    "grid_base": ["grid_keys", "oh_agg", "co_agg", "oo_agg", "target"], "grid_pos": ["grid_base"],
    "grid": ["grid_pos"], "override_log": [], "latest_overrides": ["override_log"],
    "grid_ovr_pos": ["grid", "latest_overrides"], "grid_ovr": ["grid_ovr_pos"],
    "raw_text": [], "required_files": [], "file_rows": ["lines"], "headers": [], "cells": [],
}


def with_views(body: str, *views: str, extra: dict[str, str] | None = None,
               extra_deps: dict[str, list[str]] | None = None) -> str:
    """Prefix ``body`` with the WITH clause for ``views`` and their deps."""
    extra = extra or {}
    deps = dict(DEPENDS)
    deps.update(extra_deps or {})
    defs = dict(VIEWS)
    defs.update(extra)
    order: list[str] = []

    def visit(v: str) -> None:
        if v in order:
            return
        for d in deps.get(v, []):
            visit(d)
        order.append(v)

    for v in views:
        visit(v)
    ctes = ",\n".join(f"{name} as ({defs[name].strip()})" for name in order)
    return f"with {ctes}\n{body.strip()}"
