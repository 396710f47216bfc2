"""Dashboard, supplier-detail and override queries over the grid."""
from __future__ import annotations

from pyspark.sql import functions as F

from stockgrid import config
from stockgrid.operators import overrides as ov
from stockgrid.operators import supplier as sp
from stockgrid.operators import views as v
from stockgrid.plans.core import GRID_COLS, load_grid, load_target
from stockgrid.plans.oracle_base import with_views, xsum
from stockgrid.plans.registry import query
from stockgrid.sources import testdata as td

# query parameters (the dashboard's filter widgets)
PLANT = "2920"
SUPPLIERS = ("Brand#12", "Brand#ALT", "Brand#3")
MATERIAL_PATTERN = "100(12|45)"
DESCRIPTION_PATTERN = "RING|Bolt"
MONTHS = ("1996-03", "1998-07", "2000-01")
COMBINED = dict(plant="2910", description_pattern="ring", action_only=True,
                months=("1995-03", "1995-04", "1995-05", "1996-01", "1997-12"))
SUPPLIER = "Brand#12"
SUPPLIER_PLANTS = ("2910", "2930")

G = "grid_ovr"


def latest(spark, sf_dir):
    return ov.latest_overrides(td.override_log(spark, sf_dir))


def dashboard_grid(spark, sf_dir):
    """The grid the pages read: the flagship grid with overrides applied."""
    return ov.apply_overrides(load_grid(spark, sf_dir), latest(spark, sf_dir))


def _of_suppliers(spark, sf_dir, suppliers, plants=None):
    return sp.supplier_grid(td.source_rows(spark, sf_dir), load_target(spark, sf_dir), suppliers, plants, td.override_log(spark, sf_dir))


def _gsql(body: str, *more: str) -> str:
    return with_views(body, G, *more)


def _in(values) -> str:
    return ", ".join(f"'{x}'" for x in values)


_PLANT_NAME_SQL = ("case {c} when '2910' then 'Mississauga' when '2920' then 'Calgary' "
                   "when '2930' then 'Surrey' else '' end")
_LABEL_SQL = "{c} || ' ' || " + _PLANT_NAME_SQL
_MONTH_SQL = "strftime({c}, '%Y-%m')"


@query("latest_overrides", "N2", with_views("select * from latest_overrides", "latest_overrides"))
def q_latest_overrides(spark, sf_dir):
    return latest(spark, sf_dir)


@query("apply_overrides", "C4/E8", _gsql(f"select {GRID_COLS} from grid_ovr"))
def q_apply_overrides(spark, sf_dir):
    return dashboard_grid(spark, sf_dir)


@query("filter_plant", "B3", _gsql(f"select {GRID_COLS} from grid_ovr where Plant = '{PLANT}'"))
def q_filter_plant(spark, sf_dir):
    return v.filter_grid(dashboard_grid(spark, sf_dir), plant=PLANT)


@query("filter_supplier", "B4", _gsql(f"select {GRID_COLS} from grid_ovr where Supplier in ({_in(SUPPLIERS)})"))
def q_filter_supplier(spark, sf_dir):
    return _of_suppliers(spark, sf_dir, SUPPLIERS)


@query("search_material", "B5", _gsql(
    f"select {GRID_COLS} from grid_ovr where coalesce(regexp_matches(Material, '(?i){MATERIAL_PATTERN}'), false)"))
def q_search_material(spark, sf_dir):
    return v.filter_grid(dashboard_grid(spark, sf_dir), material_pattern=MATERIAL_PATTERN)


@query("search_description", "B6", _gsql(
    f"select {GRID_COLS} from grid_ovr where coalesce(regexp_matches(Description, '(?i){DESCRIPTION_PATTERN}'), false)"))
def q_search_description(spark, sf_dir):
    return v.filter_grid(dashboard_grid(spark, sf_dir), description_pattern=DESCRIPTION_PATTERN)


@query("action_only", "B7", _gsql(
    f"select {GRID_COLS} from grid_ovr where Risk_Status in ('Critical', 'At Risk', 'Review')"))
def q_action_only(spark, sf_dir):
    return v.filter_grid(dashboard_grid(spark, sf_dir), action_only=True)


@query("filter_month", "B8", _gsql(
    f"select {GRID_COLS} from grid_ovr where {_MONTH_SQL.format(c='Next_PO_Delivery_Date')} in ({_in(MONTHS)})"))
def q_filter_month(spark, sf_dir):
    return v.filter_grid(dashboard_grid(spark, sf_dir), months=MONTHS)


@query("filtered_view", "B9", _gsql(
    f"select {GRID_COLS} from grid_ovr where Plant = '{COMBINED['plant']}' "
    f"and coalesce(regexp_matches(Description, '(?i){COMBINED['description_pattern']}'), false) "
    "and Risk_Status in ('Critical', 'At Risk', 'Review') "
    f"and {_MONTH_SQL.format(c='Next_PO_Delivery_Date')} in ({_in(COMBINED['months'])})"))
def q_filtered_view(spark, sf_dir):
    return v.filter_grid(dashboard_grid(spark, sf_dir), **COMBINED)


@query("facets", "B10", _gsql(f"""
select distinct 'supplier' as facet, Supplier as value from grid_ovr where Supplier is not null
union select distinct 'plant', Plant from grid_ovr where Plant is not null
union select distinct 'month', {_MONTH_SQL.format(c='Next_PO_Delivery_Date')} from grid_ovr
  where Next_PO_Delivery_Date is not null
"""))
def q_facets(spark, sf_dir):
    return v.facets(dashboard_grid(spark, sf_dir))


_KPI_SQL = f"""
select (select count(*) from (select distinct Plant, Material from grid_ovr) k) as active_materials,
  {xsum('Unrestricted_On_Hand')} as total_unrestricted_on_hand,
  {xsum('Open_PO_Qty')} as total_open_po_qty,
  {xsum('Customer_Order_Qty')} as total_customer_order_qty,
  {xsum('Confirmed_Qty')} as total_confirmed_qty,
  {xsum('Unconfirmed_Qty')} as total_unconfirmed_qty,
  count(*) filter (where Risk_Status in ('Critical', 'At Risk')) as materials_at_risk,
  {xsum('Suggested_Order_Qty')} as total_suggested_order_qty
from grid_ovr
"""


@query("kpis", "D5", _gsql(_KPI_SQL))
def q_kpis(spark, sf_dir):
    return v.kpis(dashboard_grid(spark, sf_dir))


@query("plant_metrics_long", "D6/I1/B2", _gsql(f"""
select {_LABEL_SQL.format(c='Plant')} as Plant, 'On_Hand' as Metric, {xsum('Unrestricted_On_Hand')} as Qty
from grid_ovr group by Plant
union all
select {_LABEL_SQL.format(c='Plant')}, 'Customer_Demand', {xsum('Customer_Order_Qty')} from grid_ovr group by Plant
"""))
def q_plant_metrics_long(spark, sf_dir):
    return v.plant_metrics_long(dashboard_grid(spark, sf_dir))


@query("open_po_by_month", "D7", _gsql(f"""
select {_MONTH_SQL.format(c='Next_PO_Delivery_Date')} as Month, {xsum('Open_PO_Qty')} as Open_PO_Qty
from grid_ovr where Next_PO_Delivery_Date is not null group by 1 order by 1
"""))
def q_open_po_by_month(spark, sf_dir):
    return v.open_po_by_month(dashboard_grid(spark, sf_dir))


@query("suggested_by_supplier", "D8", _gsql(f"""
select Supplier, {xsum('Suggested_Order_Qty')} as Suggested_Order_Qty from grid_ovr group by Supplier
having {xsum('Suggested_Order_Qty')} > 0 order by 2 desc
"""))
def q_suggested_by_supplier(spark, sf_dir):
    return v.suggested_by_supplier(dashboard_grid(spark, sf_dir))


@query("status_counts", "D9", _gsql(
    "select Risk_Status, count(*) as n_rows from grid_ovr group by Risk_Status order by 2 desc"))
def q_status_counts(spark, sf_dir):
    return v.status_counts(dashboard_grid(spark, sf_dir))


@query("top_at_risk", "G1", _gsql(
    "select Plant, Material, Description, Projected_Balance, Risk_Status from grid_ovr "
    "where Risk_Status in ('Critical', 'At Risk') order by Projected_Balance, Plant, Material limit 10"))
def q_top_at_risk(spark, sf_dir):
    return v.top_at_risk(dashboard_grid(spark, sf_dir))


_DISPLAY_SQL = ", ".join(
    (_LABEL_SQL.format(c="Plant") if c == "Plant" else c) + f' as "{label}"' for c, label in v.DISPLAY_LABELS)


@query("grid_display", "B1/B2", _gsql(f"select {_DISPLAY_SQL} from grid_ovr"))
def q_grid_display(spark, sf_dir):
    return v.grid_display(dashboard_grid(spark, sf_dir))


_SLICE_SQL = f"(select * from grid_ovr where Supplier = '{SUPPLIER}' and Plant in ({_in(SUPPLIER_PLANTS)})) s"


@query("supplier_slice", "B11", _gsql(f"select {GRID_COLS} from {_SLICE_SQL}"))
def q_supplier_slice(spark, sf_dir):
    return _of_suppliers(spark, sf_dir, [SUPPLIER], SUPPLIER_PLANTS)


def _supplier_view_query(view: str):
    cols = ", ".join(v.SUPPLIER_VIEWS[view])

    @query(f"supplier_{view}", "B12", _gsql(f"select {cols} from {_SLICE_SQL}"))
    def q(spark, sf_dir):
        return v.supplier_view(_of_suppliers(spark, sf_dir, [SUPPLIER], SUPPLIER_PLANTS), view)
    return q


for _view in v.SUPPLIER_VIEWS:
    _supplier_view_query(_view)


@query("supplier_recommendation", "B12", _gsql(f"""
select s.Plant, s.Material, s.Suggested_Order_Qty, s.Risk_Status,
  coalesce(o.Manual_Override, 0.0) as Manual_Override, coalesce(o.Planner_Note, '') as Planner_Note
from {_SLICE_SQL} left join latest_overrides o on s.Plant = o.Plant and s.Material = o.Material
""", "latest_overrides"))
def q_supplier_recommendation(spark, sf_dir):
    return v.supplier_recommendation(_of_suppliers(spark, sf_dir, [SUPPLIER], SUPPLIER_PLANTS))


_PAGE_COLUMNS = {**v.SUPPLIER_VIEWS, "recommendation": ["Plant", "Material", "Suggested_Order_Qty", "Risk_Status", "Manual_Override", "Planner_Note"]}
_TEXT_COLUMNS = ("TOL_Material", "Description", "Risk_Status", "Planner_Note")
_DATE_COLUMNS = ("Earliest_Expiry_Date", "Next_PO_Delivery_Date")


def _page_cell(view: str, c: str) -> str:
    text = c if c in _TEXT_COLUMNS else f"strftime({c}, '%Y-%m-%d')" if c in _DATE_COLUMNS else "cast(null as varchar)"
    number = "cast(null as double)" if c in _TEXT_COLUMNS + _DATE_COLUMNS else c
    return f"select '{view}' as view, Plant, Material, '{c}' as item, {number} as number, {text} as text from {_SLICE_SQL}"


@query("supplier_pages", "B12", _gsql(" union all ".join(
    _page_cell(view, c) for view, cs in _PAGE_COLUMNS.items() for c in cs if c not in ("Plant", "Material"))))
def q_supplier_pages(spark, sf_dir):
    """All seven tabs from one stored slice, a row for each cell."""
    out = None
    for view, page in sp.supplier_pages(_of_suppliers(spark, sf_dir, [SUPPLIER], SUPPLIER_PLANTS)).items():
        types = dict(page.dtypes)
        cells = [F.struct(F.lit(c).alias("item"), (F.col(c) if types[c] == "double" else F.lit(None).cast("double")).alias("number"),
                          (F.lit(None) if types[c] == "double" else F.col(c) if types[c] == "string"
                           else F.date_format(c, "yyyy-MM-dd")).cast("string").alias("text"))
                 for c in page.columns if c not in ("Plant", "Material")]
        one = page.select(F.lit(view).alias("view"), "Plant", "Material", F.explode(F.array(*cells)).alias("c")).select(
            "view", "Plant", "Material", "c.item", "c.number", "c.text")
        out = one if out is None else out.unionByName(one)
    return out


_RAW_COLUMNS = list(dict.fromkeys(c for k in config.KINDS for c in td.KIND_COLUMNS[k]))


def _raw_select(kind: str) -> str:
    own = set(td.KIND_COLUMNS[kind])
    columns = ", ".join(c if c in own else f"null as {c}" for c in _RAW_COLUMNS)
    return f"select '{kind}' as kind, {columns} from {kind} where Plant in ({_in(config.PLANTS)})"


@query("raw_by_plant", "B14", with_views(" union all ".join(_raw_select(k) for k in config.KINDS), *config.KINDS))
def q_raw_by_plant(spark, sf_dir):
    """All nine slices of the raw rows, kind by plant, with each kind's own columns."""
    return v.raw_slices(td.source_rows(spark, sf_dir)).select("kind", *_RAW_COLUMNS)
