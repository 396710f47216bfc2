"""Product-master build and sheet profiling queries over ``cells``."""
from __future__ import annotations

from stockgrid import config
from stockgrid.functions.normalize import NUMBER_PATTERN
from stockgrid.operators import master_build as mb
from stockgrid.plans.oracle_base import with_views
from stockgrid.plans.registry import query
from stockgrid.sources.cells import cells_table as cells

HR = config.MASTER_HEADER_ROW


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _clean(x: str) -> str:
    t = _trim(x)
    cut = f"case when {t} like '%.0' and regexp_matches(replace({t}, '.0', ''), '^[0-9]+$') " \
          f"then left({t}, length({t}) - 2) else {t} end"
    return f"nullif({cut}, '')"


def _num(x: str) -> str:
    t = _trim(x)
    return f"case when regexp_matches({t}, '{NUMBER_PATTERN}') then try_cast({t} as double) end"


_SHOWN = "coalesce(formula, value)"
_ERRORS = "'#REF!', '#N/A', '#VALUE!', '#DIV/0!', '#NAME?', '#NULL!', '#NUM!'"
_TEXT = (f"{_SHOWN} is not null and {_trim(_SHOWN)} <> '' and not starts_with({_SHOWN}, '=') "
         f"and {_num(_SHOWN)} is null")
_TAGS = "concat_ws(',', " + ", ".join(
    f"case when regexp_matches(header, '{p}') then '{t}' end" for t, p in config.HEADER_TAG_PATTERNS) + ")"

M_VIEWS = {
    "m_hdr": f"select sheet, col_no, {_trim(_SHOWN)} as label from cells where row_no = {HR}",
    "m_first": f"""
select sheet,
  min(case when label = 'Plant #' then col_no end) as plant_col,
  min(case when label = 'SAP #' then col_no end) as sap_col0,
  min(case when label = 'TOL #' then col_no end) as tol_col,
  cast(count(*) filter (where regexp_matches(label, '(?i)forecast|fcst')) as int) as forecast_col_count
from m_hdr group by sheet""",
    "m_cols": f"""
select f.sheet, f.plant_col,
  case when f.tol_col is not null and abs(f.sap_col0 - f.tol_col) > 3
       then null else f.sap_col0 end as sap_col,
  f.tol_col, d.desc_col,
  (case when f.tol_col is not null and abs(f.sap_col0 - f.tol_col) > 3
       then null else f.sap_col0 end) is null as reconstructed_material_from_tol,
  f.forecast_col_count
from m_first f left join (
  select h.sheet, min(h.col_no) as desc_col from m_hdr h join m_first f2 on h.sheet = f2.sheet
  where h.label in ('Product', 'Item') and h.col_no > f2.tol_col group by h.sheet) d on d.sheet = f.sheet""",
    "m_rows": f"""
select c.sheet, c.row_no,
  max(case when c.col_no = s.plant_col then c.value end) as plant_raw,
  max(case when c.col_no = s.sap_col then c.value end) as sap_raw,
  max(case when c.col_no = s.tol_col then c.value end) as tol_raw,
  max(case when c.col_no = s.desc_col then c.value end) as desc_raw,
  bool_or(s.reconstructed_material_from_tol) as reconstruct
from cells c join m_cols s on c.sheet = s.sheet where c.row_no > {HR} group by c.sheet, c.row_no""",
    "m_class": f"""
select sheet, row_no,
  case when plant_raw is null and tol_raw is null and desc_raw is null then 'blank'
       when plant_raw is null then 'no_plant'
       when material is null then 'missing_material' else 'extracted' end as row_class,
  {_clean('plant_raw')} as Plant, material as Material, {_clean('tol_raw')} as TOL_Material,
  coalesce(nullif({_trim('desc_raw')}, ''), '') as Description
from (select *, case when reconstruct then '100' || {_clean('tol_raw')} else {_clean('sap_raw')} end as material
      from m_rows) x""",
    "m_fc": f"""
select sheet, row_no, num as Latest_Forecast_Qty, header as Forecast_Source_Column from (
  select *, row_number() over (partition by sheet, row_no order by col_no desc) as rn from (
    select c.sheet, c.row_no, c.col_no, h.label as header,
      case when {_trim('c.value')} not in ({_ERRORS}) then {_num('c.value')} end as num
    from cells c join m_hdr h on c.sheet = h.sheet and c.col_no = h.col_no
    where c.row_no > {HR} and regexp_matches(h.label, '(?i)forecast|fcst')) v
  where num is not null) r
where rn = 1""",
    "m_master": """
select c.sheet as Supplier, c.Plant, c.Material, c.TOL_Material, c.Description, f.Latest_Forecast_Qty,
  coalesce(f.Forecast_Source_Column, '') as Forecast_Source_Column
from m_class c left join m_fc f on c.sheet = f.sheet and c.row_no = f.row_no
where c.row_class = 'extracted'""",
    "m_hrow": f"""
select s.sheet, coalesce(b.row_no, 1) as header_row, coalesce(b.n, 0) as text_cells
from (select distinct sheet from cells) s left join (
  select sheet, row_no, n from (
    select *, row_number() over (partition by sheet order by n desc, row_no asc) as rn from (
      select sheet, row_no, count(*) as n from cells
      where row_no <= {config.HEADER_SCAN_MAX_ROW} and {_TEXT}
      group by sheet, row_no) a) b0 where rn = 1) b on b.sheet = s.sheet""",
    "m_tags": f"""
select sheet, col_no, header, {_TAGS} as tags from (
  select c.sheet, c.col_no, {_SHOWN} as header from cells c join m_hrow h
    on c.sheet = h.sheet and c.row_no = h.header_row
  where {_trim(_SHOWN)} <> '') x""",
}
M_VIEWS["win"] = f"""
select c.sheet, c.row_no, c.col_no, c.value from cells c join m_hrow h on c.sheet = h.sheet
where c.row_no > h.header_row and c.row_no <= h.header_row + {config.TAG_SAMPLE_ROWS}"""
M_DEPS = {
    "win": ["m_hrow", "cells"],
    "m_hdr": ["cells"], "m_first": ["m_hdr"], "m_cols": ["m_first", "m_hdr"], "m_rows": ["m_cols", "cells"],
    "m_class": ["m_rows"], "m_fc": ["m_hdr", "cells"], "m_master": ["m_class", "m_fc"],
    "m_hrow": ["cells"], "m_tags": ["m_hrow", "cells"],
}


def _msql(body: str, *views: str) -> str:
    return with_views(body, *views, extra=M_VIEWS, extra_deps=M_DEPS)


@query("sheet_columns", "M1-M3", _msql(
    "select sheet, plant_col, sap_col, tol_col, desc_col, reconstructed_material_from_tol, forecast_col_count "
    "from m_cols", "m_cols"))
def q_sheet_columns(spark, sf_dir):
    return mb.sheet_columns(cells(spark, sf_dir))


@query("sheet_row_classes", "M4/M6", _msql("select * from m_class", "m_class"))
def q_sheet_row_classes(spark, sf_dir):
    return mb.classify_rows(cells(spark, sf_dir))


@query("rightmost_forecast", "M5", _msql("select * from m_fc", "m_fc"))
def q_rightmost_forecast(spark, sf_dir):
    return mb.rightmost_forecast(cells(spark, sf_dir))


@query("build_master", "M7", _msql("select * from m_master", "m_master"))
def q_build_master(spark, sf_dir):
    return mb.build_master(cells(spark, sf_dir))


@query("extraction_audit", "M8", _msql(f"""
select s.sheet, s.plant_col, s.sap_col, s.tol_col, s.desc_col, s.reconstructed_material_from_tol,
  s.forecast_col_count, {HR} as header_row, coalesce(k.ext, 0) as rows_extracted,
  cast(greatest(e.max_row - {HR}, 0) - coalesce(k.ext, 0) - coalesce(k.mis, 0) as bigint) as rows_skipped_blank,
  coalesce(k.mis, 0) as rows_skipped_missing_material
from m_cols s join (select sheet, max(row_no) as max_row from cells group by sheet) e on e.sheet = s.sheet
left join (select sheet, count(*) filter (where row_class = 'extracted') as ext,
             count(*) filter (where row_class = 'missing_material') as mis from m_class group by sheet) k
  on k.sheet = s.sheet
""", "m_cols", "m_class", "cells"))
def q_extraction_audit(spark, sf_dir):
    return mb.extraction_audit(cells(spark, sf_dir))


@query("forecast_source_distribution", "M8", _msql(
    "select Supplier as sheet, Forecast_Source_Column, count(*) as n_rows from m_master "
    "where Forecast_Source_Column <> '' group by 1, 2", "m_master"))
def q_forecast_source_distribution(spark, sf_dir):
    return mb.forecast_source_distribution(cells(spark, sf_dir))


@query("formula_survey", "M9", _msql(f"""
select sheet, max(row_no) as max_row, max(col_no) as max_col,
  count(*) filter (where starts_with({_SHOWN}, '=')) as formula_count,
  count(*) filter (where starts_with({_SHOWN}, '=') and contains({_SHOWN}, '#REF!')) as ref_error_count
from cells group by rollup(sheet)
""", "cells"))
def q_formula_survey(spark, sf_dir):
    return mb.formula_survey(cells(spark, sf_dir))


@query("broken_formula_samples", "M10", _msql(f"""
select sheet, cast(rn as int) as rank, row_no, col_no, formula, substring(formula, 1, 200) as shown from (
  select sheet, row_no, col_no, {_SHOWN} as formula,
    row_number() over (partition by sheet order by row_no, col_no) as rn
  from cells where starts_with({_SHOWN}, '=') and contains({_SHOWN}, '#REF!')) x
where rn <= {config.BROKEN_FORMULA_SAMPLES}
""", "cells"))
def q_broken_formula_samples(spark, sf_dir):
    return mb.broken_formula_samples(cells(spark, sf_dir))


@query("header_row", "M11", _msql("select * from m_hrow", "m_hrow"))
def q_header_row(spark, sf_dir):
    return mb.header_row(cells(spark, sf_dir))


@query("header_tags", "M12", _msql("select * from m_tags", "m_tags"))
def q_header_tags(spark, sf_dir):
    return mb.header_tags(cells(spark, sf_dir))


@query("tagged_samples", "M13", _msql(f"""
select r.sheet, r.row_no, l.header, w.value
from (select distinct w.sheet, w.row_no from win w join m_tags t on w.sheet = t.sheet and w.col_no = t.col_no
      where t.tags <> '' and w.value is not null) r
join (select sheet, header, max(col_no) as col_no from m_tags where tags <> '' group by sheet, header) l
  on l.sheet = r.sheet
left join win w on w.sheet = r.sheet and w.row_no = r.row_no and w.col_no = l.col_no
""", "m_tags", "win"))
def q_tagged_samples(spark, sf_dir):
    return mb.tagged_samples(cells(spark, sf_dir))

