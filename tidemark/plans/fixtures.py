"""Finance-shaped views over the star-schema tables. The text is the same for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.stored import kept

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")

VIEWS = {
    "fx_segments": """select lpad(cast(l_partkey as string), 6, '0') as gvkey, 'GEOSEG' as stype, cast(l_linenumber as string) as sid,
  case when l_linenumber = 7 then null when l_linenumber = 6 then '' when r_name = 'AMERICA' then 'United States' else r_name end as gareag, n_name as gareat,
  last_day(make_date(year(l_shipdate), quarter(l_shipdate) * 3, 1)) as srcdate, last_day(make_date(year(l_shipdate), quarter(l_shipdate) * 3 - 1, 1)) as datadate,
  case when l_returnflag = 'R' then null else floor((l_extendedprice * (1 - l_discount)) * 1e2 + 0.50001) / 1e2 end as sales,
  case when l_linenumber % 3 = 0 then null else l_extendedprice end as revts, l_quantity as ias
from {lineitem} join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "fx_returns_once": """select l_partkey as permno, last_day(cast(l_shipdate as date)) as date, floor((avg((l_discount - 0.05) * 2)) * 1e6 + 0.50001) / 1e6 as ret,
  floor((avg(l_extendedprice / l_quantity)) * 1e4 + 0.50001) / 1e4 as prc, floor((sum(l_extendedprice)) * 1e2 + 0.50001) / 1e2 as mktcap, sum(l_quantity) as vol,
  cast(100 + (l_partkey * 37) % 9900 as int) as siccd, year(last_day(cast(l_shipdate as date))) as year
from {lineitem} group by l_partkey, last_day(cast(l_shipdate as date))""",
    # shards overlap in the first quarter, whose rows come again in the shard of the year before, with other returns
    "fx_returns": """select * from {fx_returns_once} union all
select permno, date, ret + 0.25 as ret, prc, mktcap, vol, siccd, year - 1 as year from {fx_returns_once} where month(date) <= 3 and permno % 3 = 0""",
    "fx_links": """select lpad(cast(p_partkey as string), 6, '0') as gvkey, p_partkey as permno, date '1995-01-01' as linkdt,
  case when p_partkey % 5 = 0 then date '1999-06-30' else null end as linkenddt, case when p_partkey % 4 = 0 then 'LC' else 'LU' end as linktype, 'P' as linkprim from {part}
union all select lpad(cast(p_partkey + 1 as string), 6, '0'), p_partkey, date '1999-01-01', null, 'LU', 'C' from {part} where p_partkey % 5 = 0
union all select lpad(cast(p_partkey as string), 6, '0'), p_partkey, date '1995-01-01', null, 'LU', 'P' from {part} where p_partkey % 7 = 1 and p_partkey % 5 <> 0 and p_partkey % 4 <> 0""",
    "fx_funda_once": """select lpad(cast(l_partkey as string), 6, '0') as gvkey, make_date(year(l_shipdate), 12, 31) as datadate,
  case when l_partkey % 3 = 0 then null else make_date(year(l_shipdate) + 1, 2, 14) end as pdate, case when l_partkey % 4 = 0 then null else make_date(year(l_shipdate) + 1, 3, 16) end as fdate,
  floor((sum(l_extendedprice) * 2) * 1e2 + 0.50001) / 1e2 as at, floor((sum(l_extendedprice)) * 1e2 + 0.50001) / 1e2 as sale, floor((sum(l_extendedprice) * 0.8) * 1e2 + 0.50001) / 1e2 as ceq,
  floor((sum(l_extendedprice * l_discount)) * 1e2 + 0.50001) / 1e2 as ni, floor((sum(l_extendedprice * l_tax)) * 1e2 + 0.50001) / 1e2 as capx,
  case when l_partkey % 2 = 0 then null else floor((sum(l_tax) * 100) * 1e2 + 0.50001) / 1e2 end as xrd, floor((sum(l_quantity) * 10) * 1e2 + 0.50001) / 1e2 as dltt,
  case when l_partkey % 7 = 0 then null else floor((sum(l_quantity)) * 1e2 + 0.50001) / 1e2 end as dlc, year(l_shipdate) as year
from {lineitem} group by l_partkey, year(l_shipdate)""",
    # reports come again in the next shard, restated
    "fx_funda": """select * from {fx_funda_once} union all
select gvkey, datadate, pdate, fdate, f.at * 2 as at, sale, ceq, ni, capx, xrd, dltt, dlc, year + 1 as year from {fx_funda_once} f where cast(gvkey as int) % 11 = 0""",
    "fx_factors_once": """select last_day(cast(l_shipdate as date)) as dateff, floor((100 * avg(l_discount - 0.05)) * 1e6 + 0.50001) / 1e6 * 4 as mktrf, floor((avg(l_tax - 0.04)) * 1e6 + 0.50001) / 1e6 as smb,
  floor((avg(case when l_returnflag = 'A' then l_discount else 0.0 end) - 0.02) * 1e6 + 0.50001) / 1e6 as hml, floor((avg(case when l_linestatus = 'F' then l_discount else 0.0 end) - 0.02) * 1e6 + 0.50001) / 1e6 as umd,
  cast(0.002 as double) as rf, year(last_day(cast(l_shipdate as date))) as year
from {lineitem} group by last_day(cast(l_shipdate as date))""",
    "fx_factors": """select * from {fx_factors_once} union all select dateff, mktrf + 0.01, smb, hml, umd, rf, year - 1 as year from {fx_factors_once} where month(dateff) <= 3""",
    "fx_macro": """select 'REV_' || r_name as series_id, case when r_name = 'AMERICA' then 'United States' else r_name end as macro_area, make_date(year(o_orderdate), month(o_orderdate), 1) as date,
  last_day(make_date(year(o_orderdate), month(o_orderdate), 1)) + 7 as available_date, floor((sum(o_totalprice) / 1000) * 1e4 + 0.50001) / 1e4 as value
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey where r_name <> 'AFRICA' group by r_name, year(o_orderdate), month(o_orderdate)
union all select 'FEDFUNDS', 'GLOBAL', make_date(year(o_orderdate), month(o_orderdate), 1), last_day(make_date(year(o_orderdate), month(o_orderdate), 1)) + 7, floor((avg(o_totalprice) / 100000) * 1e6 + 0.50001) / 1e6
from {orders} group by year(o_orderdate), month(o_orderdate)""",
    # series without an area: one the fixed map knows, one it does not, and a table that has areas for some rows only
    "fx_macro_bare": """select case series_id when 'REV_ASIA' then 'unrate' when 'REV_EUROPE' then 'DTWEXBGS' else series_id end as series_id, date, available_date, value from {fx_macro}""",
    "fx_macro_partly": """select series_id, case when series_id = 'FEDFUNDS' or month(date) % 2 = 0 then null else macro_area end as macro_area, date, available_date, value,
  case when series_id = 'FEDFUNDS' then 'fred_initial_release' else 'configured_release_lag' end as timing_source, true as lookahead_safe, series_id = 'FEDFUNDS' as revision_safe from {fx_macro}""",
    "fx_filings_once": """select distinct gvkey, datadate from {fx_segments} where cast(gvkey as int) % 3 <> 0""",
    # two thirds of the firms file, half of them with a preliminary date; every fourth files again later
    "fx_filings": """select gvkey, datadate, case when cast(gvkey as int) % 2 = 0 then datadate + 45 end as pdate, datadate + 60 as fdate from {fx_filings_once}
union all select gvkey, datadate, datadate + 75, null from {fx_filings_once} where cast(gvkey as int) % 4 = 1
union all select gvkey, datadate, null, null from {fx_filings_once} where cast(gvkey as int) % 5 = 1""",
}


#: Small views that others read several times, over all rows of large tables: written once a session.
WRITTEN = ("fx_filings_once",)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the star schema, or one of VIEWS over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = [t for t in (*TABLES, *VIEWS) if "{" + t + "}" in text]
    build = lambda: spark.sql(text, **{t: view(spark, sf_dir, t) for t in used})
    return kept(spark, sf_dir, name, build) if name in WRITTEN else build()


def duckdb_views() -> str:
    """The views as common table expressions."""
    names = {t: t for t in (*TABLES, *VIEWS)}
    return ",\n".join(f"{name} as ({text.format(**names)})" for name, text in VIEWS.items())
