"""Queries through the sources and sinks: what is written in the shared folder and read back must be the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import gates, reports
from ..sources import sinks, tables
from ..sources.stored import shared_dir
from . import registry as base
from .fixtures import view

d6, q6 = base._d6, base.q6


def _fresh(s: SparkSession, label: str) -> str:
    return f"{shared_dir(s)}/tidemark_{label}_{uuid.uuid4().hex}"


def _shards(s: SparkSession, d: str) -> DataFrame:
    """Returns by year, of which the early ones were written before and lack the volume."""
    root, rows = _fresh(s, "shards"), view(s, d, "fx_returns_once")
    tables.write_shards(rows.where(F.col("year").isin(tables.year_list("1990-1993,1995"))).drop("vol"), root, "returns")
    tables.write_shards(rows, root, "returns")
    return tables.read_shards(s, root, "returns").select("permno", "date", "year", q6("ret").alias("ret"), "siccd", q6("vol").alias("vol"))


def _optional_shards(s: SparkSession, d: str) -> DataFrame:
    """Rows a year of each data set; one that was never written has none."""
    root = _fresh(s, "shards")
    for name in ("factors", "funda"):
        tables.write_shards(view(s, d, f"fx_{name}_once"), root, name)
    found = {name: tables.read_optional_shards(s, root, name) for name in ("factors", "funda", "links")}
    return gates.all_of(*(t.groupBy("year").agg(F.lit(name).alias("dataset"), F.count("*").alias("n")) for name, t in found.items() if t is not None))


def _missing_years(s: SparkSession, d: str) -> DataFrame:
    path, rows = _fresh(s, "years"), view(s, d, "fx_funda_once")
    years = [r["year"] for r in rows.select("year").distinct().collect()]  # one row a year
    first, second, third = (tables.write_missing_years(rows, path, y) for y in (sorted(years)[:2], years, years))
    back = s.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), q6(F.sum("sale")).alias("sale"))
    return back.withColumn("call", F.when(F.col("year").isin(first), 1).when(F.col("year").isin(second), 2).when(F.col("year").isin(third), 3))


def _summaries(s: SparkSession, d: str) -> DataFrame:
    """Yearly summaries of two runs through CSV files, one with a column more, and of a run that has none."""
    root, rows = _fresh(s, "csv"), view(s, d, "fx_returns_once").groupBy("year")
    schema = "year int, n long, largest double"
    sinks.write_csv(rows.agg(F.count("*").alias("n"), F.max("mktcap").alias("largest")), f"{root}/a")
    sinks.write_csv(rows.agg(F.count("*").alias("n"), F.min("mktcap").alias("largest"), F.count_distinct("permno").alias("firms")), f"{root}/b")
    runs = {"a": schema, "b": f"{schema}, firms long", "c": schema}
    return tables.union_tagged({f"run_{k}": tables.read_csv(s, f"{root}/{k}", v, optional=k == "c") for k, v in runs.items()})


def _scanned(s: SparkSession, d: str) -> DataFrame:
    """Predictions of two variants as texts, of which some are no numbers."""
    root, rows = _fresh(s, "predictions"), view(s, d, "fx_returns_once")
    for variant, sign in (("all", 1), ("segment_only", -1)):
        prediction = F.when(F.col("permno") % 10 == 3, "n/a").otherwise((sign * F.col("ret")).cast("string"))
        out = rows.select(F.when(F.col("permno") % 10 != 4, F.col("date").cast("string")).alias("date"), F.col("permno").cast("string").alias("permno"), prediction.alias("prediction"), F.col("ret").cast("string").alias("target"))
        sinks.write_table(out, f"{root}/lgbm_{variant}_predictions.parquet")
    read = tables.read_predictions(s, [f"{root}/lgbm_{v}_predictions.parquet" for v in ("all", "segment_only")], "lgbm", "run_x")
    return base._q(read, "prediction", "target")


#: Series in the order in which they are loaded; the last is not there.
LOADED = ("FEDFUNDS", "REV_ASIA", "REV_NOWHERE", "REV_EUROPE")


def _partial(s: SparkSession, d: str) -> DataFrame:
    """What a load had before its error, with the status of the load."""
    path, rows = _fresh(s, "series"), view(s, d, "fx_macro")

    def load(name: str) -> DataFrame:
        own = rows.where(F.col("series_id") == name)
        if own.isEmpty():
            raise LookupError("no such series")
        return own

    done = sinks.load_series(LOADED, load, path)
    status = [F.lit(done[k]).alias(k) for k in ("status", "series_attempted", "series_completed", "error")]
    return s.read.parquet(f"{path}.partial").select("series_id", "date", q6("value").alias("value"), *status)


WRITTEN = {"fx_links": 6, "fx_funda_once": 13, "fx_factors_once": 7}


def _written(s: SparkSession, d: str) -> DataFrame:
    """Rows and columns of written tables, by way of a JSON manifest of a line a table."""
    root = _fresh(s, "tables")
    infos = {t: tables.table_info(sinks.write_table(view(s, d, t), f"{root}/{t}")).first().asDict() for t in WRITTEN}
    sinks.write_json(s, {t: {"rows": i["rows"], "columns": i["columns"], "stored": i["files"] > 0 and i["bytes"] > 0} for t, i in infos.items()}, f"{root}/manifest")
    read = F.from_json("value", "map<string,struct<rows:bigint,columns:int,stored:boolean>>")
    return s.read.text(f"{root}/manifest").select(F.explode(read).alias("table", "i")).select("table", "i.*")


def _inventory(s: SparkSession, d: str) -> DataFrame:
    """The header lines of the CSV files of two families, each with one folder a table."""
    root = _fresh(s, "inventory")
    for family, name in (("firms", "fx_links"), ("firms", "fx_funda_once"), ("market", "fx_factors_once")):
        sinks.write_csv(view(s, d, name), f"{root}/{family}_{name}", parts=True)
    got = gates.all_of(*(sinks.table_inventory(s, {f: f"{root}/{f}_*"}) for f in ("firms", "market")))
    return got.select("family", "sample_columns", F.size(F.split("sample_columns", ",")).alias("columns"))


QUERY = ("SELECT ", " FROM part WHERE p_name = ")


def _quoted(s: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit("'s"))
    text = F.concat(F.lit(QUERY[0]), fn.quoted(F.concat(F.col("p_brand"), F.lit('"')), '"'), F.lit(QUERY[1]), fn.quoted(name))
    return view(s, d, "part").select("p_partkey", text.alias("query")).withColumn("query_hash", fn.text_hash(F.col("query")))


SHOWN = {"model_family": "Model", "variant": "Variant", "prediction_rows": "Rows"}
CAPTION, LABEL = "Models of the development sample", "tab:models"


def _report(s: SparkSession, d: str) -> DataFrame:
    shown = reports.displayed(reports.model_comparison(base._summary(s, d)).select(*SHOWN), SHOWN)
    return gates.all_of(*(reports.rendered(shown, form, ["Model", "Variant"], caption=CAPTION, label=LABEL).withColumn("form", F.lit(form)) for form in reports.ESCAPES))


def _report_sql() -> str:
    cells = ("m", "variant", "n")
    plain = "select case model_family when 'lgbm' then 'LightGBM' else 'Deep Sets' end as m, variant, format('{:,}', prediction_rows) as n from msum"
    latex = [rf"regexp_replace({c}, '([&%$#_{{}}])', '\\\1', 'g')" for c in cells]
    html = ["replace(replace(replace(replace(" + c + ", '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')" for c in cells]
    rows = {
        "markdown": "'| ' || " + " || ' | ' || ".join(f"replace({c}, '|', '\\|')" for c in cells) + " || ' |'",
        "latex": " || ' & ' || ".join(latex) + r" || ' \\'",
        "html": "'<tr><td>' || " + " || '</td><td>' || ".join(html) + " || '</td></tr>'",
    }
    heads = {
        "markdown": (["| Model | Variant | Rows |", "| --- | --- | --- |"], []),
        "latex": (["\\begin{table}[!htbp]", "\\centering", f"\\caption{{{CAPTION}}}", f"\\label{{{LABEL}}}", "\\begin{tabular}{lll}", "\\toprule", r"Model & Variant & Rows \\", "\\midrule"], ["\\bottomrule", "\\end{tabular}", "\\end{table}"]),
        "html": ([f'<table id="{LABEL}">', f"<caption>{CAPTION}</caption>", "<tr><th>Model</th><th>Variant</th><th>Rows</th></tr>"], ["</table>"]),
    }
    parts = []
    for form, text in rows.items():
        parts.append(f"select '{form}' as form, 1 as part, row_number() over (order by m, variant, n) as line, {text} as text from ({plain})")
        parts += [f"select '{form}', {part}, {i + 1}, '{x}' from msum having count(*) > 0" for part, lines in zip((0, 2), heads[form], strict=True) for i, x in enumerate(lines)]
    return " union all ".join(parts)


REGISTERED: dict[str, tuple] = {
    "yearly_shards": (
        _shards,
        f"select permno, date, year, {d6('ret')}, siccd, {d6('case when year between 1990 and 1993 or year = 1995 then null else vol end', 'vol')} from fx_returns_once",
    ),
    "optional_shards": (
        _optional_shards,
        "select year, 'factors' as dataset, count(*) as n from fx_factors_once group by 1 union all select year, 'funda', count(*) from fx_funda_once group by 1",
    ),
    "missing_years": (
        _missing_years,
        f"select year, count(*) as n, {d6('sum(sale)', 'sale')}, case when year in (select distinct year from fx_funda_once order by year limit 2) then 1 else 2 end as call from fx_funda_once group by year",
    ),
    "csv_summaries": (
        _summaries,
        "select year, count(*) as n, max(mktcap) as largest, null as firms, 'run_a' as model_run_id from fx_returns_once group by 1 union all select year, count(*), min(mktcap), count(distinct permno), 'run_b' from fx_returns_once group by 1",
    ),
    "prediction_scan": (
        _scanned,
        " union all ".join(f"select date, permno, {d6(f'{sign} * ret', 'prediction')}, {d6('ret', 'target')}, '{v}' as variant, 'lgbm' as model_family, 'run_x' as model_run_id from fx_returns_once where permno % 10 not in (3, 4) and ret is not null" for v, sign in (("all", 1), ("segment_only", -1))),
    ),
    "partial_load": (
        _partial,
        f"select series_id, date, {d6('value')}, 'api_error' as status, 3 as series_attempted, 2 as series_completed, 'REV_NOWHERE: no such series' as error from fx_macro where series_id in ('FEDFUNDS', 'REV_ASIA')",
    ),
    "written_tables": (
        _written,
        " union all ".join(f"select '{t}' as \"table\", count(*) as rows, {n} as columns, true as stored from {t}" for t, n in WRITTEN.items()),
    ),
    "csv_inventory": (
        _inventory,
        "select 'firms' as family, 'gvkey,permno,linkdt,linkenddt,linktype,linkprim' as sample_columns, 6 as columns from fx_links having count(*) > 0 union all select 'firms', 'gvkey,datadate,pdate,fdate,at,sale,ceq,ni,capx,xrd,dltt,dlc,year', 13 from fx_funda_once having count(*) > 0 union all select 'market', 'dateff,mktrf,smb,hml,umd,rf,year', 7 from fx_factors_once having count(*) > 0",
    ),
    "normal_labels": (
        lambda s, d: view(s, d, "fx_segments").groupBy(fn.normal_label(F.col("gareag")).alias("label")).agg(F.count("*").alias("n"), F.count_distinct("gvkey").alias("firms")),
        "select coalesce(nullif(upper(trim(gareag)), ''), 'UNKNOWN') as label, count(*) as n, count(distinct gvkey) as firms from fx_segments group by 1",
    ),
    "quarter_ends": (
        lambda s, d: view(s, d, "orders").groupBy(fn.quarter_end(F.col("o_orderdate").cast("date")).alias("quarter")).agg(F.count("*").alias("n"), q6(F.sum("o_totalprice")).alias("price")),
        f"select last_day(cast(date_trunc('quarter', o_orderdate) + interval 2 month as date)) as quarter, count(*) as n, {d6('sum(o_totalprice)', 'price')} from orders group by 1",
    ),
    "quoted_queries": (
        _quoted,
        f"select p_partkey, query, substr(sha256(query), 1, 16) as query_hash from (select p_partkey, '{QUERY[0]}\"' || p_brand || '\"\"\"{QUERY[1]}''' || replace(p_name, '''', '''''') || '''''s''' as query from part)",
    ),
    "report_tables": (_report, _report_sql()),
}
