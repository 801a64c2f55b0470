"""All queries over the star-schema tables, by name, and the same rows in DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import exposure_panel, features, gates, macro, models, panel, reports, robustness, xsec
from ..sources import catalog, tables
from ..sources.stored import kept
from .fixtures import duckdb_views, view

Query = Callable[[SparkSession, str], DataFrame]


def q6(c: str | Column) -> Column:
    return fn.stepped(F.col(c) if isinstance(c, str) else c)


def _q(df: DataFrame, *doubles: str) -> DataFrame:
    """The named columns on a grid of 1e-6, so both engines agree on the last digits."""
    return df.withColumns({c: q6(c) for c in doubles})


def _snaps(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "snapshots", lambda: panel.stepped_shares(panel.snapshots(view(spark, d, "fx_segments"))))


def _active(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots with their activation dates, which the panel reads twice."""
    return kept(spark, d, "active", lambda: panel.activation_dates(panel.stepped_shares(panel.snapshots(view(spark, d, "fx_segments"))), view(spark, d, "fx_filings")))


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """The monthly panel, built once a session and input folder."""
    return kept(spark, d, "panel", lambda: _built_panel(spark, d))


def _built_panel(spark: SparkSession, d: str) -> DataFrame:
    rows = panel.monthly_panel(view(spark, d, "fx_returns"), view(spark, d, "fx_links"), _active(spark, d), view(spark, d, "fx_funda"), view(spark, d, "fx_factors"))
    return rows.withColumns({c: fn.stepped(F.col(c), 9) for c in ("excess_ret", "next_month_excess_ret")})


def _usable(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d).where("foreign_share IS NOT NULL AND next_month_excess_ret IS NOT NULL AND date <= date '2025-12-31'")


def _sorted(spark: SparkSession, d: str) -> DataFrame:
    return xsec.quintiles(_usable(spark, d), "foreign_share")


def _spread(spark: SparkSession, d: str) -> DataFrame:
    return xsec.spreads(xsec.quintile_returns(_sorted(spark, d), ["date"], "next_month_excess_ret", "foreign_share"), ["date"])


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "tokens", lambda: panel.geo_tokens(view(spark, d, "fx_segments")))


def _set_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of sets with shares as decimals, so sums and ranks are exact."""
    return features.set_tokens(_tokens(spark, d)).withColumn("revenue_share", fn.stepped(F.col("revenue_share"), 9).cast("decimal(12,9)"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    return macro.macro_states(view(spark, d, "fx_macro"))


def _firm_months(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d).select("gvkey", "permno", "date", "segment_srcdate").distinct()


def _tensor(spark: SparkSession, d: str) -> DataFrame:
    return macro.macro_tensor(_panel(spark, d).select("gvkey", "permno", "date", "segment_srcdate", "foreign_share"), _tokens(spark, d), _states(spark, d), ["rev_america", "fedfunds"])


def _on_tokens(spark: SparkSession, d: str) -> DataFrame:
    return macro.macro_on_tokens(_firm_months(spark, d).join(_tokens(spark, d), ["gvkey", "segment_srcdate"]), _states(spark, d))


def _stacked(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    one = df.agg(*(c.cast("double").alias(k) for k, c in metrics.items()))
    return one.unpivot([], list(metrics), "metric", "value").withColumn("value", q6("value"))


def _panel_profile(spark: SparkSession, d: str) -> DataFrame:
    return _stacked(_panel(spark, d), {
        "rows": F.count("*"), "permnos": F.count_distinct("permno"), "months": F.count_distinct("date"), "mean_foreign_share": F.avg("foreign_share"),
        "with_fundamentals": F.count("at"), "with_next_return": F.count("next_month_ret"), "violations": F.sum(F.when(F.col("date") <= F.col("segment_activation_date"), 1).otherwise(0)),
    })


def _activation_gate(spark: SparkSession, d: str) -> DataFrame:
    late = F.coalesce(F.sum(F.when(F.col("date") <= F.col("segment_activation_date"), 1)), F.lit(0))
    return _panel(spark, d).agg(late.cast("long").alias("violations")).select(F.lit("activation_rule").alias("check"), "violations", F.when(F.col("violations") == 0, "ok").otherwise("needs_review").alias("status"))


def _turnover(spark: SparkSession, d: str) -> DataFrame:
    return xsec.turnover(_sorted(spark, d).withColumn("variant", F.lit("foreign_share")), ["variant"])


def _net(spark: SparkSession, d: str) -> DataFrame:
    rows = _spread(spark, d).join(_turnover(spark, d).select("date", "long_short_turnover"), "date", "left")
    return rows.select("date", q6("q5_minus_q1").alias("gross"), q6(xsec.net_of_cost(F.col("q5_minus_q1"), F.col("long_short_turnover"), 10.0)).alias("net"))


FACTORS = ["mktrf", "smb", "hml", "umd"]
#: family, run, variant and score of the models whose predictions the evaluation queries take.
MODELS = (
    ("lgbm", "run_a", "segment_only", "foreign_share"), ("lgbm", "run_a", "all", "geo_hhi * 0.5 + foreign_share"),
    ("lgbm", "run_a", "macro_only", "foreign_share * 0"), ("deepsets", "run_b", "set_only", "top_geo_share - domestic_share"),
)


def _alpha(spark: SparkSession, d: str) -> DataFrame:
    factors = panel.scaled_factors(view(spark, d, "fx_factors"))
    rows = _spread(spark, d).withColumn("factor_date", fn.next_month_end(F.col("date"))).withColumn("variant", F.lit("foreign_share")).join(factors, "factor_date", "left")
    return _q(robustness.factor_alphas(rows, ["variant"], "q5_minus_q1", FACTORS), "alpha", "alpha_t", "r2", *(f"beta_{c}" for c in FACTORS))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = _usable(spark, d).withColumn("_m", F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(robustness.MODEL, m, strict=False)), fn.stepped(F.expr(m[3]), 9).alias("prediction")) for m in MODELS))))
    return rows.select("_m.*", "gvkey", "permno", "date", F.col("next_month_excess_ret").alias("target"), F.year("date").alias("fold_year"), (F.year("date") + 1000).cast("long").alias("train_rows"))


def _robust(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "robustness", lambda: robustness.robustness_summary(_predictions(spark, d), panel.scaled_factors(view(spark, d, "fx_factors")), FACTORS))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "summary", lambda: robustness.model_summary(_predictions(spark, d)))


def solution_terms(k: int) -> list[tuple[str, str]]:
    """(name, SQL) of the least-squares coefficients beta0.. and the first column a0.. of the inverse of X'X, by Cholesky, from
    s<i>_<j> and b<i>, sums of products of the k + 1 regressors and with y. A regressor that depends on earlier ones gets
    0. Each term uses earlier names only; for DuckDB."""
    n = range(k + 1)
    out: list[tuple[str, str]] = []
    for i in n:
        for j in range(i):
            out.append((f"l{i}_{j}", f"(s{i}_{j}" + "".join(f" - l{i}_{m} * l{j}_{m}" for m in range(j)) + f") * g{j}"))
        rest = f"s{i}_{i}" + "".join(f" - l{i}_{m} * l{i}_{m}" for m in range(i))
        out.append((f"g{i}", f"case when {rest} > 1e-10 * s{i}_{i} then 1 / sqrt({rest}) else 0e0 end"))
    for name, right in (("beta", [f"b{i}" for i in n]), ("a", ["1e0", *["0e0"] * k])):
        out += [(f"{name}z{i}", f"({right[i]}" + "".join(f" - l{i}_{m} * {name}z{m}" for m in range(i)) + f") * g{i}") for i in n]
        out += [(f"{name}{i}", f"({name}z{i}" + "".join(f" - l{m}_{i} * {name}{m}" for m in range(i + 1, k + 1)) + f") * g{i}") for i in reversed(n)]
    return out


def alpha_sql(source: str, by: str, y: str, out: dict[str, str]) -> str:
    """Least squares by the operator's terms, for DuckDB; `source` has date, y, the factors and the columns of `by`."""
    x = ["1e0", *FACTORS]
    n = range(len(x))
    sums = ", ".join([*(f"sum({x[i]} * {x[j]}) as s{i}_{j}" for i in n for j in range(i + 1)), *(f"sum({x[i]} * y) as b{i}" for i in n)])
    solved = f"(select {by}, count(*) as n_months, {sums} from (select *, {y} as y from {source} where {' and '.join(f'{c} is not null' for c in [y, *FACTORS])}) group by {by})"
    for k, t in solution_terms(len(FACTORS)):
        solved = f"(select *, {t} as {k} from {solved})"  # one level a term, as names of one level would be spelled out in each other
    dot = lambda c: " + ".join(f"{c}{i} * {x[i]}" for i in n)
    lagged = " + ".join(f"{2 * (1 - j / 7)!r} * coalesce(lag(w, {j}) over (partition by {by} order by date), 0)" for j in range(1, 7))
    shown = {"alpha": "beta0", "alpha_t": "case when v > 0 then beta0 / sqrt(v) end", "r2": "case when vy > 0 then 1 - sse / (vy * n_months) end", **{f"beta_{f}": f"beta{i + 1}" for i, f in enumerate(FACTORS)}}
    picked = ", ".join(_d6(f"case when n_months >= {robustness.least_months(FACTORS)} then {shown[k]} end", name) for k, name in out.items())
    return f"""(select {by}, n_months, {picked} from (select {by}, n_months, {', '.join(f'beta{i}' for i in n)}, sum(w * (w + {{lag}})) as v, sum(e * e) as sse, var_pop(y) as vy from
 (select *, {lagged} as lag from (select *, e * ({dot('a')}) as w from (select r.*, n_months, {', '.join(f'beta{i}, a{i}' for i in n)}, y - ({dot('beta')}) as e from (select {by}, date, {y} as y, {', '.join(FACTORS)} from {source} where {' and '.join(f'{c} is not null' for c in [y, *FACTORS])}) r join
 {solved} using ({by})))) group by {by}, n_months, {', '.join(f'beta{i}' for i in n)}))""".replace("{lag}", "lag")


def _period(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("y"),
        F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'M' || lpad(cast(month(o_orderdate) as string), 2, '0') WHEN 1 THEN 'Q' || cast(quarter(o_orderdate) as string) WHEN 2 THEN cast(year(o_orderdate) as string) || 'Q' || cast(quarter(o_orderdate) as string) WHEN 3 THEN cast(year(o_orderdate) as string) WHEN 4 THEN substr(cast(cast(o_orderdate as date) as string), 1, 10) ELSE 'x' END").alias("period"),
    )
    return rows.select("o_orderkey", "period", fn.period_to_date(F.col("period"), F.col("y")).alias("period_end"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_segments").select("gareag", "gareat").distinct().select("*", fn.geo_label(F.col("gareag"), F.col("gareat")).alias("label"))


CHAIN = {
    "clean": "select gvkey, sid, srcdate, datadate, coalesce(nullif(gareag, ''), gareat) as geo_label, coalesce(sales, revts, ias) as sales from fx_segments where coalesce(sales, revts, ias) > 0",
    "geo": "select gvkey, srcdate, geo_label, sum(sales) as s, count(sid) as n, max(datadate) as datadate from clean group by all",
    "share": r"select *, s / sum(s) over (partition by gvkey, srcdate) as share, coalesce(regexp_matches(lower(trim(geo_label)), '\bunited states\b|\bu\.s\.?\b|\busa\b|\bus\b'), false) as home from geo",
    "snap": """select gvkey, srcdate as segment_srcdate, max(datadate) as segment_datadate, sum(s) as segment_sales_sum, count(distinct geo_label) as geo_count,
  floor(coalesce(sum(share) filter (where not home), 0) * 1e9 + 0.50001) / 1e9 as foreign_share, floor(coalesce(sum(share) filter (where home), 0) * 1e9 + 0.50001) / 1e9 as domestic_share,
  floor(sum(s * s) / (sum(s) * sum(s)) * 1e9 + 0.50001) / 1e9 as geo_hhi, floor(max(share) * 1e9 + 0.50001) / 1e9 as top_geo_share, cast(sum(n) as bigint) as segment_rows from share group by gvkey, srcdate""",
    "fil": "select *, coalesce(pdate, fdate) as filing_date, case when pdate is not null then 'pdate' when fdate is not null then 'fdate' else 'missing' end as filing_date_source from fx_filings qualify row_number() over (partition by gvkey, datadate order by coalesce(pdate, fdate) nulls last) = 1",
    "act": "select snap.*, coalesce(filing_date, segment_srcdate) + 1 as segment_activation_date, case when filing_date is not null then filing_date_source else 'srcdate_fallback' end as activation_source from snap left join fil f on f.gvkey = snap.gvkey and f.datadate = segment_datadate",
    "lks": "select distinct gvkey, permno, linkdt, linkenddt, linktype, linkprim from fx_links",
    "rets": "select * exclude (year) from fx_returns qualify row_number() over (partition by permno, date order by year desc) = 1",
    "lnk": "select l.gvkey, r.*, l.linkprim, l.linktype, l.linkdt from rets r join lks l on r.permno = l.permno and r.date >= linkdt and (linkenddt is null or r.date <= linkenddt)",
    "best": "select * exclude (linkprim, linktype, linkdt) from lnk qualify row_number() over (partition by permno, date order by linkprim desc, linktype desc, linkdt desc, gvkey desc) = 1",
    "act1": "select * from act qualify row_number() over (partition by gvkey, segment_activation_date order by segment_srcdate desc) = 1",
    "p1": "select b.*, a.* exclude (gvkey) from best b asof join act1 a on b.gvkey = a.gvkey and b.date > a.segment_activation_date",
    "fund": "select * exclude (pdate, fdate, datadate), datadate as funda_datadate, coalesce(pdate, fdate, cast(datadate + interval 6 month as date)) as funda_avail_date, case when pdate is not null then 'pdate' when fdate is not null then 'fdate' else 'fallback_6m' end as funda_avail_source from fx_funda",
    "fund1": "select * exclude (year) from fund qualify row_number() over (partition by gvkey, funda_avail_date order by funda_datadate desc, year desc) = 1",
    "p2": "select p1.*, f.* exclude (gvkey) from p1 asof left join fund1 f on p1.gvkey = f.gvkey and p1.date > f.funda_avail_date",
    "top": "select " + ", ".join(f"max(abs({c})) > 1 as x_{c}" for c in ("mktrf", "smb", "hml", "umd", "rf")) + " from fx_factors",
    "fac": "select dateff as factor_date, " + ", ".join(f"case when x_{c} then {c} / 100 else {c} end as {c}" for c in ("mktrf", "smb", "hml", "umd", "rf")) + " from fx_factors, top qualify row_number() over (partition by dateff order by year desc) = 1",
    "p3": "select p2.*, f.* exclude (factor_date), ret - f.rf as e from p2 left join fac f on p2.date = f.factor_date",
    "pan": "select * exclude (e), floor(e * 1e9 + 0.50001) / 1e9 as excess_ret, lead(ret) over (partition by permno order by date) as next_month_ret, floor(lead(e) over (partition by permno order by date) * 1e9 + 0.50001) / 1e9 as next_month_excess_ret from p3",
    "use_": "select * from pan where foreign_share is not null and next_month_excess_ret is not null and date <= date '2025-12-31'",
    "rk": "select *, row_number() over (partition by date order by foreign_share, permno) as r from use_",
    "sz": "select date, count(*) as n, count(distinct foreign_share) as dd from use_ group by date",
    "srt": "select rk.*, case when n >= 25 and dd >= 5 then cast(greatest(1, floor((5 * (r - 1) + n - 2) / (n - 1))) as int) end as quintile from rk join sz using (date)",
    "qr": "select date, quintile, avg(next_month_excess_ret) as mean_ret, count(distinct permno) as n, avg(foreign_share) as mean_score from srt where quintile is not null group by date, quintile",
    "spr": "select date, max(mean_ret) filter (where quintile = 5) as q5_ret, max(mean_ret) filter (where quintile = 1) as q1_ret, max(n) filter (where quintile = 5) as q5_n, max(n) filter (where quintile = 1) as q1_n from qr group by date having q5_n is not null and q1_n is not null",
    "legs": "select date, list(distinct permno) filter (where quintile = 5) as l, list(distinct permno) filter (where quintile = 1) as s from srt where quintile is not null group by date",
    "legs2": "select *, lag(l) over (order by date) as pl, lag(s) over (order by date) as ps from legs",
    "trn": "select date, case when pl is not null then 1 - len(list_intersect(l, pl)) / greatest(len(l), 1) end as lt, case when ps is not null then 1 - len(list_intersect(s, ps)) / greatest(len(s), 1) end as st, len(l) as ln, len(s) as sn from legs2",
    "ric0": "select date, foreign_share as x, next_month_excess_ret as y, rank() over (partition by date order by foreign_share) + (count(*) over (partition by date, foreign_share) - 1) / 2 as rx, rank() over (partition by date order by next_month_excess_ret) + (count(*) over (partition by date, next_month_excess_ret) - 1) / 2 as ry from use_",
    "ric": "select date, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) as rank_ic, count(*) as n from ric0 group by date having count(*) >= 25 and count(distinct x) >= 3 and count(distinct y) >= 3",
    "tok0": "select gvkey, srcdate as segment_srcdate, coalesce(geo_label, 'UNKNOWN') as geo_label, sum(sales) as segment_sales, count(sid) as segment_rows from clean group by all",
    "tok": "select *, segment_sales / sum(segment_sales) over (partition by gvkey, segment_srcdate) as revenue_share, {area} as macro_area from tok0".format(
        area="case " + " ".join("when " + " or ".join(f"contains(upper(trim(geo_label)), '{t}')" for t in terms) + f" then '{a}'" for a, terms in fn.AREA_TERMS.items()) + " else 'OTHER_FOREIGN' end"
    ),
    "tokx": "select gvkey, segment_srcdate, coalesce(nullif(upper(trim(geo_label)), ''), 'UNKNOWN') as geo_label, cast(floor(sum(revenue_share) * 1e9 + 0.50001) / 1e9 as decimal(12, 9)) as revenue_share from tok group by 1, 2, 3",
    "st0": "select {area} as macro_area, regexp_replace(lower(series_id), '[^a-z0-9]+', '_', 'g') as series_name, last_day(date) as observation_date, available_date, value from fx_macro".format(
        area="case " + " ".join("when " + " or ".join(f"contains(upper(trim(macro_area)), '{t}')" for t in terms) + f" then '{a}'" for a, terms in fn.AREA_TERMS.items()) + " else 'OTHER_FOREIGN' end"
    ),
    "st": "select *, value - lag(value, 1) over w as value_delta_1m, value - lag(value, 12) over w as value_delta_12m from st0 window w as (partition by macro_area, series_name order by available_date)",
    "mt0": "select p.gvkey, p.permno, p.date, p.segment_srcdate, geo_label, macro_area, revenue_share from (select distinct gvkey, permno, date, segment_srcdate from pan) p join tok t on p.gvkey = t.gvkey and p.segment_srcdate = t.segment_srcdate",
    "mt1": "select m.*, s.series_name, case when exists (select 1 from st x where x.series_name = s.series_name and x.macro_area = m.macro_area) then m.macro_area else 'GLOBAL' end as area from mt0 m, (select distinct series_name from st) s",
    "mt2": "select m.*, s.value, s.value_delta_1m, s.value_delta_12m from mt1 m asof left join st s on m.series_name = s.series_name and m.area = s.macro_area and m.date >= s.available_date",
    "mwide0": "select gvkey, permno, date, count(distinct geo_label) as token_rows, count(distinct geo_label) as geos, count(distinct macro_area) as areas, {sums} from mt2 group by all".format(
        sums=", ".join(f"sum(revenue_share * {c}) filter (where series_name = '{n}') as {n}_{c}" for n in ("rev_america", "fedfunds") for c in ("value", "value_delta_1m", "value_delta_12m"))
    ),
    "mcov": "select gvkey, permno, date, sum(case when known then revenue_share else 0 end) as covered from (select gvkey, permno, date, geo_label, any_value(revenue_share) as revenue_share, bool_or(value is not null or value_delta_1m is not null or value_delta_12m is not null) as known from mt2 group by 1, 2, 3, 4) group by 1, 2, 3",
}


def _reports_source(spark: SparkSession, d: str, *more: str | Column) -> DataFrame:
    """Reports under the source's names, some of them of other firms, with `more` of the table's columns."""
    kind = F.when(F.col("gvkey").cast("int") % 9 == 0, "FS").otherwise("INDL")
    return view(spark, d, "fx_funda_once").select("gvkey", "datadate", F.year("datadate").alias("fyear"), F.month("datadate").alias("fyr"), "fdate", "pdate", kind.alias("indfmt"), F.lit("STD").alias("datafmt"), F.lit("D").alias("popsrc"), F.lit("C").alias("consol"), *more)


def _returns_source(spark: SparkSession, d: str) -> DataFrame:
    text = {c: F.lit(None).cast("string") for c in ("cusip", "ticker", "sharetype", "securitytype", "securitysubtype", "usincflg")}
    rows = view(spark, d, "fx_returns_once").select("permno", F.col("permno").alias("permco"), "siccd", F.date_format("date", "yyyyMM").alias("yyyymm"), F.col("date").alias("mthcaldt"), F.col("ret").alias("mthret"), F.col("ret").alias("mthretx"), F.col("prc").alias("mthprc"), F.col("mktcap").alias("mthcap"), F.col("vol").alias("mthvol"))
    return rows.withColumns(text)


def _year(n: int) -> tuple:
    return date(n, 1, 1), date(n, 12, 31)


def _standard(spark: SparkSession, d: str) -> DataFrame:
    series = catalog.series_catalog(spark, [{"source": "bls", "series_id": "rev_america", "release_lag_days": 7}, {"series_id": "fedfunds", "timing": "fred_initial_release"}])
    seen = view(spark, d, "fx_macro").select("series_id", "date", "value", F.col("available_date").alias("realtime_start"), F.lit(None).cast("date").alias("realtime_end"))
    return _q(catalog.standard_frame(seen, series).drop("realtime_end"), "value")


M = "model_family, model_run_id, variant"
SUMMARY = ("mean_rank_ic", "t_rank_ic", "mean_q5_minus_q1", "t_q5_minus_q1")
ROBUST = ("mean_gross_q5_minus_q1", "t_gross_q5_minus_q1", "mean_net_q5_minus_q1", "t_net_q5_minus_q1", "mean_turnover", "gross_alpha", "gross_alpha_t", "net_alpha", "net_alpha_t", "factor_r2")
REVIEW = "case when {a} > 2 and {b} > 2 then 'positive {x} diagnostic' when {a} > 2 then 'positive {y} diagnostic' when {b} > 2 then 'positive {z} diagnostic' else 'weak diagnostic' end"


#: Queries whose SQL reads the given tables only.
PLAIN = ("period_parse", "table_estimates", "role_resolution", "daily_extract")
#: Parts of the chain that many others read.
OFTEN = ("pan", "pred", "pq", "prow", "rsum", "msum")


def _sql(final: str) -> str:
    more = model_chain()
    chain = CHAIN | (more if re.search(rf"\b({'|'.join(more)})\b", final) else {})
    return "with " + duckdb_views() + ",\n" + ",\n".join(f"{k} as {'materialized ' if k in OFTEN else ''}({v})" for k, v in chain.items()) + "\n" + final


def model_chain() -> dict[str, str]:
    """Predictions of MODELS and their evaluation."""
    t = lambda x, name: f"case when count({x}) >= 3 and stddev_samp({x}) > 0 then avg({x}) / (stddev_samp({x}) / sqrt(count({x}))) end as {name}"
    alphas = lambda y, out: alpha_sql("prow", M, y, out)
    return {
        "alph": "select 'foreign_share' as variant, spr.date, q5_ret - q1_ret as gap, mktrf, smb, hml, umd from spr left join fac on factor_date = last_day(cast(spr.date + interval 1 day as date))",
        "pred": " union all ".join(f"select '{a}' as model_family, '{b}' as model_run_id, '{v}' as variant, floor(({x}) * 1e9 + 0.50001) / 1e9 as prediction, gvkey, permno, date, next_month_excess_ret as target, year(date) as fold_year, cast(1000 + year(date) as bigint) as train_rows from use_" for a, b, v, x in MODELS),
        "prk": f"select *, row_number() over (partition by {M}, date order by prediction, permno) as r, count(*) over (partition by {M}, date) as n from pred",
        "pdd": f"select {M}, date, count(distinct prediction) as dd from pred group by all",
        "pq": f"select *, cast(greatest(1, floor((5 * (r - 1) + n - 2) / (n - 1))) as int) as quintile from prk join pdd using ({M}, date) where n >= 25 and dd >= 5",
        "psp": f"select {M}, date, avg(target) filter (where quintile = 5) - avg(target) filter (where quintile = 1) as gap from pq group by all having count(*) filter (where quintile = 5) > 0 and count(*) filter (where quintile = 1) > 0",
        "plegs": f"select {M}, date, list(distinct permno) filter (where quintile = 5) as l, list(distinct permno) filter (where quintile = 1) as s from pq group by all",
        "plegs2": f"select *, lag(l) over w as pl, lag(s) over w as ps from plegs window w as (partition by {M} order by date)",
        "ptrn": f"select {M}, date, case when pl is not null then ((1 - len(list_intersect(l, pl)) / greatest(len(l), 1)) + (1 - len(list_intersect(s, ps)) / greatest(len(s), 1))) / 2 end as turned from plegs2",
        "prow": f"select p.*, turned, gap - 0.001::double * coalesce(turned, 0) as net, mktrf, smb, hml, umd from psp p left join ptrn using ({M}, date) left join fac on factor_date = last_day(cast(p.date + interval 1 day as date))",
        "pric0": f"select *, rank() over (partition by {M}, date order by prediction) + (count(*) over (partition by {M}, date, prediction) - 1) / 2 as rx, rank() over (partition by {M}, date order by target) + (count(*) over (partition by {M}, date, target) - 1) / 2 as ry from pred",
        "pric": f"select {M}, date, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) as rank_ic from pric0 group by all having count(*) >= 25 and count(distinct prediction) >= 3 and count(distinct target) >= 3",
        "msum": f"select *, case when rank_ic_months > 0 then 'ok' when variant = 'macro_only' then 'diagnostic_only' else 'needs_review' end as status from (select {M}, a.n as prediction_rows, coalesce(b.n, 0) as rank_ic_months, coalesce(c.n, 0) as quintile_months, mean_rank_ic, t_rank_ic, mean_q5_minus_q1, t_q5_minus_q1 from (select {M}, count(*) as n from pred group by all) a"
        f" left join (select {M}, count(*) as n, avg(rank_ic) as mean_rank_ic, {t('rank_ic', 't_rank_ic')} from pric group by all) b using ({M}) left join (select {M}, count(*) as n, avg(gap) as mean_q5_minus_q1, {t('gap', 't_q5_minus_q1')} from psp group by all) c using ({M}))",
        "rsum": f"select * exclude (n_months, mg, tg, mn, tn, mt), n_months as alpha_months, {_d6('mg', 'mean_gross_q5_minus_q1')}, {_d6('tg', 't_gross_q5_minus_q1')}, {_d6('mn', 'mean_net_q5_minus_q1')}, {_d6('tn', 't_net_q5_minus_q1')}, {_d6('mt', 'mean_turnover')} from (select {M}, count(gap) as months, avg(gap) as mg, {t('gap', 'tg')}, avg(net) as mn, {t('net', 'tn')}, avg(turned) as mt from prow group by all)"
        f" join {alphas('gap', {'alpha': 'gross_alpha', 'alpha_t': 'gross_alpha_t', 'r2': 'factor_r2'} | {f'beta_{c}': f'beta_{c}' for c in FACTORS})} using ({M}) join (select * exclude (n_months) from {alphas('net', {'alpha': 'net_alpha', 'alpha_t': 'net_alpha_t'})}) using ({M})",
    }


def _d6(c: str, name: str | None = None) -> str:
    return f"floor(({c}) * 1e6 + 0.50001) / 1e6 as {name or c}"


def _gates(spark: SparkSession, d: str) -> DataFrame:
    rows, lines = _panel(spark, d), view(spark, d, "lineitem")
    return gates.all_of(
        gates.not_empty(rows, "panel_rows"), gates.unique_keys(rows, "panel_keys", ["permno", "date"]), gates.unique_keys(lines, "line_keys", ["l_orderkey", "l_linenumber"]),
        gates.gate(rows, "filing_match", F.avg((F.col("activation_source") != "srcdate_fallback").cast("double")) >= 0.5, F.count(F.when(F.col("activation_source") != "srcdate_fallback", 1))),
    )


def _claims(spark: SparkSession, d: str) -> DataFrame:
    parts = view(spark, d, "part").select("p_partkey", F.expr("p_name || CASE p_partkey % 3 WHEN 0 THEN ' Proves arbitrage' WHEN 1 THEN ' is measured' ELSE '' END").alias("claim"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'blocked' END").alias("evidence"))
    return gates.claim_status(parts).select("p_partkey", F.array_join("forbidden", ",").alias("forbidden"), "status")


def _best(spark: SparkSession, d: str) -> DataFrame:
    rows = xsec.quintile_returns(_sorted(spark, d), ["date"], "next_month_excess_ret", "foreign_share").select("quintile", "date", F.col("n").alias("score"))
    return gates.best_row(rows, ["quintile"], "score")


#: Columns of the panel that models scale.
SCALED = ("sale", "ceq", "ni", "capx", "xrd", "dltt", "dlc", "prc", "mktcap")


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    rows = _panel(spark, d).select("permno", "date", *SCALED)
    out = models.standardised(rows.where("date < date '1998-01-01'"), rows.where("date >= date '1998-01-01'"), list(SCALED))
    return _q(out, *SCALED)


def _set_encoding(spark: SparkSession, d: str, size: int, longest: int) -> DataFrame:
    sets = features.encoded_sets(_set_tokens(spark, d), features.geo_vocabulary(_set_tokens(spark, d), size), longest)
    return sets.select("gvkey", "segment_srcdate", F.array_join(F.transform("geo_ids", lambda x: x.cast("string")), ",").alias("ids"), q6(F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)).alias("kept_share"))


def vocabulary_sql(size: int) -> str:
    return f"select geo_label, row_number() over (order by sum(revenue_share) desc, geo_label) + 1 as geo_id from tokx group by geo_label qualify geo_id < {size}"


def sets_sql(size: int, longest: int) -> str:
    """Ids and shares of each snapshot's set, without padding."""
    listed = lambda c: f"list({c} order by revenue_share desc, geo_label)[1:{longest}]"
    return f"select gvkey, segment_srcdate, {listed('coalesce(geo_id, 1)')} as ids, {listed('revenue_share')} as shares from tokx left join ({vocabulary_sql(size)}) v using (geo_label) group by gvkey, segment_srcdate"


def sets_text_sql(size: int, longest: int) -> str:
    return f"select gvkey, segment_srcdate, array_to_string(list_resize(ids, {longest}, 0), ',') as ids, {_d6('list_sum(shares)', 'kept_share')} from ({sets_sql(size, longest)})"


LABELS = ("United States", "ASIA", "EUROPE", "AFRICA", "MIDDLE EAST")
SECTOR_SQL = "case " + " ".join(f"when siccd between {a} and {b} then '{k}'" for k, (a, b) in fn.SECTORS.items()) + " else 'Unknown' end"
FORBIDDEN_SQL = "array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in gates.FORBIDDEN) + "], lambda w: contains(lower(claim), w)), ',')"


def _standard_sql(c: str) -> str:
    return _d6(f"(coalesce(r.{c}, {c}_m) - {c}_a) / coalesce(nullif({c}_s, 0), 1)", c)



REGISTERED: dict[str, tuple[Query, str | None]] = {
    "seg_coalesce_sales": (
        lambda s, d: panel.clean_segments(view(s, d, "fx_segments")).groupBy("gvkey", "geo_label").agg(F.count("*").alias("n"), q6(F.sum("sales")).alias("sales")),
        f"select gvkey, geo_label, count(*) as n, {_d6('sum(sales)', 'sales')} from clean group by gvkey, geo_label",
    ),
    "seg_snapshots": (
        lambda s, d: _q(_snaps(s, d), "segment_sales_sum", "foreign_share", "domestic_share", "geo_hhi", "top_geo_share"),
        "select * replace (" + ", ".join(_d6(c) for c in ("segment_sales_sum", "foreign_share", "domestic_share", "geo_hhi", "top_geo_share")) + ") from snap",
    ),
    "domestic_flag": (
        lambda s, d: _labels(s, d).select("gareag", "gareat", fn.is_domestic(F.col("label")).alias("domestic")),
        r"select distinct gareag, gareat, coalesce(regexp_matches(lower(trim(coalesce(nullif(gareag, ''), gareat))), '\bunited states\b|\bu\.s\.?\b|\busa\b|\bus\b'), false) as domestic from fx_segments",
    ),
    "macro_area_map": (lambda s, d: _tokens(s, d).select("geo_label", "macro_area").distinct(), "select distinct geo_label, macro_area from tok"),
    "slug": (
        lambda s, d: view(s, d, "part").select("p_partkey", fn.slug(F.col("p_name")).alias("slug")),
        r"select p_partkey, coalesce(nullif(trim(regexp_replace(lower(trim(p_name)), '[^\p{L}\p{N}]+', '_', 'g'), '_'), ''), 'unknown') as slug from part",
    ),
    "sic_sector": (
        lambda s, d: view(s, d, "fx_returns").select("permno", "siccd").distinct().select("permno", fn.sic_sector(F.col("siccd").cast("string")).alias("sector")),
        "select distinct permno, case " + " ".join(f"when siccd between {a} and {b} then '{k}'" for k, (a, b) in fn.SECTORS.items()) + " else 'Unknown' end as sector from fx_returns",
    ),
    "period_parse": (
        _period,
        "with p as (select o_orderkey, year(o_orderdate) as y, case o_orderkey % 6 when 0 then 'M' || lpad(cast(month(o_orderdate) as string), 2, '0') when 1 then 'Q' || quarter(o_orderdate) when 2 then year(o_orderdate) || 'Q' || quarter(o_orderdate) when 3 then cast(year(o_orderdate) as string) when 4 then cast(cast(o_orderdate as date) as string) else 'x' end as period, cast(o_orderdate as date) as d from orders) "
        "select o_orderkey, period, case o_orderkey % 6 when 0 then last_day(d) when 1 then last_day(make_date(y, quarter(d) * 3, 1)) when 2 then last_day(make_date(y, quarter(d) * 3, 1)) when 3 then make_date(y, 12, 31) when 4 then d end as period_end from p",
    ),
    "geo_tokens": (
        lambda s, d: _q(_tokens(s, d), "revenue_share", "segment_sales").drop("snapshot_sales"),
        f"select gvkey, segment_srcdate, geo_label, macro_area, {_d6('revenue_share')}, {_d6('segment_sales')}, segment_rows from tok",
    ),
    "activation_dates": (lambda s, d: _active(s, d).select("gvkey", "segment_srcdate", "segment_activation_date", "activation_source"), "select gvkey, segment_srcdate, segment_activation_date, activation_source from act"),
    "activation_sources": (lambda s, d: _active(s, d).groupBy("activation_source").agg(F.count("*").alias("n")), "select activation_source, count(*) as n from act group by 1"),
    "filing_dedupe": (lambda s, d: panel.prepared_filings(view(s, d, "fx_filings")), "select gvkey, datadate, filing_date, filing_date_source from fil"),
    "funda_available": (
        lambda s, d: panel.available_fundamentals(view(s, d, "fx_funda")).select("gvkey", "datadate", "funda_avail_date", "funda_avail_source", q6("at").alias("at")),
        f"select gvkey, funda_datadate as datadate, funda_avail_date, funda_avail_source, {_d6('f.at', 'at')} from fund1 f",
    ),
    "returns_dedupe": (lambda s, d: panel.prepared_returns(view(s, d, "fx_returns")).select("permno", "date", q6("ret").alias("ret")), f"select permno, date, {_d6('ret')} from rets"),
    "links_distinct": (
        lambda s, d: panel.prepared_links(view(s, d, "fx_links")),
        "select distinct gvkey, permno, linkdt, coalesce(linkenddt, date '2100-01-01') as linkenddt, linktype, linkprim from fx_links",
    ),
    "link_interval_join": (lambda s, d: panel.linked_returns(view(s, d, "fx_returns"), view(s, d, "fx_links")).select("gvkey", "permno", "date", q6("ret").alias("ret")), f"select gvkey, permno, date, {_d6('ret')} from best"),
    "factor_scale": (lambda s, d: _q(panel.scaled_factors(view(s, d, "fx_factors")), "mktrf", "smb", "hml", "umd", "rf"), "select factor_date, " + ", ".join(_d6(c) for c in ("mktrf", "smb", "hml", "umd", "rf")) + " from fac"),
    "monthly_panel": (
        lambda s, d: _panel(s, d).select("gvkey", "permno", "date", "segment_srcdate", "segment_activation_date", "funda_datadate", "funda_avail_source", *(q6(c).alias(c) for c in ("foreign_share", "geo_hhi", "at", "excess_ret", "next_month_excess_ret"))),
        "select gvkey, permno, date, segment_srcdate, segment_activation_date, funda_datadate, funda_avail_source, " + ", ".join(_d6(c) for c in ("foreign_share", "geo_hhi", '"at"', "excess_ret", "next_month_excess_ret")) + " from pan",
    ),
    "next_month_ret": (lambda s, d: _panel(s, d).select("permno", "date", q6("next_month_ret").alias("next_month_ret")), f"select permno, date, {_d6('next_month_ret')} from pan"),
    "panel_profile": (
        _panel_profile,
        "select metric, floor(value * 1e6 + 0.50001) / 1e6 as value from (select cast(count(*) as double) as rows, cast(count(distinct permno) as double) as permnos, cast(count(distinct date) as double) as months, avg(foreign_share) as mean_foreign_share, cast(count(\"at\") as double) as with_fundamentals, cast(count(next_month_ret) as double) as with_next_return, cast(sum(case when date <= segment_activation_date then 1 else 0 end) as double) as violations from pan) unpivot (value for metric in (rows, permnos, months, mean_foreign_share, with_fundamentals, with_next_return, violations))",
    ),
    "activation_gate": (_activation_gate, "select 'activation_rule' as check, cast(count(*) filter (where date <= segment_activation_date) as bigint) as violations, case when count(*) filter (where date <= segment_activation_date) = 0 then 'ok' else 'needs_review' end as status from pan"),
    "quintile_assign": (lambda s, d: _sorted(s, d).select("permno", "date", "quintile"), "select permno, date, quintile from srt"),
    "quintile_returns": (
        lambda s, d: _q(xsec.quintile_returns(_sorted(s, d), ["date"], "next_month_excess_ret", "foreign_share"), "mean_ret", "mean_score"),
        f"select date, quintile, {_d6('mean_ret')}, n, {_d6('mean_score')} from qr",
    ),
    "spread_cumprod": (
        lambda s, d: _spread(s, d).select("date", q6("q5_minus_q1").alias("q5_minus_q1"), q6(xsec.cumulated(F.col("q5_minus_q1"), Window.orderBy("date"))).alias("cum_q5_minus_q1")),
        f"select date, {_d6('q5_ret - q1_ret', 'q5_minus_q1')}, {_d6('product(1 + q5_ret - q1_ret) over (order by date) - 1', 'cum_q5_minus_q1')} from spr",
    ),
    "rank_ic": (lambda s, d: _q(xsec.rank_ic(_usable(s, d), "foreign_share", "next_month_excess_ret"), "rank_ic"), f"select date, {_d6('rank_ic')}, n from ric"),
    "rolling_ic": (
        lambda s, d: (lambda w, x: x.select("date", F.when(F.count("rank_ic").over(w) >= 3, q6(F.avg("rank_ic").over(w))).alias("rolling")))(Window.orderBy("date").rowsBetween(-11, 0), xsec.rank_ic(_usable(s, d), "foreign_share", "next_month_excess_ret")),
        "select date, case when count(rank_ic) over w >= 3 then floor(avg(rank_ic) over w * 1e6 + 0.50001) / 1e6 end as rolling from ric window w as (order by date rows between 11 preceding and current row)",
    ),
    "fmb_slope": (
        lambda s, d: _q(xsec.slopes(_usable(s, d), "foreign_share", "next_month_excess_ret"), "beta"),
        f"select date, {_d6('regr_slope(next_month_excess_ret, foreign_share)', 'beta')}, count(*) as n from use_ group by date having count(*) >= 25 and count(distinct foreign_share) >= 3",
    ),
    "t_stat_summary": (
        lambda s, d: _spread(s, d).agg(q6(F.avg("q5_minus_q1")).alias("mean"), q6(xsec.t_stat("q5_minus_q1")).alias("t"), F.count("q5_minus_q1").alias("n")),
        "select floor(avg(x) * 1e6 + 0.50001) / 1e6 as mean, floor(avg(x) / (stddev_samp(x) / sqrt(count(x))) * 1e6 + 0.50001) / 1e6 as t, count(x) as n from (select q5_ret - q1_ret as x from spr)",
    ),
    "turnover": (
        lambda s, d: _q(_turnover(s, d), "long_turnover", "short_turnover", "long_short_turnover").drop("variant").withColumns({c: F.col(c).cast("long") for c in ("long_n", "short_n")}),
        f"select date, {_d6('lt', 'long_turnover')}, {_d6('st', 'short_turnover')}, {_d6('(lt + st) / 2', 'long_short_turnover')}, ln as long_n, sn as short_n from trn",
    ),
    "net_spread": (_net, f"select date, {_d6('q5_ret - q1_ret', 'gross')}, {_d6('q5_ret - q1_ret - 0.001::double * coalesce((lt + st) / 2, 0)', 'net')} from spr left join trn using (date)"),
    "factor_alpha_nw": (_alpha, "select * from " + alpha_sql("alph", "variant", "gap", {"alpha": "alpha", "alpha_t": "alpha_t", "r2": "r2"} | {f"beta_{c}": f"beta_{c}" for c in FACTORS})),
    "filing_extract": (
        lambda s, d: tables.extract(s, "filings", *_year(1996), funda=_reports_source(s, d)),
        "select gvkey, datadate, year(datadate) as fyear, month(datadate) as fyr, fdate, pdate from fx_funda_once where datadate between date '1994-01-01' and date '1996-12-31' and cast(gvkey as int) % 9 <> 0",
    ),
    "returns_extract": (
        lambda s, d: tables.extract(s, "returns", *_year(1996), returns=_returns_source(s, d)).select("permno", "permco", "siccd", "yyyymm", "date", q6("ret").alias("ret"), q6("mktcap").alias("mktcap")),
        f"select permno, permno as permco, siccd, strftime(date, '%Y%m') as yyyymm, date, {_d6('ret')}, {_d6('mktcap')} from fx_returns_once where date between date '1996-01-01' and date '1997-03-31'",
    ),
    "standard_macro_frame": (
        _standard,
        f"select case series_id when 'FEDFUNDS' then 'fred' else 'bls' end as source, series_id, lower(series_id) as series_name, 'GLOBAL' as macro_area, date, case series_id when 'FEDFUNDS' then available_date else last_day(date) + 7 end as available_date, {_d6('value')}, available_date as realtime_start, case series_id when 'FEDFUNDS' then 'fred_initial_release' else 'configured_release_lag' end as timing_source, true as lookahead_safe, series_id = 'FEDFUNDS' as revision_safe from fx_macro where series_id in ('FEDFUNDS', 'REV_AMERICA')",
    ),
    "fold_metrics": (
        lambda s, d: _q(robustness.fold_metrics(_predictions(s, d)), "mean_rank_ic"),
        f"select {M}, fold_year, p.n as prediction_rows, train_rows, rank_ic_months, {_d6('ic', 'mean_rank_ic')} from (select {M}, fold_year, count(*) as n, max(train_rows) as train_rows from pred group by all) p left join (select {M}, year(date) as fold_year, count(*) as rank_ic_months, avg(rank_ic) as ic from pric group by all) using ({M}, fold_year)",
    ),
    "model_summary": (
        lambda s, d: _q(_summary(s, d), *SUMMARY),
        f"select {M}, prediction_rows, rank_ic_months, quintile_months, {', '.join(map(_d6, SUMMARY))}, status from msum",
    ),
    "robustness_summary": (
        lambda s, d: _q(_robust(s, d), *ROBUST, *(f"beta_{c}" for c in FACTORS)),
        f"select {M}, months, alpha_months, {', '.join(ROBUST)}, " + ", ".join(f"beta_{c}" for c in FACTORS) + " from rsum",
    ),
    "model_comparison": (
        lambda s, d: _q(reports.model_comparison(_summary(s, d)), *SUMMARY),
        f"select case model_family when 'lgbm' then 'LightGBM' else 'Deep Sets' end as model_family, variant, case model_family when 'lgbm' then 'gradient_boosted_trees' else 'deep_sets' end as architecture, prediction_rows, {', '.join(map(_d6, SUMMARY))}, " + REVIEW.format(a="t_rank_ic", b="t_q5_minus_q1", x="rank and spread", y="rank", z="spread") + " as review_note from msum",
    ),
    "factor_alpha_table": (
        lambda s, d: _q(reports.factor_alpha_table(_robust(s, d)), *ROBUST),
        f"select case model_family when 'lgbm' then 'LightGBM' else 'Deep Sets' end as model_family, variant, months, alpha_months, {', '.join(ROBUST)}, " + REVIEW.format(a="gross_alpha_t", b="t_net_q5_minus_q1", x="alpha and net-spread", y="alpha", z="net-spread") + " as review_note from rsum",
    ),
    "display_models": (
        lambda s, d: reports.displayed(reports.model_comparison(_summary(s, d)).select("model_family", "variant", "prediction_rows"), {"model_family": "Model", "variant": "Variant", "prediction_rows": "Rows"}),
        "select case model_family when 'lgbm' then 'LightGBM' else 'Deep Sets' end as \"Model\", variant as \"Variant\", format('{:,}', prediction_rows) as \"Rows\" from msum",
    ),
    "publication_checks": (
        lambda s, d: reports.publication_checks(reports.model_comparison(_summary(s, d)), reports.factor_alpha_table(_robust(s, d)), gates.claim_status(reports.claim_ledger(_summary(s, d), _robust(s, d)), "allowed_wording", "evidence_strength"), reports.table_notes("fx", 10.0, 6)),
        "select 'model_table_nonempty' as check, 'pass' as status, 'rows=' || count(*) as detail from msum union all select 'factor_table_nonempty', 'pass', 'rows=' || count(*) from rsum union all select 'unique_model_rows', 'pass', 'duplicates=' || (count(*) - count(distinct (model_family, variant))) from msum union all select 'unique_factor_rows', 'pass', 'duplicates=' || (count(*) - count(distinct (model_family, variant))) from rsum union all select 'claim_validation_no_failures', 'pass', 'failures=0' union all select 'notes_include_' || unnest(['diagnostic', '2026', 'macro', 'turnover']), 'pass', unnest(['diagnostic', '2026', 'macro', 'turnover'])",
    ),
    "claim_ledger": (
        lambda s, d: gates.claim_status(reports.claim_ledger(_summary(s, d), _robust(s, d)), "allowed_wording", "evidence_strength").select("claim_id", "module", "subject", "evidence_strength", "status"),
        """select 'best_spread' as claim_id, 'LightGBM ablations' as module, (select variant from msum where model_family = 'lgbm' order by mean_q5_minus_q1 desc nulls last, variant limit 1) as subject, 'passed diagnostic' as evidence_strength, 'pass' as status
union all select 'segment_signal', 'LightGBM ablations', 'segment_only', (select case when t_rank_ic > 2 then 'passed' else 'weak' end from msum where variant = 'segment_only') || ' diagnostic', 'pass'
union all select 'set_encoder', 'Segment-set models', 'set_only', (select case when t_rank_ic > 2 then 'passed' else 'weak' end from msum where variant = 'set_only') || ' diagnostic', 'pass'
union all select 'best_alpha', 'Factor robustness', model_family || ':' || variant, case when gross_alpha_t > 2 then 'passed' else 'weak' end || ' diagnostic', 'pass' from (select * from rsum order by gross_alpha_t desc nulls last, model_family, variant limit 1)
union all select 'best_net', 'Turnover robustness', model_family || ':' || variant, case when t_net_q5_minus_q1 > 2 then 'passed' else 'weak' end || ' diagnostic', 'pass' from (select * from rsum order by mean_net_q5_minus_q1 desc nulls last, model_family, variant limit 1)
union all select 'macro_execution', 'Macro execution', 'run_a', 'blocked by missing private secrets', 'blocked'""",
    ),
    "waterfall": (
        lambda s, d: reports.waterfall({"segment_snapshots": _active(s, d), "filing_date_matched": _active(s, d).where("activation_source <> 'srcdate_fallback'"), "panel_rows": _panel(s, d), "predictions": _predictions(s, d)}),
        "select 1 as step, 'segment_snapshots' as label, count(*) as n from act union all select 2, 'filing_date_matched', count(*) from act where activation_source <> 'srcdate_fallback' union all select 3, 'panel_rows', count(*) from pan union all select 4, 'predictions', count(*) from pred",
    ),
    "exposure_trend": (
        lambda s, d: _q(reports.trend(_panel(s, d), ["foreign_share", "geo_hhi"]), "foreign_share", "geo_hhi"),
        f"select date, {_d6('avg(foreign_share)', 'foreign_share')}, {_d6('avg(geo_hhi)', 'geo_hhi')}, count(*) as n from pan group by date",
    ),
    "firm_explorer": (
        lambda s, d: _q(reports.firm_explorer(_panel(s, d), 30).select("permno", "date", "sector", "foreign_share"), "foreign_share"),
        f"select permno, date, {SECTOR_SQL} as sector, {_d6('foreign_share')} from (select * from pan where year(date) = (select max(year(date)) from pan) qualify row_number() over (partition by permno order by foreign_share desc, date desc) = 1) order by foreign_share desc, date desc, permno limit 30",
    ),
    "macro_states_delta": (lambda s, d: _q(_states(s, d), "value", "value_delta_1m", "value_delta_12m").select("macro_area", "series_name", "observation_date", "available_date", "value", "value_delta_1m", "value_delta_12m"), "select * replace (" + ", ".join(_d6(c) for c in ("value", "value_delta_1m", "value_delta_12m")) + ") from st"),
    "macro_fallback": (
        lambda s, d: _q(_on_tokens(s, d).groupBy("series_name", "macro_area").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.max("available_date").alias("last")), ),
        "select m.series_name, m.macro_area, count(*) as n, count(m.value) as known, max(s.available_date) as last from mt1 x join mt2 m on x.gvkey = m.gvkey and x.permno = m.permno and x.date = m.date and x.geo_label = m.geo_label and x.series_name = m.series_name asof left join st s on x.series_name = s.series_name and x.area = s.macro_area and x.date >= s.available_date group by 1, 2",
    ),
    "macro_tensor_agg": (
        lambda s, d: _q(macro.macro_interactions(_on_tokens(s, d), ["gvkey", "permno", "date"]), "segment_macro_value", "segment_macro_value_delta_1m", "segment_macro_value_delta_12m", "revenue_share_covered"),
        "select gvkey, permno, date, series_name, " + ", ".join(_d6(f"coalesce(sum(revenue_share * {c}), 0)", f"segment_macro_{c}") for c in ("value", "value_delta_1m", "value_delta_12m")) + f", count(*) as macro_token_rows, {_d6('coalesce(sum(revenue_share) filter (where value is not null), 0)', 'revenue_share_covered')} from mt2 group by 1, 2, 3, 4",
    ),
    "macro_tensor_panel": (
        lambda s, d: (lambda t: t.drop("segment_srcdate", "foreign_share").withColumns({c: q6(c) for c in t.columns if c.startswith("segment_macro_")} | {"macro_revenue_share_covered": q6("macro_revenue_share_covered")}))(_tensor(s, d)),
        "select p.gvkey, p.permno, p.date, token_rows as macro_token_rows, geos as macro_geo_count, areas as macro_area_count, "
        + ", ".join(_d6(f"case when token_rows is not null then coalesce({n}_{c}, 0) end", f"segment_macro_{n}{c[5:]}") for n in ("rev_america", "fedfunds") for c in ("value", "value_delta_1m", "value_delta_12m"))
        + f", {_d6('covered', 'macro_revenue_share_covered')} from pan p left join mwide0 w on p.gvkey = w.gvkey and p.permno = w.permno and p.date = w.date left join mcov v on p.gvkey = v.gvkey and p.permno = v.permno and p.date = v.date",
    ),
    "macro_coverage": (
        lambda s, d: _q(macro.coverage(_tensor(s, d)), "macro_coverage_rate", "mean_macro_revenue_share_covered", "joined_token_match_rate"),
        f"select count(*) as panel_rows, count(token_rows) as firm_month_rows, cast(sum(token_rows) as bigint) as token_rows, {_d6('avg(case when token_rows is not null then case when covered > 0 then 1.0 else 0.0 end end)', 'macro_coverage_rate')}, {_d6('avg(covered)', 'mean_macro_revenue_share_covered')}, {_d6('count(token_rows) / count(*)', 'joined_token_match_rate')} from pan p left join mwide0 w on p.gvkey = w.gvkey and p.permno = w.permno and p.date = w.date left join mcov v on p.gvkey = v.gvkey and p.permno = v.permno and p.date = v.date",
    ),
    "macro_availability": (
        lambda s, d: macro.macro_states(view(s, d, "fx_macro").withColumn("realtime_start", F.col("available_date")).withColumn("available_date", F.lit(None).cast("date")), release_lag_days=5).groupBy("availability_source", "vintage_safe").agg(F.count("*").alias("n"), F.min("available_date").alias("first")),
        "select 'realtime_start' as availability_source, true as vintage_safe, count(*) as n, min(available_date) as first from st",
    ),
    "feature_frame": (
        lambda s, d: _q(features.feature_frame(_panel(s, d), holdout="2001-01-01"), *features.DERIVED),
        "select gvkey, permno, date, " + ", ".join(_d6(e, n) for n, e in features.DERIVED_SQL.items()) + " from pan where date < date '2001-01-01'",
    ),
    "yearly_folds": (
        lambda s, d: xsec.yearly_folds(_panel(s, d), holdout="2001-01-01"),
        "select * from (select fold_year, validation_start, validation_end, validation_months, min(validation_start) over w as train_start, max(validation_end) over w as train_end, cast(sum(validation_months) over w as bigint) as train_months from (select year(date) as fold_year, min(date) as validation_start, max(date) as validation_end, count(*) as validation_months from (select distinct date from pan where date < date '2001-01-01') group by 1) window w as (order by fold_year rows between unbounded preceding and 1 preceding)) where train_months >= 36",
    ),
    "geo_vocab": (
        lambda s, d: features.geo_vocabulary(_set_tokens(s, d), 8).select("geo_label", "geo_id"),
        f"select geo_label, geo_id from ({vocabulary_sql(8)})",
    ),
    "set_encoding": (
        lambda s, d: _set_encoding(s, d, 8, 3),
        sets_text_sql(8, 3),
    ),
    "histogram": (
        lambda s, d: features.histogram(_panel(s, d), "foreign_share", 0.0, 1.0, 40),
        "select least(cast(floor(foreign_share * 40) as bigint) + 1, 40) as bin, count(*) as n from pan where foreign_share is not null group by 1",
    ),
    "exposure_months": (
        lambda s, d: _q(exposure_panel.exposure_months(_snaps(s, d).select("gvkey", "segment_srcdate", "foreign_share"), panel.prepared_links(view(s, d, "fx_links")), panel.prepared_returns(view(s, d, "fx_returns")).select("permno", "date", "ret")), "foreign_share", "ret"),
        f"select s.gvkey, l.permno, s.segment_srcdate, r.date, {_d6('foreign_share')}, {_d6('ret')} from snap s join lks l on s.gvkey = l.gvkey and s.segment_srcdate >= linkdt and (linkenddt is null or s.segment_srcdate <= linkenddt) join rets r on r.permno = l.permno and r.date > s.segment_srcdate and r.date <= cast(s.segment_srcdate + interval 12 month as date)",
    ),
    "latest_report": (
        lambda s, d: _q(exposure_panel.with_latest_report(panel.prepared_links(view(s, d, "fx_links")).select("gvkey", "permno"), view(s, d, "fx_funda").select("gvkey", "datadate", "ni", "year")), "ni_funda"),
        f"select l.gvkey, l.permno, f.datadate as datadate_funda, {_d6('f.ni', 'ni_funda')} from lks l left join (select * from fx_funda qualify row_number() over (partition by gvkey order by datadate desc, year desc) = 1) f on f.gvkey = l.gvkey",
    ),
    "largest_firms": (lambda s, d: _q(exposure_panel.largest(_snaps(s, d), "gvkey", "segment_sales_sum", 25), "total"), f"select gvkey, {_d6('sum(segment_sales_sum)', 'total')} from snap group by gvkey order by sum(segment_sales_sum) desc, gvkey limit 25"),
    "sector_matrix": (
        lambda s, d: _q(exposure_panel.sector_matrix(_panel(s, d), _tokens(s, d), list(LABELS)), *LABELS),
        "select sector, " + ", ".join(_d6(f"coalesce(avg(revenue_share) filter (where geo_label = '{x}'), 0)", f'"{x}"') for x in LABELS) + f" from (select gvkey, segment_srcdate, {SECTOR_SQL} as sector from pan where year(date) = (select max(year(date)) from pan)) p join tok t using (gvkey, segment_srcdate) group by sector",
    ),
    "quality_gates": (
        _gates,
        "select 'panel_rows' as check, case when count(*) > 0 then 'ok' else 'fail' end as status, cast(count(*) as varchar) as detail from pan"
        " union all select 'panel_keys', case when count(*) = count(distinct (permno, date)) then 'ok' else 'fail' end, cast(count(*) - count(distinct (permno, date)) as varchar) from pan"
        " union all select 'line_keys', case when count(*) = count(distinct (l_orderkey, l_linenumber)) then 'ok' else 'fail' end, cast(count(*) - count(distinct (l_orderkey, l_linenumber)) as varchar) from lineitem"
        " union all select 'filing_match', case when avg(case when activation_source <> 'srcdate_fallback' then 1.0 else 0.0 end) >= 0.5 then 'ok' else 'needs_review' end, cast(count(*) filter (where activation_source <> 'srcdate_fallback') as varchar) from pan",
    ),
    "claim_gate": (
        _claims,
        f"select p_partkey, {FORBIDDEN_SQL} as forbidden, case when {FORBIDDEN_SQL} <> '' then 'fail' when contains(evidence, 'blocked') then 'blocked' else 'pass' end as status from (select p_partkey, p_name || case p_partkey % 3 when 0 then ' Proves arbitrage' when 1 then ' is measured' else '' end as claim, case when p_partkey % 2 = 0 then p_brand else 'blocked' end as evidence from part)",
    ),
    "unsafe_texts": (
        lambda s, d: gates.unsafe_texts(view(s, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join("unsafe", ",").alias("unsafe")),
        "select * from (select doc_id, concat_ws(',', " + ", ".join(f"case when regexp_matches(text, '{p}') then '{k}' end" for k, p in gates.UNSAFE.items()) + ") as unsafe from documents) where unsafe <> ''",
    ),
    "best_row": (_best, "select quintile, date, n as score from qr qualify row_number() over (partition by quintile order by n desc, date) = 1"),
    "standardised": (
        _scaled,
        f"select r.permno, r.date, {', '.join(map(_standard_sql, SCALED))} from pan r, (select {', '.join(f'{c}_m' for c in SCALED)}, " + ", ".join(f"avg(coalesce({c}, {c}_m)) as {c}_a, stddev_pop(coalesce({c}, {c}_m)) as {c}_s" for c in SCALED) + f" from (select *, {', '.join(f'median({c}) over () as {c}_m' for c in SCALED)} from pan where date < date '1998-01-01') group by {', '.join(f'{c}_m' for c in SCALED)}) where r.date >= date '1998-01-01'",
    ),
    "train_sample": (lambda s, d: models.train_sample(_panel(s, d).select("permno", "date"), ["permno", "date"], 500), None),
    "set_encoding_full": (lambda s, d: _set_encoding(s, d, 512, 12), sets_text_sql(512, 12)),  # the reference's vocabulary and labels a set
}
def registered() -> dict[str, tuple[Query, str | None]]:
    from . import connectors, studies  # they build on this module

    return REGISTERED | studies.REGISTERED | connectors.REGISTERED


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in registered().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql if k in PLAIN else _sql(sql) for k, (_, sql) in registered().items() if sql}
