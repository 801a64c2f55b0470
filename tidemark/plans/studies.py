"""Queries over models, sets, sources, audits and extracts, with the same rows in DuckDB's SQL where it can express them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import audits, boosting, exposure_panel, features, gates, macro, models, panel, reports, robustness, set_models, xsec
from ..sources import catalog, tables
from ..sources.footers import table_estimates
from ..sources.macro_service import read_series
from ..sources.stored import kept, shared_dir
from . import registry as base
from .fixtures import TABLES, view

#: The development window of the given tables ends here, as their dates do in 1998.
HOLDOUT = "2001-01-01"
LABELS, LONGEST = 512, 12


def _frame(s: SparkSession, d: str) -> DataFrame:
    """The panel's rows with a target, and the features of all variants."""
    rows = features.model_frame(base._panel(s, d), base._tensor(s, d), holdout=HOLDOUT)
    return rows.withColumn("target", F.col("next_month_excess_ret"))


def _set_panel(s: SparkSession, d: str) -> DataFrame:
    tokens = base._set_tokens(s, d)
    rows = features.model_frame(base._panel(s, d), holdout=HOLDOUT).where("next_month_excess_ret IS NOT NULL")
    return features.panel_sets(rows, features.encoded_sets(tokens, features.geo_vocabulary(tokens, LABELS), LONGEST), LONGEST)


def _set_predictions(s: SparkSession, d: str) -> DataFrame:
    """Predictions of the three set variants in all yearly folds; the losses are kept beside them."""

    def build() -> DataFrame:
        controls = features.variant_features(base._panel(s, d).columns + list(features.DERIVED), "set_plus_controls")
        rows = _set_panel(s, d).where("matched").select("gvkey", "permno", "date", F.col("next_month_excess_ret").alias("target"), F.col("geo_ids").cast("array<int>").alias("geo_ids"), "shares", F.array(*(F.col(c).cast("double") for c in controls)).alias("controls"))
        rows = kept(s, d, "set_rows", lambda: rows)
        folds = [set_models.Fold(f["fold_year"], f["train_end"], f["validation_start"], f["validation_end"]) for f in xsec.yearly_folds(rows, holdout=HOLDOUT).orderBy("fold_year").collect()]  # one row a year
        out, losses = set_models.set_predictions(rows, folds, labels=LABELS, controls=len(controls), folder=f"{shared_dir(s)}/tidemark_states_{uuid.uuid4().hex}")
        kept(s, d, "set_losses", lambda: losses)
        return out

    return kept(s, d, "set_predictions", build)


def _set_losses(s: SparkSession, d: str) -> DataFrame:
    _set_predictions(s, d)
    return kept(s, d, "set_losses", lambda: s.createDataFrame([], "variant string, fold_year int, step int, loss double"))


def _set_summary(s: SparkSession, d: str) -> DataFrame:
    rows = _set_predictions(s, d).withColumns({"model_family": F.lit("deepsets"), "model_run_id": F.lit("sets")})
    architecture = F.when(F.col("variant") == "set_transformer", "set_transformer").otherwise("deep_sets")
    return robustness.model_summary(rows).withColumn("architecture", architecture)


def _boosted(s: SparkSession, d: str) -> DataFrame:
    """Predictions of the variant with all features but macro ones in all yearly folds; the split counts are kept beside them."""

    def build() -> DataFrame:
        rows = features.model_frame(base._panel(s, d), holdout=HOLDOUT).withColumn("target", F.col("next_month_excess_ret"))
        names = features.variant_features(rows.columns, "all")
        rows = rows.select("gvkey", "permno", "date", "target", *names)
        rows = kept(s, d, "boosted_rows", lambda: rows)
        folds = [(f["fold_year"], f["train_end"], f["validation_start"], f["validation_end"]) for f in xsec.yearly_folds(rows, holdout=HOLDOUT).orderBy("fold_year").collect()]  # one row a year
        out, used = boosting.boosted_folds(rows, folds, names, "target")
        kept(s, d, "boosted_importances", lambda: used)
        return out

    return kept(s, d, "boosted_folds", build)


def _importances(s: SparkSession, d: str) -> DataFrame:
    _boosted(s, d)
    return kept(s, d, "boosted_importances", lambda: s.createDataFrame([], "fold_year int, feature string, importance double"))


def _known(s: SparkSession, d: str) -> DataFrame:
    """Features of each variant that the panel has, in the models' order, and how many firm-months have a value."""
    frame = _frame(s, d)
    rows = [(v, i, f) for v in features.VARIANTS for i, f in enumerate(features.variant_features(frame.columns, v))]
    names = sorted({f for _, _, f in rows})
    known = frame.agg(*(F.count(f).alias(f) for f in names)).unpivot([], names, "feature", "known")
    return s.createDataFrame(rows, "variant string, place int, feature string").join(F.broadcast(known), "feature").select("variant", "place", "feature", "known")


def _known_sql() -> str:
    macro_columns = [f"segment_macro_{n}{c[5:]}" for n in ("rev_america", "fedfunds") for c in ("value", "value_delta_1m", "value_delta_12m")]
    derived = ", ".join(f"count({e}) as {n}" for n, e in features.DERIVED_SQL.items())
    plain = [f for f in dict.fromkeys(x for own, _ in features.VARIANTS.values() for x in own) if f not in features.DERIVED_SQL]
    listed = [(v, i, f) for v, (own, more) in features.VARIANTS.items() for i, f in enumerate([*own, *(macro_columns if more else [])])]
    values = ", ".join(f"('{v}', {i}, '{f}')" for v, i, f in listed)
    return (
        f"select t.variant, t.place, t.feature, known from (values {values}) t(variant, place, feature) join (unpivot (select {', '.join(f'count({c}) as {c}' for c in plain)}, {derived}, {', '.join(f'count(token_rows) as {c}' for c in macro_columns)} "
        f"from pan left join (select gvkey as g, permno as p, date as d, token_rows from mwide0) on g = gvkey and p = permno and d = date where date < date '{HOLDOUT}') on columns(*) into name feature value known) k on k.feature = t.feature"
    )


ROLES = [
    catalog.Role("sales", (), ("line", "item"), ("sales_lines", "lineitem"), (("l_partkey", "partkey"), ("l_shipdate",)), ("l_shipdate",)),
    catalog.Role("orders", (), ("order",), ("orders",), (("o_orderkey",), ("o_orderdate",), ("o_clerk_name",)), ("o_orderdate",)),
    catalog.Role("partners", (), ("custom", "suppl"), ("partner",), (("s_suppkey", "c_custkey"), ("s_name",)), ()),
]


def _roles(s: SparkSession, d: str) -> DataFrame:
    """The given tables that play each role, by their own names and columns."""
    rows = [("given", t, c) for t in TABLES for c in view(s, d, t).columns]  # a row a column of the catalog
    return catalog.resolve_roles(s.createDataFrame(rows, "library string, table string, column string"), ROLES)


def _roles_sql() -> str:
    parts = []
    for r in ROLES:
        liked = [f"case when t = '{p}' then {catalog.EQUAL - i} when contains(t, '{p}') then {catalog.CONTAINED - i} else 0 end" for i, p in enumerate(r.preferred)]
        terms = [f"case when contains(t, '{x}') then {catalog.TABLE_TERM} else 0 end" for x in r.table_terms]
        has = [f"case when list_has_any(names, {list(g)!r}) then {catalog.GROUP} else 0 end" for g in r.needs]
        day = "coalesce(" + ", ".join([*(f"case when list_contains(names, '{c}') then '{c}' end" for c in (*r.dates, *catalog.DATES)), "null"]) + ")"
        parts.append(f"select '{r.name}' as role, t, {' + '.join(liked + terms)} as by_name, {' + '.join(has)} as by_columns, {day} as date_column from c")
    given = ", ".join(f"'{t}'" for t in TABLES)
    return f"with c as (select table_name as t, list(distinct lower(column_name)) as names from duckdb_columns() where table_name in ({given}) group by 1), r as ({' union all '.join(parts)}) select role, 'given' as library, t as \"table\", cast(by_name + by_columns as int) as score, date_column from r where by_name > 0 qualify row_number() over (partition by role order by by_name + by_columns desc, t) = 1"


ESTIMATED = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey", "documents": "doc_id"}

SERVED = {"REV_ASIA": "bls", "REV_EUROPE": "bea", "FEDFUNDS": "fred", "REV_AMERICA": "eia"}


def _served(s: SparkSession, d: str) -> DataFrame:
    """Answers of the services, made from the orders, read through the data source for a window of dates."""
    value = F.format_string("%.6f", F.col("value"))
    year = F.year("date").cast("string")
    fields = {
        "bls": {"year": year, "period": F.date_format("date", "'M'MM"), "value": value}, "bea": {"TimePeriod": F.date_format("date", "yyyy'M'MM"), "DataValue": value},
        "fred": {"date": F.date_format("date", "yyyy-MM-dd"), "value": value, "realtime_start": F.date_format("available_date", "yyyy-MM-dd")}, "eia": {"period": F.date_format("date", "yyyy-MM"), "value": value},
    }
    wrapped = {"bls": lambda x: {"Results": {"series": [{"data": x}]}}, "bea": lambda x: {"BEAAPI": {"Results": {"Data": x}}}, "fred": lambda x: {"observations": x}, "eia": lambda x: {"response": {"data": x}}}
    entries = []
    for code, source in SERVED.items():
        rows = view(s, d, "fx_macro").where(F.col("series_id") == code).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*(c.alias(k) for k, c in fields[source].items()))))).alias("x"))  # months of one series
        entries.append({"source": source, "series_id": code, "timing": "fred_initial_release", "body": json.dumps(wrapped[source](json.loads(rows.first()["x"])))})
    return read_series(s, entries).where("date >= date '1994-01-01' AND date <= date '1996-12-31' AND error IS NULL")


def _manifests(s: SparkSession, d: str) -> list[DataFrame]:
    """Manifests of the registered results."""
    rows, summary, robust = base._panel(s, d), base._summary(s, d), base._robust(s, d)
    violations = F.coalesce(F.count_if(F.col("date") <= F.col("segment_activation_date")), F.lit(0))
    lgbm = summary.where("model_family = 'lgbm'")
    claims = gates.claim_status(reports.claim_ledger(summary, robust), "allowed_wording", "evidence_strength")
    state = lambda good: F.when(good, "ok").otherwise("needs_review")
    variants = [F.max(F.when(F.col("variant") == v, F.col("status"))).alias(f"outputs.variants.{v}.status") for v in sorted({v for f, _, v, _ in base.MODELS if f == "lgbm"})]
    return [
        audits.manifest(rows.agg(state(F.count("*") > 0).alias("status"), F.count("*").alias("checks.panel_rows"), violations.alias("checks.activation_rule_violations"), F.max("date").alias("checks.max_date")), "panel"),
        audits.manifest(lgbm.agg(state(F.every(F.col("status").isin("ok", "diagnostic_only"))).alias("status"), F.count_if(F.col("status") == "ok").alias("checks.variants_ok"), F.count_if(F.col("status") == "diagnostic_only").alias("checks.variants_diagnostic_only"), F.max_by("variant", F.struct(F.coalesce("mean_q5_minus_q1", F.lit(-1e9)), "variant")).alias("checks.best_spread_variant"), *variants), "models"),
        audits.manifest(robust.agg(state(F.count("*") > 0).alias("status"), F.count("*").alias("checks.variants"), F.max("alpha_months").alias("checks.factor_months")), "factor"),
        audits.manifest(claims.agg(state(F.count_if(F.col("status") == "fail") == 0).alias("status"), F.count_if(F.col("status") == "fail").alias("checks.validation_failures"), F.count_if(F.col("status") == "blocked").alias("checks.blocked_claims")), "claims"),
        audits.manifest(reports.publication_checks(reports.model_comparison(summary), reports.factor_alpha_table(robust), claims, reports.table_notes("fx", 10.0, 6)).agg(state(F.count_if(F.col("status") == "fail") == 0).alias("status"), F.count_if(F.col("status") == "fail").alias("checks.review_failures")), "tables"),
    ]


def _bodies(s: SparkSession, d: str) -> DataFrame:
    return kept(s, d, "manifests", lambda: gates.all_of(*_manifests(s, d)))


def _own_rules() -> list[audits.Rule]:
    rule, text = audits._rule, lambda v: f'"{v}"'
    return [
        *(audits.Rule(run, "manifest_exists", (audits.Condition(run, "$", "exists"),)) for run in ("panel", "models", "factor", "claims", "tables", "baseline")),
        rule("panel", "status_ok", "status", "equals", text("ok")), rule("panel", "activation_no_violations", "checks.activation_rule_violations", "equals", "0"), rule("panel", "row_count", "checks.panel_rows", "at_least", str(audits.PANEL_ROWS)),
        rule("models", "variants", "checks.variants_ok", "at_least", "2"), rule("factor", "variants", "checks.variants", "at_least", "3"), rule("models", "lists_variants", "outputs.variants", "entries", "3"),
        rule("claims", "no_validation_failures", "checks.validation_failures", "equals", "0"), audits.Rule("claims", "blocked_claims", (audits.Condition("claims", "$.checks.blocked_claims", "equals", "0"),), bad=audits.BLOCKED),
        audits.Rule("claims", "reviewed_or_clean", (audits.Condition("tables", "$.checks.review_failures", "equals", "0"), audits.Condition("claims", "$.checks.blocked_claims", "equals", "0")), any_of=True),
    ]


def _freeze(s: SparkSession, d: str) -> DataFrame:
    """The checks before `segment_only` is frozen, with the hash of its figures. There is no figure pack here, so its check
    fails, and the protocol needs review."""
    summary, robust = base._summary(s, d), base._robust(s, d)
    own = lambda df, run: audits.manifest(df.agg(F.count_if((F.col("model_family") == "lgbm") & (F.col("variant") == "segment_only")).alias("rows")), run)
    bodies = gates.all_of(_bodies(s, d), own(summary, "models_summary"), own(robust, "factor_summary"))
    checks = audits.audit(bodies, audits.freeze_rules("segment_only", "1998-12-31"))
    return audits.frozen(checks, audits.selection_hash(summary, robust, "lgbm", "segment_only")).select("check", "status", F.when(F.col("check") == "selection_unchanged", F.col("detail")).alias("content"))


def _freeze_sql() -> str:
    step = lambda c: f"coalesce(cast(cast(floor(({c})::double * 1e6 + 0.50001) as bigint) as varchar), 'none')"
    figures = lambda cs: " || '|' || ".join(map(step, cs))
    own = "model_family = 'lgbm' and variant = 'segment_only'"
    best = "(select variant from msum where model_family = 'lgbm' order by coalesce(mean_q5_minus_q1, -1e9) desc, variant desc limit 1)"
    when = lambda name, good: f"select '{name}' as check, case when {good} then 'pass' else 'fail' end as status, null::varchar as content"
    status = f"(select max(status) from msum where {own})"
    rows = [
        when("panel_status_ok", "(select count(*) from pan) > 0"), when("holdout_unopened_by_panel_max_date", "(select max(date) from pan) = date '1998-12-31'"), when("activation_no_violations", "(select count(*) from pan where date <= segment_activation_date) = 0"),
        when("models_status_ok", "(select bool_and(status in ('ok', 'diagnostic_only')) from msum where model_family = 'lgbm')"), when("selected_variant_exists", f"{status} is not null"), when("selected_variant_ok", f"{status} = 'ok'"),
        when("selected_by_development_spread", f"{best} = 'segment_only'"), when("factor_status_ok", "(select count(*) from rsum) > 0"), when("claim_validation_clean", "true"), when("publication_review_clean", "true"), when("visual_pack_ok", "false"),
        when("selected_variant_in_models_summary", f"(select count(*) from msum where {own}) = 1"), when("selected_variant_in_factor_summary", f"(select count(*) from rsum where {own}) = 1"),
        f"select 'selection_unchanged', 'pass', sha256('lgbm|segment_only|' || (select {figures(audits.MODEL_FIGURES)} from msum where {own}) || '|' || (select {figures(audits.FACTOR_FIGURES)} from rsum where {own}))",
    ]
    return " union all ".join(rows)


def _source(s: SparkSession, d: str, name: str) -> DataFrame:
    """Tables under the sources' own names and columns."""
    if name in ("geo", "amounts"):
        keys, rest = ("gvkey", "stype", "sid", "srcdate"), {"geo": ("gareag", "gareat"), "amounts": ("datadate", "sales", "revts", "ias")}
        return view(s, d, "fx_segments").select(*keys, *rest[name])
    if name == "daily":
        c = {"permno": "l_partkey", "dlycaldt": "cast(l_shipdate as date)", "dlyret": "l_discount - 0.05", "dlyretx": "l_discount - 0.05", "dlyprc": "l_extendedprice / l_quantity", "dlycap": "l_extendedprice", "dlyvol": "l_quantity"}
        return view(s, d, "lineitem").select(*(F.expr(e).alias(k) for k, e in c.items()))
    if name == "funda":
        none = {c: F.lit(None).cast("string") for c in ("tic", "conm")}
        # in one select, as firms of one gvkey may report on one date
        return base._reports_source(s, d, "at", "sale", F.col("sale").alias("revt"), "ceq", "ni", "capx", "xrd", "dltt", "dlc", F.lit(1.5).alias("prcc_f"), F.lit(2.0).alias("csho")).withColumns(none)
    if name == "links":
        return view(s, d, "fx_links").select("gvkey", F.col("permno").alias("lpermno"), F.col("permno").alias("lpermco"), "linkdt", "linkenddt", F.expr("case when permno % 6 = 0 then 'LX' else linktype end").alias("linktype"), "linkprim", F.lit(1).alias("usedflag"))
    if name == "factors":
        return view(s, d, "fx_factors_once").withColumnRenamed("dateff", "date")
    return base._returns_source(s, d)


def _extract(name: str, *sources: str):  # noqa: ANN202
    return lambda s, d: tables.extract(s, name, *base._year(1996), **{x: _source(s, d, x) for x in sources})


def _smoke(s: SparkSession, d: str) -> DataFrame:
    """Rows of the three tables of a trial extract of 1996 that takes every segment row."""
    parts = tables.smoke_extract(s, *base._year(1996), 1_000_000_000, geo=_source(s, d, "geo"), amounts=_source(s, d, "amounts"), links=_source(s, d, "links"), returns=_source(s, d, "returns"))
    kinds = zip(("segments", "links", "returns"), parts, ("gvkey", "gvkey", "permno"), strict=True)
    return gates.all_of(*(df.agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.count_distinct(k).alias("firms")) for n, df, k in kinds))


d6, q6 = base._d6, base.q6
LINKS_1996 = "from fx_links where linkdt <= date '1997-03-31' and (linkenddt is null or linkenddt >= date '1996-01-01') and permno % 6 <> 0"
SEGMENTS_1996 = "from fx_segments g join fx_segments v using (gvkey, stype, sid, srcdate) where srcdate between date '1996-01-01' and date '1996-12-31' and coalesce(v.sales, v.revts, v.ias) is not null"
AREA_SQL = "case " + " ".join("when " + " or ".join(f"contains(upper(trim({{x}})), '{t}')" for t in terms) + f" then '{a}'" for a, terms in fn.AREA_TERMS.items()) + " else 'OTHER_FOREIGN' end"
SERIES_NAME = "regexp_replace(lower(series_id), '[^a-z0-9]+', '_', 'g')"
OWN_AREA = "case upper(series_id) " + " ".join(f"when '{k}' then '{v}'" for k, v in macro.SERIES_AREA.items()) + " end"
SET_PANEL = f"(select p.*, ids, shares from pan p left join ({base.sets_sql(LABELS, LONGEST)}) s on s.gvkey = p.gvkey and s.segment_srcdate = p.segment_srcdate where p.date < date '{HOLDOUT}' and next_month_excess_ret is not null)"
FUNDA_CASTS = ("at", "sale", "revt", "ceq", "ni", "capx", "xrd", "dltt", "dlc")


REGISTERED: dict[str, tuple[base.Query, str | None]] = {
    "variant_features": (_known, _known_sql()),
    "importance_summary": (
        lambda s, d: base._q(robustness.importance_summary(models.marginal_importances(_frame(s, d).where("target IS NOT NULL"), list(features.DERIVED), "target")), "mean_importance"),
        "select feature, " + d6("avg(importance)", "mean_importance") + ", count(distinct fold_year) as folds from (unpivot (select year(date) as fold_year, " + ", ".join(f"coalesce(abs(corr({e}, next_month_excess_ret)), 0) as {n}" for n, e in features.DERIVED_SQL.items()) + f" from pan where date < date '{HOLDOUT}' and next_month_excess_ret is not null group by 1) on {', '.join(features.DERIVED)} into name feature value importance) group by feature",
    ),
    "role_resolution": (_roles, _roles_sql()),
    "table_estimates": (
        lambda s, d: table_estimates(s, {t: (f"{d}/{t}.parquet", c) for t, c in ESTIMATED.items()}),
        " union all ".join(f"select '{t}' as \"table\", '{c}' as \"column\", count(*) as rows, cast(min({c}) as varchar) as low, cast(max({c}) as varchar) as high from {t}" for t, c in ESTIMATED.items()),
    ),
    "macro_service": (
        lambda s, d: _served(s, d).select("source", "series_id", "date", q6("value").alias("value"), F.col("realtime_start")),
        "select source, series_id, case source when 'fred' then date else last_day(date) end as date, " + d6("value") + ", case source when 'fred' then strftime(available_date, '%Y-%m-%d') end as realtime_start from (select *, case series_id " + " ".join(f"when '{k}' then '{v}'" for k, v in SERVED.items()) + " end as source from fx_macro) where source is not null and date between date '1994-01-01' and date '1996-12-31'",
    ),
    "macro_default_areas": (
        lambda s, d: gates.all_of(*(macro.macro_states(view(s, d, v)).groupBy("series_name", "macro_area").agg(F.lit(v).alias("kind"), F.count("*").alias("n"), q6(F.sum("value_delta_1m")).alias("moved")) for v in ("fx_macro_bare", "fx_macro_partly"))),
        " union all ".join(f"select {SERIES_NAME} as series_name, area as macro_area, '{v}' as kind, count(*) as n, {d6('sum(delta)', 'moved')} from (select *, value - lag(value) over (partition by area, series_id order by available_date) as delta from (select *, {x} as area from {v})) group by 1, 2" for v, x in (("fx_macro_bare", f"coalesce({OWN_AREA}, 'GLOBAL')"), ("fx_macro_partly", f"coalesce(case when coalesce(macro_area, {OWN_AREA}) is not null then {AREA_SQL.format(x=f'coalesce(macro_area, {OWN_AREA})')} end, 'UNKNOWN')"))),
    ),
    "macro_profile": (
        lambda s, d: macro.profile(macro.macro_states(view(s, d, "fx_macro_partly"))).select("rows", *(F.array_join(c, ",").alias(c) for c in ("series", "macro_areas", "timing_sources")), "availability_source", "vintage_safe", "lookahead_safe", "revision_safe"),
        f"select count(*) as rows, string_agg(distinct {SERIES_NAME}, ',' order by {SERIES_NAME}) as series, string_agg(distinct area, ',' order by area) as macro_areas, string_agg(distinct timing_source, ',' order by timing_source) as timing_sources, 'available_date' as availability_source, true as vintage_safe, bool_and(lookahead_safe) as lookahead_safe, bool_and(revision_safe) as revision_safe from (select *, coalesce(case when coalesce(macro_area, {OWN_AREA}) is not null then {AREA_SQL.format(x=f'coalesce(macro_area, {OWN_AREA})')} end, 'UNKNOWN') as area from fx_macro_partly)",
    ),
    "set_panel": (
        lambda s, d: _set_panel(s, d).select("gvkey", "permno", "date", "matched", F.array_join(F.col("geo_ids").cast("array<string>"), ",").alias("ids"), q6(F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)).alias("kept_share")),
        f"select gvkey, permno, date, ids is not null as matched, array_to_string(list_resize(coalesce(ids, []), {LONGEST}, 0), ',') as ids, {d6('coalesce(list_sum(shares)::double, 0)', 'kept_share')} from {SET_PANEL}",
    ),
    "set_match": (
        lambda s, d: base._q(features.set_coverage(_set_panel(s, d), LABELS, LONGEST), "matched_set_rate"),
        f"select count(*) as encoded_rows, count(ids) as matched_set_rows, {d6('count(ids) / count(*)', 'matched_set_rate')}, {LONGEST} as max_segments, {LABELS} as vocab_size, count(distinct (gvkey, segment_srcdate)) filter (where ids is not null) as used_snapshots from {SET_PANEL}",
    ),
    "set_predictions": (_set_predictions, None),
    "set_losses": (_set_losses, None),
    "set_summary": (_set_summary, None),
    "boosted_folds": (_boosted, None),
    "boosted_importances": (_importances, None),
    "exposure_by_sector": (
        lambda s, d: base._q(exposure_panel.exposure_by_sector(base._panel(s, d), base._tokens(s, d), panel.prepared_returns(view(s, d, "fx_returns")), 3), "mean_share"),
        f"select * from (with x as (select t.geo_label, t.revenue_share, case when r.permno is null then 'Unknown' else {base.SECTOR_SQL.replace('siccd', 'r.siccd')} end as sector from pan p left join rets r on r.permno = p.permno and r.date = p.date join tok t on t.gvkey = p.gvkey and t.segment_srcdate = p.segment_srcdate where year(p.date) = (select max(year(date)) from pan)) select sector, geo_label, {d6('avg(revenue_share)', 'mean_share')}, count(*) as firm_months from x where geo_label in (select geo_label from x group by 1 order by sum(revenue_share) desc, geo_label limit 3) group by 1, 2)",
    ),
    "state_audit": (
        lambda s, d: audits.audit(_bodies(s, d), _own_rules()).select("area", "check", "status"),
        "select * from (select 'panel' as area, 'manifest_exists' as check, 'pass' as status union all select unnest(['models', 'factor', 'claims', 'tables']), 'manifest_exists', 'pass' union all select 'baseline', 'manifest_exists', 'fail' union all select 'panel', 'status_ok', case when (select count(*) from pan) > 0 then 'pass' else 'fail' end"
        " union all select 'panel', 'activation_no_violations', case when (select count(*) from pan where date <= segment_activation_date) = 0 then 'pass' else 'fail' end"
        f" union all select 'panel', 'row_count', case when (select count(*) from pan) >= {audits.PANEL_ROWS} then 'pass' else 'fail' end union all select 'models', 'variants', case when (select count(*) from msum where model_family = 'lgbm' and status = 'ok') >= 2 then 'pass' else 'fail' end"
        " union all select 'factor', 'variants', case when (select count(*) from rsum) >= 3 then 'pass' else 'fail' end union all select 'models', 'lists_variants', 'pass' union all select 'claims', 'no_validation_failures', 'pass' union all select 'claims', 'blocked_claims', 'blocked' union all select 'claims', 'reviewed_or_clean', 'pass')",
    ),
    "holdout_freeze": (_freeze, _freeze_sql()),
    "segments_extract": (
        lambda s, d: _extract("segments", "geo", "amounts")(s, d).groupBy("gvkey", "srcdate").agg(F.count("*").alias("n"), F.count("gareag").alias("named"), q6(F.sum("revts")).alias("revts")),
        f"select gvkey, srcdate, count(*) as n, count(g.gareag) as named, {d6('sum(v.revts)', 'revts')} {SEGMENTS_1996} group by 1, 2",
    ),
    "daily_extract": (
        lambda s, d: _extract("daily", "daily")(s, d).groupBy("permno", "date").agg(F.count("*").alias("n"), q6(F.sum("prc")).alias("prc"), q6(F.sum("mktcap")).alias("mktcap")),
        f"select l_partkey as permno, cast(l_shipdate as date) as date, count(*) as n, {d6('sum(l_extendedprice / l_quantity)', 'prc')}, {d6('sum(l_extendedprice)', 'mktcap')} from lineitem where cast(l_shipdate as date) between date '1996-01-01' and date '1996-12-31' group by 1, 2",
    ),
    "funda_extract": (
        lambda s, d: _extract("funda", "funda")(s, d).select("gvkey", "datadate", "fyear", "fyr", "fdate", "pdate", *(q6(c).alias(c) for c in FUNDA_CASTS), "prcc_f", "csho"),
        "select gvkey, datadate, year(datadate) as fyear, month(datadate) as fyr, fdate, pdate, " + ", ".join(d6('f."at"' if c == "at" else "f.sale" if c == "revt" else f"f.{c}", f'"{c}"') for c in FUNDA_CASTS) + ", 1.5::double as prcc_f, 2.0::double as csho from fx_funda_once f where datadate between date '1994-01-01' and date '1996-12-31' and cast(gvkey as int) % 9 <> 0",
    ),
    "links_extract": (_extract("links", "links"), f"select gvkey, permno, permno as permco, linkdt, linkenddt, linktype, linkprim, 1 as usedflag {LINKS_1996}"),
    "factors_extract": (
        lambda s, d: base._q(_extract("factors", "factors")(s, d), "mktrf", "smb", "hml", "umd"),
        "select dateff as date, " + ", ".join(map(d6, ("mktrf", "smb", "hml", "umd"))) + ", rf, year from fx_factors_once where dateff between date '1996-01-01' and date '1997-03-31'",
    ),
    "smoke_extract": (
        _smoke,
        f"select * from (with seg as (select gvkey {SEGMENTS_1996} and g.gareat is not null), l as (select gvkey, permno {LINKS_1996} and gvkey in (select gvkey from seg)) select 'segments' as name, count(*) as rows, count(distinct gvkey) as firms from seg union all select 'links', count(*), count(distinct gvkey) from l union all select 'returns', count(*), count(distinct permno) from fx_returns_once where date between date '1996-01-01' and date '1997-03-31' and permno in (select permno from l))",
    ),
}
