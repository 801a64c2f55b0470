from __future__ import annotations

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators import macro, panel, robustness, xsec
from tidemark.operators.asof import asof_join, interval_join, keep_one


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize(
    ("label", "area", "home"),
    [("Rest of World", "GLOBAL", False), ("United States", "USA", True), ("China", "CHINA", False), ("Germany", "EUROPE", False), (None, "UNKNOWN", False), ("  ", "UNKNOWN", False),
     ("AUSTRALIA", "USA", False), ("Latin American", "CANADA", False), ("UNKNOWN", "OTHER_FOREIGN", False), ("Non-US", "USA", True), ("US_OPS", "USA", False)],
)
def test_labels(spark, label, area, home):
    row = one(spark, label).select(fn.macro_area(F.col("x")), fn.is_domestic(F.col("x"))).first()
    assert (row[0], row[1]) == (area, home)


@pytest.mark.parametrize(
    ("period", "year", "end"),
    [("M02", 2020, date(2020, 2, 29)), ("2020Q2", None, date(2020, 6, 30)), ("2020-q2", None, date(2020, 6, 30)), ("2020", None, date(2020, 12, 31)), ("M02", None, None), ("M13", 2020, None), ("nonsense", 2020, None), ("2020-05", None, date(2020, 5, 31)), ("2020-05-03", None, date(2020, 5, 3))],
)
def test_periods(spark, period, year, end):
    df = spark.createDataFrame([(period, year)], "p string, y int")
    assert df.select(fn.period_to_date(F.col("p"), F.col("y"))).first()[0] == end


def test_calendar_slug_and_sector(spark):
    days = spark.createDataFrame([(date(2020, 1, 31),), (date(2020, 2, 10),)], "d date")
    assert [tuple(r) for r in days.select(fn.next_month_end(F.col("d")), fn.quarter_end(F.col("d"))).collect()] == [(date(2020, 2, 29), date(2020, 3, 31)), (date(2020, 2, 29), date(2020, 3, 31))]
    texts = spark.createDataFrame([(" A--b C! ", "6021"), ("--", "1800"), ("x", None), ("é1", "2834.0")], "t string, s string")
    assert [tuple(r) for r in texts.select(fn.slug(F.col("t")), fn.sic_sector(F.col("s"))).collect()] == [("a_b_c", "Finance"), ("unknown", "Unknown"), ("x", "Unknown"), ("é1", "Manufacturing")]


def test_asof_is_exclusive_or_inclusive_and_moves_whole_rows(spark):
    left = spark.createDataFrame([("a", 1, date(2020, 1, 1)), ("a", 2, date(2020, 1, 2)), ("a", 3, None), ("b", 4, date(2020, 1, 2))], "k string, id int, t date")
    right = spark.createDataFrame([("a", date(2020, 1, 1), 1, 10), ("a", date(2020, 1, 1), 2, None), ("a", None, 9, 99)], "k string, u date, rank int, v int")
    got = lambda exact: {r["id"]: (r["rank"], r["v"]) for r in asof_join(left, right, ["k"], "t", "u", allow_exact=exact, ties=["rank"]).collect()}
    assert got(False) == {1: (None, None), 2: (2, None), 3: (None, None), 4: (None, None)}
    assert got(True) == {1: (2, None), 2: (2, None), 3: (None, None), 4: (None, None)}


def test_interval_join_has_closed_ends(spark):
    left = spark.createDataFrame([(1, date(2020, 1, 1)), (1, date(2020, 2, 1)), (2, date(2030, 1, 1))], "k int, t date")
    right = spark.createDataFrame([(1, date(2020, 1, 1), date(2020, 1, 1), "x"), (2, date(2020, 1, 1), None, "y")], "k int, a date, b date, v string")
    assert sorted((r["k"], r["v"]) for r in interval_join(left, right, ["k"], "t", "a", "b").collect()) == [(1, "x"), (2, "y")]
    assert keep_one(left, ["k"], [F.desc("t")]).count() == 2


def test_snapshots_count_null_labels_as_foreign(spark):
    rows = [("f", "1", date(2020, 3, 31), date(2020, 2, 29), "United States", None, 6.0, None, None), ("f", "2", date(2020, 3, 31), date(2020, 2, 29), "", None, None, 4.0, 1.0), ("f", "3", date(2020, 3, 31), None, "X", None, -1.0, 5.0, None)]
    segments = spark.createDataFrame(rows, "gvkey string, sid string, srcdate date, datadate date, gareag string, gareat string, sales double, revts double, ias double")
    row = panel.snapshots(segments).first()
    assert (row["foreign_share"], row["domestic_share"], row["geo_count"], row["segment_rows"]) == (0.4, 0.6, 1, 2)
    assert math.isclose(row["geo_hhi"], 0.52)
    tokens = {r["geo_label"]: r["macro_area"] for r in panel.geo_tokens(segments).collect()}
    assert tokens == {"United States": "USA", "UNKNOWN": "OTHER_FOREIGN"}


def test_quintiles_need_enough_values(spark):
    many = spark.createDataFrame([(date(2020, 1, 31), i, float(i)) for i in range(50)] + [(date(2020, 2, 29), i, float(i)) for i in range(24)], "date date, permno int, x double")
    counts = {(r["date"].month, r["quintile"]): r["count"] for r in xsec.quintiles(many, "x").groupBy("date", "quintile").count().collect()}
    assert counts == {(1, q): 10 for q in range(1, 6)} | {(2, None): 24}


def test_factors_in_percent_are_scaled_as_a_whole(spark):
    factors = spark.createDataFrame([(date(2020, 1, 31), 2.0, 0.5), (date(2020, 2, 29), 0.5, 0.5)], "dateff date, mktrf double, smb double")
    rows = panel.scaled_factors(factors, ("mktrf", "smb")).orderBy("factor_date").collect()
    assert [(r["mktrf"], r["smb"]) for r in rows] == [(0.02, 0.5), (0.005, 0.5)]


def test_macro_uses_only_released_values_and_falls_back_by_area(spark):
    states = macro.macro_states(spark.createDataFrame(
        [("s", "United States", date(2020, 1, 1), date(2020, 2, 7), 2.0), ("s", "GLOBAL", date(2020, 1, 1), date(2020, 1, 20), 5.0), ("s", "United States", date(2020, 2, 1), date(2020, 9, 1), 99.0)],
        "series_id string, macro_area string, date date, available_date date, value double",
    ))
    tokens = spark.createDataFrame([("f", date(2020, 1, 31), "USA", 0.6), ("f", date(2020, 1, 31), "EUROPE", 0.4), ("f", date(2020, 2, 29), "USA", 0.6), ("f", date(2020, 2, 29), "EUROPE", 0.4)], "gvkey string, date date, macro_area string, revenue_share double")
    rows = macro.macro_interactions(macro.macro_on_tokens(tokens, states), ["gvkey", "date"]).orderBy("date").collect()
    assert [round(r["segment_macro_value"], 9) for r in rows] == [2.0, 3.2]  # USA has states, none known in January: no fallback
    assert [round(r["revenue_share_covered"], 9) for r in rows] == [0.4, 1.0]


def test_t_stat_turnover_and_alpha(spark):
    few = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert few.agg(xsec.t_stat("x")).first()[0] is None
    names = [(date(2020, 1, 31), 1, 5), (date(2020, 1, 31), 2, 1), (date(2020, 2, 29), 1, 5), (date(2020, 2, 29), 3, 1)]
    turned = xsec.turnover(spark.createDataFrame([("m", *r) for r in names], "variant string, date date, permno int, quintile int"), ["variant"]).orderBy("date").collect()
    assert [r["long_short_turnover"] for r in turned] == [None, 0.5]
    months = [("m", date(2020 + i // 12, i % 12 + 1, 1), 0.01 + 2.0 * f + 0.001 * (-1) ** i, f) for i in range(24) for f in [math.sin(i)]]
    fit = robustness.factor_alphas(spark.createDataFrame(months, "variant string, date date, y double, f double"), ["variant"], "y", ["f"], lags=3).first()
    x, y = np.array([[1.0, m[3]] for m in months]), np.array([m[2] for m in months])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    u = x * (y - x @ beta)[:, None]
    middle = u.T @ u
    for k in (1, 2, 3):
        middle += (1 - k / 4) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:])
    bread = np.linalg.inv(x.T @ x)
    assert math.isclose(fit["alpha"], beta[0], rel_tol=1e-9) and math.isclose(fit["beta_f"], beta[1], rel_tol=1e-9)
    assert math.isclose(fit["alpha_t"], beta[0] / math.sqrt((bread @ middle @ bread)[0, 0]), rel_tol=1e-6) and fit["r2"] > 0.99 and fit["n_months"] == 24


def test_filings_keep_the_earliest_and_name_their_source(spark):
    snaps = spark.createDataFrame([("f", date(2020, 2, 29), date(2020, 3, 31)), ("g", date(2020, 2, 29), date(2020, 3, 31))], "gvkey string, segment_datadate date, segment_srcdate date")
    filings = spark.createDataFrame([("f", date(2020, 2, 29), None, date(2020, 4, 20)), ("f", date(2020, 2, 29), date(2020, 4, 10), None), ("g", None, date(2020, 1, 1), None)], "gvkey string, datadate date, pdate date, fdate date")
    rows = {r["gvkey"]: (r["segment_activation_date"], r["activation_source"]) for r in panel.activation_dates(snaps, filings).collect()}
    assert rows == {"f": (date(2020, 4, 11), "pdate"), "g": (date(2020, 4, 1), "srcdate_fallback")}
    assert {r["activation_source"] for r in panel.activation_dates(snaps, None).collect()} == {"srcdate_fallback"}


def test_repeated_inputs_keep_one_row(spark):
    returns = spark.createDataFrame([(1, date(2020, 1, 31), "0.1", 2019), (1, date(2020, 1, 31), "0.2", 2020), (1, None, "1", 2020), (2, date(2020, 1, 31), "x", 2020)], "permno int, date date, ret string, year int")
    assert {r["permno"]: r["ret"] for r in panel.prepared_returns(returns).collect()} == {1: 0.2, 2: None}
    factors = spark.createDataFrame([(date(2020, 1, 31), 0.5, 2019), (date(2020, 1, 31), 0.25, 2020)], "dateff date, mktrf double, year int")
    assert [r["mktrf"] for r in panel.scaled_factors(factors).collect()] == [0.25]


def test_macro_tensor_is_wide_and_covers_any_value(spark):
    states = macro.macro_states(spark.createDataFrame([("s", "GLOBAL", date(2020, 1, 1), date(2020, 1, 20), 1.5)], "series_id string, macro_area string, date date, available_date date, value double"))
    tokens = spark.createDataFrame([("f", date(2019, 12, 31), "USA", "USA", 0.6), ("f", date(2019, 12, 31), "Germany", "EUROPE", 0.4)], "gvkey string, segment_srcdate date, geo_label string, macro_area string, revenue_share double")
    rows = spark.createDataFrame([("f", 1, d, date(2019, 12, 31)) for d in (date(2020, 1, 10), date(2020, 1, 31), date(2024, 6, 30))] + [("g", 2, date(2020, 1, 31), date(2019, 12, 31))], "gvkey string, permno int, date date, segment_srcdate date")
    out = {(r["gvkey"], r["date"]): r for r in macro.macro_tensor(rows, tokens, states).collect()}
    assert [(round(out["f", d]["segment_macro_s"], 9), out["f", d]["macro_revenue_share_covered"], out["f", d]["macro_area_count"]) for d in (date(2020, 1, 10), date(2020, 1, 31), date(2024, 6, 30))] == [(0.0, 0.0, 2), (1.5, 1.0, 2), (1.5, 1.0, 2)]
    assert out["g", date(2020, 1, 31)]["segment_macro_s"] is None
    assert macro.coverage(macro.macro_tensor(rows, tokens, states)).first()["macro_coverage_rate"] == 2 / 3


def test_full_set_encoding_keeps_every_share(spark):
    from tidemark.plans import registry

    rows = registry.queries()["set_encoding_full"](spark, "/root/testdata/sf0.001").collect()
    most = max(sum(i != "0" for i in r["ids"].split(",")) for r in rows)
    assert all(len(r["ids"].split(",")) == 12 and "1" not in r["ids"].split(",") for r in rows)
    assert 3 < most < 12 and all(abs(r["kept_share"] - 1) < 1e-5 for r in rows if r["kept_share"])
