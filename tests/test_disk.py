"""Steps of a kept table leave nothing on the disks, and wide rows are not dealt again and again."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import features, macro, panel, robustness
from tidemark.sources.stored import kept, matches, shared_dir, stored


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split("), ")[0] for line in plan.split("\n") if "Exchange hashpartitioning(" in line]


def test_steps_and_shuffle_files_go_when_the_kept_table_is_written(spark):
    files = lambda: sum(1 for f in str(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")).split("\n") if "/shuffle_" in f)
    before = files()

    def build():
        step = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "a_step")
        return step.groupBy("count").agg(F.max("k").alias("k"))

    out = kept(spark, "somewhere", "of_steps", build)
    assert files() <= before  # 8 more at least, before they were deleted
    assert not matches(spark, f"{shared_dir(spark)}/tidemark_a_step_*") and matches(spark, f"{shared_dir(spark)}/tidemark_kept_of_steps_*")
    assert out.count() == 2


def test_the_panel_deals_narrow_rows_once_by_firm(spark):
    d = lambda m, day=28: date(2001, m, day)
    returns = spark.createDataFrame([(1, d(m), 0.1 * m, 2001) for m in range(1, 7)] + [(2, d(m), 0.5, 2001) for m in (2, 3)], "permno long, date date, ret double, year int")
    links = spark.createDataFrame([("a", 1, d(1, 1), d(3, 31), "LU", "P"), ("b", 1, d(4, 1), None, "LU", "P"), ("c", 2, d(1, 1), None, "LU", "P")], "gvkey string, permno long, linkdt date, linkenddt date, linktype string, linkprim string")
    active = spark.createDataFrame([("a", d(1, 1), 1.0, d(2, 1)), ("b", d(1, 1), 2.0, d(4, 28)), ("b", d(5, 1), 3.0, d(5, 30))], "gvkey string, segment_srcdate date, share double, segment_activation_date date")
    funda = spark.createDataFrame([("a", d(1, 1), d(3, 1), 9.0, 2001), ("b", d(1, 2), None, 8.0, 2001)], "gvkey string, datadate date, pdate date, at double, year int")
    factors = spark.createDataFrame([(d(m), 0.5, 0.01 * m, 2001) for m in range(1, 7)], "dateff date, mktrf double, rf double, year int")
    out = panel.monthly_panel(returns, links, active, funda, factors)
    assert [x.split("#")[0] for x in exchanges(out)] == ["gvkey"]
    # in April firm b is not active yet, so the row after March's is May's
    rows = {r["date"].month: (r["gvkey"], r["share"], r["at"], round(r["next_month_ret"], 9) if r["next_month_ret"] else None, round(r["next_month_excess_ret"], 9) if r["next_month_ret"] else None) for r in out.collect()}
    assert rows == {2: ("a", 1.0, None, 0.3, 0.27), 3: ("a", 1.0, 9.0, 0.5, 0.45), 5: ("b", 2.0, None, 0.6, 0.54), 6: ("b", 3.0, None, None, None)}


def test_features_come_without_a_join(spark):
    rows = spark.createDataFrame([("a", 1, date(2001, 1, 31), 2.0, 1.0)], "gvkey string, permno long, date date, at double, sale double")
    frame = features.model_frame(rows)
    assert "Join" not in frame._jdf.queryExecution().executedPlan().toString() and frame.columns == ["gvkey", "permno", "date", "at", "sale", "log_at", "sales_to_assets"]


def test_the_tensor_deals_rows_and_tokens_by_snapshot_only(spark):
    day = date(2001, 1, 31)
    rows = spark.createDataFrame([("a", 1, day, day), ("b", 2, day, day)], "gvkey string, permno long, date date, segment_srcdate date")
    tokens = spark.createDataFrame([("a", day, "X", "EUROPE", 0.25), ("a", day, "Y", "EUROPE", 0.25), ("a", day, "Z", "ASIA", 0.5)], "gvkey string, segment_srcdate date, geo_label string, macro_area string, revenue_share double")
    states = macro.macro_states(spark.createDataFrame([("s", "Europe", date(2000, 12, 1), 4.0, date(2000, 12, 31))], "series_id string, macro_area string, date date, value double, available_date date"))
    out = macro.macro_tensor(rows, tokens, states, ["s"])
    assert not [x for x in exchanges(out) if "permno" in x]
    got = {r["gvkey"]: (r["macro_token_rows"], r["macro_geo_count"], r["macro_area_count"], r["segment_macro_s"], r["macro_revenue_share_covered"]) for r in out.collect()}
    assert got == {"a": (3, 3, 2, 2.0, 0.5), "b": (None,) * 5}


def test_quintiles_of_predictions_are_made_once_for_spread_and_turnover(spark):
    rows = [("f", "r", "v", date(2001, m, 28), i, float(i * m % 31), float(i), 2001, 9) for m in (1, 2, 3) for i in range(30)]
    predictions = spark.createDataFrame(rows, "model_family string, model_run_id string, variant string, date date, permno long, prediction double, target double, fold_year int, train_rows long")
    out = robustness.with_costs(predictions)
    assert "Window" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "row_number" not in plan  # twice before
    got = {r["date"].month: (r["q5_minus_q1"], r["long_short_turnover"]) for r in out.collect()}
    order = {m: sorted(range(30), key=lambda i, m=m: (i * m % 31, i)) for m in (1, 2, 3)}
    assert {m: x[0] for m, x in got.items()} == {m: sum(o[-6:]) / 6 - sum(o[:6]) / 6 for m, o in order.items()}
    fresh = lambda m, cut: 1 - len(set(order[m][cut]) & set(order[m - 1][cut])) / 6
    assert got[1][1] is None and all(abs(got[m][1] - (fresh(m, slice(-6, None)) + fresh(m, slice(0, 6))) / 2) < 1e-12 for m in (2, 3))
