"""Evaluation with null run ids and dependent factors, samples, sets on firm-months, kept tables, and the model queries."""

from __future__ import annotations

import shutil
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, macro, models, robustness
from tidemark.plans import registry
from tidemark.sources import stored

DATA = "/root/testdata/sf0.001"


def month_ends(n: int) -> list[date]:
    return [date(2001 + (k + 1) // 12, (k + 1) % 12 + 1, 1) - timedelta(1) for k in range(n)]


@pytest.mark.parametrize("run", ["r", None])
def test_a_run_without_an_id_is_evaluated_like_any_other(spark, run):
    rng = np.random.default_rng(1)
    rows = [("lgbm", run, "all", i, d, float(rng.normal()), float(rng.normal()), d.year, 100) for d in month_ends(14) for i in range(30)]
    pred = spark.createDataFrame(rows, "model_family string, model_run_id string, variant string, permno long, date date, prediction double, target double, fold_year int, train_rows long")
    assert robustness.with_costs(pred).count() == 14
    one = robustness.model_summary(pred).first()
    assert (one["rank_ic_months"], one["quintile_months"], one["status"], one["model_run_id"]) == (14, 14, "ok", run)
    folds = {r["fold_year"]: r["rank_ic_months"] for r in robustness.fold_metrics(pred).collect()}
    assert folds == {2001: 12, 2002: 2}
    factors = spark.createDataFrame([(d, 0.01, 0.02) for d in month_ends(16)], "factor_date date, mktrf double, smb double")
    robust = robustness.robustness_summary(pred, factors, ["mktrf", "smb"]).first()
    assert (robust["months"], robust["alpha_months"], robust["model_run_id"]) == (14, 14, run)


def test_dependent_factors_share_a_slope_as_least_squares_of_least_norm_do(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2))
    x = np.column_stack([x, 2 * x[:, 0]])
    y = 0.3 + x @ [0.5, -0.2, 0.1] + 0.01 * rng.normal(size=40)
    df = spark.createDataFrame([("v", d, float(b), *map(float, a)) for d, b, a in zip(month_ends(40), y, x, strict=True)], "variant string, date date, y double, a double, b double, c double")
    got = robustness.factor_alphas(df, ["variant"], "y", ["a", "b", "c"]).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(40), x]), y, rcond=None)[0]
    assert [got["alpha"], got["beta_a"], got["beta_b"], got["beta_c"]] == pytest.approx(list(want), abs=1e-9)


def test_samples_are_the_smallest_hashes_whatever_the_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("k"))
    want = {r["id"] for r in df.orderBy(F.xxhash64("id", F.lit(137)), "id").limit(700).collect()}
    for n in (1, 7):
        assert {r["id"] for r in models.train_sample(df.repartition(n), ["id"], 700).collect()} == want
    assert models.train_sample(df, ["id"], 9000).count() == 5000 and models.train_sample(df.limit(0), ["id"], 5).count() == 0


def test_sets_on_firm_months_are_zero_where_there_is_none(spark):
    tokens = spark.createDataFrame([("1", "d", " usa ", 0.5), ("1", "d", "USA", 0.1), ("1", "d", None, 0.3), ("1", "d", "CAN", 0.1), ("2", "e", "CAN", 1.0)], "gvkey string, segment_srcdate string, geo_label string, revenue_share double")
    sets = features.set_tokens(tokens)
    assert {(r["gvkey"], r["geo_label"]): round(r["revenue_share"], 9) for r in sets.collect()} == {("1", "USA"): 0.6, ("1", "UNKNOWN"): 0.3, ("1", "CAN"): 0.1, ("2", "CAN"): 1.0}
    encoded = features.encoded_sets(sets, features.geo_vocabulary(sets, 4), 3)
    months = spark.createDataFrame([("1", "d", 1), ("1", "d", 2), ("2", "x", 3)], "gvkey string, segment_srcdate string, permno int")
    rows = features.panel_sets(months, encoded, 3)
    got = {r["permno"]: (r["matched"], r["geo_ids"], [round(x, 9) for x in r["shares"]], len(r["set_vector"])) for r in rows.collect()}
    assert got[1] == got[2] == (True, [3, 1, 2], [0.6, 0.3, 0.1], 6) and got[3] == (False, [0, 0, 0], [0.0, 0.0, 0.0], 6)
    assert tuple(features.set_coverage(rows, 4, 3).first()) == (3, 2, pytest.approx(2 / 3), 3, 4, 1)


def test_set_variants_take_controls_or_nothing():
    columns = ["foreign_share", "log_at", "ret", "mktrf", "segment_macro_x"]
    assert [features.variant_features(columns, v) for v in ("set_only", "set_plus_controls", "set_transformer")] == [[], ["log_at", "ret", "mktrf"], []]


def test_series_without_an_area_have_their_own(spark):
    rows = [("fedfunds", None), ("CPIAUCSL", "Germany"), ("other", None)]
    named = spark.createDataFrame([(s, a, date(2020, 1, 1), date(2020, 2, 1), 1.0) for s, a in rows], "series_id string, macro_area string, date date, available_date date, value double")
    areas = lambda df: {r["series_name"]: r["macro_area"] for r in macro.macro_states(df).collect()}
    assert areas(named) == {"fedfunds": "USA", "cpiaucsl": "EUROPE", "other": "UNKNOWN"}
    assert areas(named.drop("macro_area")) == {"fedfunds": "USA", "cpiaucsl": "USA", "other": "GLOBAL"}
    assert areas(named.withColumnRenamed("macro_area", "geo_label")) == {"fedfunds": "UNKNOWN", "cpiaucsl": "EUROPE", "other": "UNKNOWN"}
    one = macro.profile(macro.macro_states(named)).first()
    assert (one["lookahead_safe"], one["revision_safe"], one["timing_sources"]) == (True, None, ["available_date"])


def test_kept_tables_are_built_once_and_forgotten(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    one, two = (stored.kept(spark, str(tmp_path), "t", build) for _ in range(2))
    assert built == [1] and one.count() == two.count() == 3
    folder = one.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    stored.forget(spark)
    assert not Path(folder).exists() and stored.kept(spark, str(tmp_path), "t", build).count() == 3 and len(built) == 2
    shutil.rmtree(stored.kept(spark, str(tmp_path), "t", build).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert stored.kept(spark, str(tmp_path), "t", build).count() == 3 and len(built) == 3


def test_the_panel_is_scanned_by_its_users_not_built_again(spark):
    plan = registry._robust(spark, DATA)._jdf.queryExecution().optimizedPlan().toString() + registry._panel(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_partkey" not in plan


def test_model_queries_cover_every_fold(spark):
    q = registry.queries()
    folds = {r["fold_year"] for r in q["yearly_folds"](spark, DATA).collect()}
    sets = q["set_predictions"](spark, DATA)
    by = {(r["variant"], r["fold_year"]): r["n"] for r in sets.groupBy("variant", "fold_year").agg(F.count("*").alias("n")).collect()}
    assert {v for v, _ in by} == {"set_only", "set_plus_controls", "set_transformer"} and {y for _, y in by} == folds
    assert sets.where("prediction IS NULL OR isnan(prediction)").count() == 0 and sets.dropDuplicates(["variant", "permno", "date"]).count() == sets.count()
    assert {r["status"] for r in q["set_summary"](spark, DATA).collect()} == {"ok"}
    trees = q["boosted_folds"](spark, DATA)
    assert {r["fold_year"] for r in trees.select("fold_year").distinct().collect()} == folds
    used = q["boosted_importances"](spark, DATA).groupBy("fold_year").agg(F.sum("importance").alias("n"), F.count("*").alias("features")).collect()
    assert all(r["n"] > 350 and r["features"] == 20 for r in used)
