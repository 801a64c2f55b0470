"""Evaluation of model predictions: fold metrics, summaries, factor alphas before and after costs.

Predictions have model_family, model_run_id, variant, permno, date, prediction, target, fold_year and train_rows. All
figures are grouped aggregates; a group's alpha comes from its sums of products, never from its rows in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import next_month_end
from ..sources.stored import stored
from .asof import join_same
from .xsec import net_of_cost, quintile_returns, quintiles, rank_ic, spreads, t_stat, turnover

MODEL = ["model_family", "model_run_id", "variant"]


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """Rows and train rows of each model's folds, with the months and mean of its rank correlations."""
    counts = predictions.groupBy(*MODEL, "fold_year").agg(F.count("*").alias("prediction_rows"), F.max("train_rows").alias("train_rows"))
    years = predictions.select(*MODEL, "date", "fold_year").distinct()
    ics = join_same(rank_ic(predictions, "prediction", "target", by=MODEL), years, [*MODEL, "date"], "left")
    ics = ics.groupBy(*MODEL, "fold_year").agg(F.count("*").alias("rank_ic_months"), F.avg("rank_ic").alias("mean_rank_ic"))
    return join_same(counts, ics, [*MODEL, "fold_year"], "left")


def importance_summary(importances: DataFrame) -> DataFrame:
    """Mean importance and number of folds of each feature."""
    return importances.groupBy("feature").agg(F.avg("importance").alias("mean_importance"), F.count_distinct("fold_year").alias("folds"))


def scored_quintiles(predictions: DataFrame) -> DataFrame:
    return quintiles(predictions, "prediction", by=MODEL).where("quintile IS NOT NULL")


def model_spreads(scored: DataFrame) -> DataFrame:
    return spreads(quintile_returns(scored, [*MODEL, "date"], "target", "prediction"), [*MODEL, "date"])


def model_summary(predictions: DataFrame) -> DataFrame:
    """One row a model: rows, months and t values of rank correlation and spread, and its status. A macro-only model predicts
    one value a month, so it may lack correlations."""
    rows = predictions.groupBy(*MODEL).agg(F.count("*").alias("prediction_rows"))
    ics = rank_ic(predictions, "prediction", "target", by=MODEL).groupBy(*MODEL).agg(F.count("*").alias("rank_ic_months"), F.avg("rank_ic").alias("mean_rank_ic"), t_stat("rank_ic").alias("t_rank_ic"))
    gaps = model_spreads(scored_quintiles(predictions)).groupBy(*MODEL).agg(F.count_distinct("date").alias("quintile_months"), F.avg("q5_minus_q1").alias("mean_q5_minus_q1"), t_stat("q5_minus_q1").alias("t_q5_minus_q1"))
    out = join_same(join_same(rows, ics, MODEL, "left"), gaps, MODEL, "left").na.fill(0, ["rank_ic_months", "quintile_months"])
    odd = (F.col("variant") == "macro_only") & (F.col("prediction_rows") > 0)
    return out.withColumn("status", F.when(F.col("rank_ic_months") > 0, "ok").when(odd, "diagnostic_only").otherwise("needs_review"))


def least_months(factors: list[str]) -> int:
    return max(12, len(factors) + 3)


def factor_alphas(df: DataFrame, by: list[str], y: str, factors: list[str], *, lags: int = 6, date: str = "date") -> DataFrame:
    """Per group the intercept (alpha) and slopes (beta_<factor>) of y on the factors over complete months, the alpha's
    Newey-West t value with Bartlett weights, the months, and R squared; nulls for groups of too few months.

    Only sums of products leave the rows, one row a group, and their normal equations are solved there (with the
    pseudo-inverse, so dependent factors share a slope). The variance of the intercept needs one number a month, the residual times the month's weight in the intercept; its
    lagged products are a window by date.
    """
    x = ["1e0", *(f"_x{i + 1}" for i in range(len(factors)))]
    n = range(len(x))
    rows = df.select(*by, date, F.col(y).cast("double").alias("_y"), *(F.col(f).cast("double").alias(f"_x{i + 1}") for i, f in enumerate(factors))).dropna(subset=[date, "_y", *(f"_x{i + 1}" for i in range(len(factors)))])
    sums = rows.groupBy(*by).agg(F.count("*").alias("n_months"), *(F.expr(f"sum({x[i]} * {x[j]})").alias(f"s{i}_{j}") for i in n for j in range(i + 1)), *(F.expr(f"sum({x[i]} * _y)").alias(f"b{i}") for i in n))
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in by), "n_months long", *(f"beta{i} double" for i in n), *(f"a{i} double" for i in n)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*by, "n_months"]].copy()
            inverses = [np.linalg.pinv(np.array([[r[f"s{max(i, j)}_{min(i, j)}"] for j in n] for i in n], float), hermitian=True) for r in batch.to_dict("records")]
            betas = [m @ b for m, b in zip(inverses, batch[[f"b{i}" for i in n]].to_numpy(float), strict=True)]
            for i in n:
                out[f"beta{i}"] = [b[i] for b in betas]
            for i in n:
                out[f"a{i}"] = [m[i, 0] for m in inverses]
            yield out

    solved = sums.mapInPandas(solve, schema)  # one row a group
    dot = lambda c: F.expr(" + ".join(f"{c}{i} * {x[i]}" for i in n))
    rows = join_same(rows, solved, by).withColumn("_e", F.col("_y") - dot("beta")).withColumn("_w", F.col("_e") * dot("a"))
    order = Window.partitionBy(*by).orderBy(date)
    lagged = sum((2 * (1 - j / (lags + 1)) * F.coalesce(F.lag("_w", j).over(order), F.lit(0.0)) for j in range(1, lags + 1)), F.col("_w"))
    rows = rows.withColumn("_v", F.col("_w") * lagged)
    figures = rows.groupBy(*by).agg(F.sum("_v").alias("_v"), F.sum(F.col("_e") * F.col("_e")).alias("_sse"), F.var_pop("_y").alias("_var"))
    enough = F.col("n_months") >= least_months(factors)
    alpha_t = F.when(F.col("_v") > 0, F.col("beta0") / F.sqrt("_v"))
    r2 = F.when(F.col("_var") > 0, 1 - F.col("_sse") / (F.col("_var") * F.col("n_months")))
    out = join_same(df.select(*by).distinct(), join_same(solved, figures, by), by, "left")
    shown = {"alpha": F.col("beta0"), "alpha_t": alpha_t, "r2": r2, **{f"beta_{f}": F.col(f"beta{i + 1}") for i, f in enumerate(factors)}}
    return out.select(*by, F.coalesce("n_months", F.lit(0).cast("long")).alias("n_months"), *(F.when(enough, c).alias(k) for k, c in shown.items()))


def with_costs(predictions: DataFrame, basis_points: float = 10.0) -> DataFrame:
    """Monthly spreads of each model, gross, turnover, and net of its cost. Quintiles are stored, as both need them."""
    scored = stored(scored_quintiles(predictions.select(*MODEL, "date", "permno", "prediction", "target")), "scored")
    rows = join_same(model_spreads(scored), turnover(scored, MODEL).select(*MODEL, "date", "long_short_turnover"), [*MODEL, "date"], "left")
    return rows.withColumn("net_q5_minus_q1", net_of_cost(F.col("q5_minus_q1"), F.col("long_short_turnover"), basis_points))


def robustness_summary(predictions: DataFrame, factors: DataFrame, columns: list[str], *, basis_points: float = 10.0, lags: int = 6) -> DataFrame:
    """One row a model: means and t values of the gross and net spread, turnover, and alphas on the factors of the month
    after the scores'. factors: factor_date, one row a month, and the columns."""
    rows = stored(with_costs(predictions, basis_points), "net")  # one row a model and month, which all figures below read
    rows = rows.withColumn("factor_date", next_month_end(F.col("date"))).join(factors, "factor_date", "left")
    means = rows.groupBy(*MODEL).agg(
        F.count("q5_minus_q1").alias("months"), F.avg("q5_minus_q1").alias("mean_gross_q5_minus_q1"), t_stat("q5_minus_q1").alias("t_gross_q5_minus_q1"),
        F.avg("net_q5_minus_q1").alias("mean_net_q5_minus_q1"), t_stat("net_q5_minus_q1").alias("t_net_q5_minus_q1"), F.avg("long_short_turnover").alias("mean_turnover"),
    )
    gross = factor_alphas(rows, MODEL, "q5_minus_q1", columns, lags=lags)
    gross = gross.select(*MODEL, F.col("alpha").alias("gross_alpha"), F.col("alpha_t").alias("gross_alpha_t"), F.col("n_months").alias("alpha_months"), F.col("r2").alias("factor_r2"), *(f"beta_{c}" for c in columns))
    net = factor_alphas(rows, MODEL, "net_q5_minus_q1", columns, lags=lags).select(*MODEL, F.col("alpha").alias("net_alpha"), F.col("alpha_t").alias("net_alpha_t"))
    return join_same(join_same(means, gross, MODEL), net, MODEL)
