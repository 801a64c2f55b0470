"""Cross-sectional evaluation: quintiles, spreads, rank correlations, slopes, turnover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .asof import join_same

LEAST, DISTINCT = 25, 5


def numbered(df: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """`df` with _g, the place of its group among all in order, instead of the groups' columns, dealt by it; and the groups,
    one row each. Windows and sorts then hold one number a row instead of names. There are twice as many parts as groups,
    so a task holds few of them, however well the rows compress."""
    order = Window.orderBy(*(F.asc_nulls_first(c) for c in groups))  # one row a group
    places = stored(df.select(*groups).distinct().withColumn("_g", F.row_number().over(order)), "groups")
    return join_same(df, F.broadcast(places), groups).drop(*groups).repartition(2 * places.count() or 1, "_g"), places


def quintiles(df: DataFrame, x: str, *, by: list[str] | None = None, date: str = "date", tie: str = "permno", out: str = "quintile") -> DataFrame:
    """Quintile of x within each date (and `by`), first-come ranks by x then `tie`, edges interpolated between ranks; null where the
    date has fewer than 25 values or 5 different ones, or x is null. Rows are dealt and sorted once: sizes and different values
    are counted over the same order."""
    has = F.col(x).isNotNull()
    groups = [*(by or []), date]
    ranked, places = numbered(df, groups)
    first = Window.partitionBy("_g").orderBy(F.asc_nulls_last(x), tie)
    before = F.lag(x).over(first)
    ranked = ranked.withColumns({"_r": F.row_number().over(first), "_new": F.when(has & (before.isNull() | (before != F.col(x))), 1)})
    whole = Window.partitionBy("_g")
    ranked = ranked.withColumns({"_n": F.count(x).over(whole), "_d": F.count("_new").over(whole)})
    n, r = F.col("_n"), F.col("_r")
    q = F.greatest(F.lit(1), F.floor((5 * (r - 1) + n - 2) / (n - 1)).cast("int"))
    ranked = ranked.withColumn(out, F.when(has & (n >= LEAST) & (F.col("_d") >= DISTINCT), q))
    return ranked.join(F.broadcast(places), "_g").select(*(c for c in df.columns if c != out), out)


def quintile_returns(df: DataFrame, by: list[str], target: str, score: str, *, quintile: str = "quintile") -> DataFrame:
    return df.where(F.col(quintile).isNotNull()).groupBy(*by, quintile).agg(F.avg(target).alias("mean_ret"), F.count_distinct("permno").alias("n"), F.avg(score).alias("mean_score"))


def spreads(returns: DataFrame, by: list[str], *, quintile: str = "quintile") -> DataFrame:
    """Top less bottom quintile; groups without either are left out."""
    pick = lambda q, c: F.max(F.when(F.col(quintile) == q, F.col(c)))
    wide = returns.groupBy(*by).agg(pick(5, "mean_ret").alias("q5_ret"), pick(1, "mean_ret").alias("q1_ret"), pick(5, "n").alias("q5_n"), pick(1, "n").alias("q1_n"))
    return wide.where("q5_n IS NOT NULL AND q1_n IS NOT NULL").withColumn("q5_minus_q1", F.col("q5_ret") - F.col("q1_ret"))


def cumulated(x: Column, window: Window) -> Column:
    """Compounded so far, null as zero."""
    return F.product(1 + F.coalesce(x, F.lit(0.0))).over(window.rowsBetween(Window.unboundedPreceding, 0)) - 1


def average_rank(x: str, by: list[str]) -> Column:
    """The mean of the first and last place of x's equals: rank() is the first, and the count up to them is the last."""
    order = Window.partitionBy(*by).orderBy(x)
    return (F.rank().over(order) + F.count("*").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2


def rank_ic(df: DataFrame, x: str, y: str, *, by: list[str] | None = None, date: str = "date", least: int = LEAST, distinct: int = 3) -> DataFrame:
    """Spearman correlation of x and y per date (and `by`) with enough rows and different values. Rows hold a group's number,
    x and y; they are dealt once and sorted twice, and different values are counted by the first of each run of equals."""
    groups = [*(by or []), date]
    rows, places = numbered(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, F.col(x).alias("_a"), F.col(y).alias("_b")), groups)
    for value, rank in (("_a", "_x"), ("_b", "_y")):
        order = Window.partitionBy("_g").orderBy(value)
        rows = rows.withColumns({rank: average_rank(value, ["_g"]), f"_new{rank}": F.rank().over(order) == F.row_number().over(order)})
    out = rows.groupBy("_g").agg(F.count("*").alias("n"), F.count_if("_new_x").alias("_dx"), F.count_if("_new_y").alias("_dy"), F.covar_pop("_x", "_y").alias("_c"), F.var_pop("_x").alias("_vx"), F.var_pop("_y").alias("_vy"))
    out = out.where((F.col("n") >= least) & (F.col("_dx") >= distinct) & (F.col("_dy") >= distinct)).join(F.broadcast(places), "_g")
    return out.select(*groups, F.try_divide(F.col("_c"), F.sqrt("_vx") * F.sqrt("_vy")).alias("rank_ic"), "n")


def slopes(df: DataFrame, x: str, y: str, *, date: str = "date", least: int = LEAST, distinct: int = 3) -> DataFrame:
    """Least-squares slope of y on x per date."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = rows.groupBy(date).agg(F.regr_slope(y, x).alias("beta"), F.count("*").alias("n"), F.count_distinct(x).alias("_d"))
    return out.where((F.col("n") >= least) & (F.col("_d") >= distinct)).drop("_d")


def t_stat(x: str) -> Column:
    """Mean over its standard error; null for fewer than three values or none that vary."""
    return F.when(F.count(x) >= 3, F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.count(x))))


def turnover(scored: DataFrame, by: list[str], *, date: str = "date", quintile: str = "quintile") -> DataFrame:
    """Share of new names in the top and bottom quintile against the previous scored date, and their mean."""
    names = lambda q: F.collect_set(F.when(F.col(quintile) == q, F.col("permno")))
    legs = scored.where(F.col(quintile).isNotNull()).groupBy(*by, date).agg(names(5).alias("_long"), names(1).alias("_short"))
    before = Window.partitionBy(*by).orderBy(date)
    fresh = lambda c: 1 - F.size(F.array_intersect(c, F.lag(c).over(before))) / F.greatest(F.size(c), F.lit(1))
    seen = F.lag(F.lit(1)).over(before).isNotNull()
    legs = legs.select(*by, date, F.when(seen, fresh(F.col("_long"))).alias("long_turnover"), F.when(seen, fresh(F.col("_short"))).alias("short_turnover"), F.size("_long").alias("long_n"), F.size("_short").alias("short_n"))
    return legs.withColumn("long_short_turnover", (F.col("long_turnover") + F.col("short_turnover")) / 2)


def net_of_cost(gross: Column, turned: Column, basis_points: float) -> Column:
    return gross - F.lit(basis_points / 1e4) * F.coalesce(turned, F.lit(0.0))


def yearly_folds(dates: DataFrame, *, date: str = "date", least: int = 36, holdout: str = "2026-01-01") -> DataFrame:
    """Expanding folds: each year before the holdout with enough earlier dates, its dates and the earlier ones."""
    days = dates.select(F.col(date).alias("d")).where(F.col("d") < F.lit(holdout).cast("date")).distinct()
    years = days.groupBy(F.year("d").alias("fold_year")).agg(F.min("d").alias("validation_start"), F.max("d").alias("validation_end"), F.count("*").alias("validation_months"))
    before = Window.orderBy("fold_year").rowsBetween(Window.unboundedPreceding, -1)  # one row a year
    folds = years.withColumns({"train_start": F.min("validation_start").over(before), "train_end": F.max("validation_end").over(before), "train_months": F.sum("validation_months").over(before)})
    return folds.where(F.col("train_months") >= least)
