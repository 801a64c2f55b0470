"""As-of and interval joins, and dedupes with explicit ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, *, allow_exact: bool = False, ties: list[str] | None = None) -> DataFrame:
    """`left` with the columns of the latest row of `right` before left_on (or at it, with allow_exact) by `by`.

    One exchange: both sides as one table, sorted by key and time, the payload carried forward as one struct, so a null
    in the matched row hides no older value. Among equal times the largest of `ties` wins. Left rows without a match or
    a time keep nulls; right rows without a time never match.
    """
    return asof_joins(left, [(right, right_on, ties or [])], by, left_on, allow_exact=allow_exact)


def asof_joins(left: DataFrame, rights: list[tuple[DataFrame, str, list[str]]], by: list[str], left_on: str, *, allow_exact: bool = False) -> DataFrame:
    """asof_join() with several tables (right, right_on, ties), all over one exchange and one sort."""
    both, order, shown = left.select(*by, F.col(left_on).alias("_t"), F.lit(1 if allow_exact else 0).alias("_side"), F.struct(*left.columns).alias("_left")), [F.asc_nulls_first("_t"), "_side"], []
    for i, (right, right_on, ties) in enumerate(rights):
        payload = [c for c in right.columns if c not in by]
        rows = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_t"), F.lit(0 if allow_exact else 1).alias("_side"), F.struct(*payload).alias(f"_right{i}"))
        both = both.unionByName(rows, allowMissingColumns=True)
        order += [F.col(f"_right{i}.{t}").asc_nulls_first() for t in ties]
        shown += [F.when(F.col("_t").isNotNull(), F.col(f"_match{i}.{c}")).alias(c) for c in payload]
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumns({f"_match{i}": F.last(f"_right{i}", ignorenulls=True).over(so_far) for i in range(len(rights))})
    return matched.where(F.col("_left").isNotNull()).select("_left.*", *shown)


def interval_join(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, stop: str) -> DataFrame:
    """Inner join on `by` where start <= at <= stop, both ends in; a null stop is open."""
    inside = (F.col(at) >= F.col(start)) & (F.col(stop).isNull() | (F.col(at) <= F.col(stop)))
    on = [left[c] == right[c] for c in by]
    return left.join(right, [*on, inside]).select(*(left[c] for c in left.columns), *(right[c] for c in right.columns if c not in by))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null like any other value; the keys are the left side's, once."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*(f"_{k}" for k in keys))
