"""Macro states by availability and their interaction with geographic revenue shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import AREA_TERMS, macro_area, month_end, slug
from .asof import asof_join, keep_one

VALUES = ("value", "value_delta_1m", "value_delta_12m")
#: Interval rows that are sent to all tasks; a catalog of 100 series, 12 areas and 40 years of months has half as many.
MOST_INTERVALS = 1_000_000


def with_availability(macro: DataFrame, release_lag_days: int = 0) -> DataFrame:
    """`macro` with available_date, availability_source and vintage_safe. One column counts for the whole table: the first of
    available_date, realtime_start and release_date that has any value; without one, the observation date plus the lag.
    The choice is one row, joined to all; rows that are null in the chosen column stay null."""
    names = [c for c in ("available_date", "realtime_start", "release_date") if c in macro.columns]
    day = {c: F.col(c).try_cast("date") for c in names}
    lagged = F.date_add(F.col("date").try_cast("date"), release_lag_days)
    if not names:
        return macro.withColumns({"available_date": lagged, "availability_source": F.lit("observation_date_fallback"), "vintage_safe": F.lit(False)})
    has = macro.agg(*(F.count(day[c]).alias(f"_has_{c}") for c in names))
    chosen, source = F, F
    for c in names:
        chosen, source = chosen.when(F.col(f"_has_{c}") > 0, day[c]), source.when(F.col(f"_has_{c}") > 0, F.lit(c))
    rows = macro.join(F.broadcast(has)).withColumns({"_day": chosen.otherwise(lagged), "availability_source": source.otherwise("observation_date_fallback")})
    rows = rows.withColumn("vintage_safe", F.col("availability_source") != "observation_date_fallback").drop("available_date", *(f"_has_{c}" for c in names))
    return rows.withColumnRenamed("_day", "available_date")


#: The area of a series that names none.
SERIES_AREA = {"FEDFUNDS": "USA", "CPIAUCSL": "USA", "UNRATE": "USA", "INDPRO": "USA", "DTWEXBGS": "USD"}


def state_area(macro: DataFrame) -> Column:
    """The area of each row: of its macro_area, or of the series where that is null; of its label, where the table has no
    macro_area; of the series, else GLOBAL, where it has neither."""
    own = F.create_map(*(F.lit(x) for item in SERIES_AREA.items() for x in item))[F.upper("series_id")]
    if "macro_area" in macro.columns:
        return macro_area(F.coalesce(F.col("macro_area"), own))
    return macro_area(F.col("geo_label")) if "geo_label" in macro.columns else F.coalesce(own, F.lit("GLOBAL"))


def macro_states(macro: DataFrame, release_lag_days: int = 0) -> DataFrame:
    """Values by area, series and availability, the last observation of each, with changes by 1 and 12 rows. What the table
    says of its timing (timing_source, lookahead_safe, revision_safe) stays, null where it says nothing."""
    more = {"timing_source": "string", "lookahead_safe": "boolean", "revision_safe": "boolean"}
    rows = with_availability(macro, release_lag_days).select(
        state_area(macro).alias("macro_area"), slug(F.col("series_id")).alias("series_name"), month_end(F.col("date").try_cast("date")).alias("observation_date"), "available_date", F.col("value").try_cast("double").alias("value"), "availability_source", "vintage_safe",
        *((F.col(c) if c in macro.columns else F.lit(None)).cast(kind).alias(c) for c, kind in more.items()),
    ).where("observation_date IS NOT NULL AND available_date IS NOT NULL AND value IS NOT NULL")
    rows = keep_one(rows, ["macro_area", "series_name", "available_date"], [F.desc("observation_date"), F.desc("value")])
    order = Window.partitionBy("macro_area", "series_name").orderBy("available_date")
    return rows.withColumns({f"value_delta_{n}m": F.col("value") - F.lag("value", n).over(order) for n in (1, 12)})


def profile(states: DataFrame) -> DataFrame:
    """One row: rows, sorted names of series, areas and timings, where availability is from, and whether every row is safe from
    later knowledge: as the rows say, else by their vintages; of revisions nothing is known where no row says so."""
    names = lambda c: F.sort_array(F.collect_set(c))  # noqa: E731  of the catalog's size
    return states.agg(
        F.count("*").alias("rows"), names("series_name").alias("series"), names("macro_area").alias("macro_areas"), F.first("availability_source").alias("availability_source"), F.every("vintage_safe").alias("vintage_safe"),
        F.coalesce(F.every("lookahead_safe"), F.every("vintage_safe")).alias("lookahead_safe"), F.every("revision_safe").alias("revision_safe"), names(F.coalesce("timing_source", "availability_source")).alias("timing_sources"),
    )


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def state_intervals(states: DataFrame) -> DataFrame:
    """(series_name, area, month, available_date, until, values): each state for every month in which it is the last one
    known on some day, for every area that a token can have. An area without any state of a series has the GLOBAL ones. A
    last state stands once more for all months after the last availability of any series."""
    order = Window.partitionBy("macro_area", "series_name").orderBy("available_date")
    rows = states.select("macro_area", "series_name", "available_date", F.lead("available_date").over(order).alias("until"), *VALUES)
    areas = F.array(*map(F.lit, [*AREA_TERMS, "OTHER_FOREIGN", "UNKNOWN"]))
    own = rows.groupBy("series_name").agg(F.collect_set("macro_area").alias("_own"))
    takes = F.when(F.col("macro_area") == "GLOBAL", F.array_union(F.array(F.lit("GLOBAL")), F.array_except(areas, "_own"))).otherwise(F.array("macro_area"))
    rows = rows.join(own, "series_name").withColumn("area", F.explode(takes))
    end = rows.agg(F.max(_month(F.col("available_date"))).alias("_end"))  # one row
    rows = rows.join(F.broadcast(end)).withColumn("month", F.explode(F.sequence(_month(F.col("available_date")), F.coalesce(_month(F.col("until")), F.col("_end")))))
    return rows.select("series_name", "area", "month", "available_date", "until", *VALUES, "_end")


def macro_on_tokens(tokens: DataFrame, states: DataFrame) -> DataFrame:
    """Tokens (with a date) times series, with the state known at that date. An area without any state of a series takes
    the GLOBAL ones; an area with states that are all still unknown gets nulls.

    States are looked up once for each date and area, of which there are as many as the calendar and the map of areas give,
    and joined to the tokens by these.
    """
    return tokens.join(states_at(tokens.select("date", "macro_area").distinct(), states), ["date", "macro_area"]).select(*tokens.columns, "series_name", "available_date", *VALUES)


def states_at(tokens: DataFrame, states: DataFrame) -> DataFrame:
    """macro_on_tokens() row by row. States are few: as intervals by month they are sent to all tasks, and no row is shuffled.
    Where they are more than MOST_INTERVALS, the as-of join sorts both sides by series, area and time instead."""
    series = states.select("series_name").distinct()  # one row a series
    intervals = state_intervals(states)
    if intervals.limit(MOST_INTERVALS + 1).count() > MOST_INTERVALS:
        held = states.select("series_name", "macro_area").distinct().withColumn("_own", F.lit(True))
        rows = tokens.join(F.broadcast(series)).join(held, ["series_name", "macro_area"], "left")
        rows = rows.withColumn("_area", F.when(F.col("_own"), F.col("macro_area")).otherwise("GLOBAL")).drop("_own")
        payload = states.select(F.col("macro_area").alias("_area"), "series_name", "available_date", *VALUES)
        return asof_join(rows, payload, ["series_name", "_area"], "date", "available_date", allow_exact=True).drop("_area")
    ends = intervals.agg(F.max("_end").alias("_last"))  # one row
    rows = tokens.join(F.broadcast(series)).join(F.broadcast(ends)).withColumn("_m", F.least(_month(F.col("date")), F.col("_last")))
    known = intervals.select(F.col("series_name").alias("_s"), F.col("area").alias("_a"), F.col("month").alias("_k"), "available_date", "until", *VALUES)
    on = (F.col("series_name") == F.col("_s")) & (F.col("macro_area") == F.col("_a")) & (F.col("_m") == F.col("_k")) & (F.col("date") >= F.col("available_date")) & (F.col("until").isNull() | (F.col("date") < F.col("until")))
    return rows.join(F.broadcast(known), on, "left").select(*tokens.columns, "series_name", "available_date", *VALUES)


def macro_interactions(with_states: DataFrame, keys: list[str]) -> DataFrame:
    """Share-weighted sums by firm-month and series; missing values add nothing, so all missing gives zero."""
    weighted = lambda c: F.coalesce(F.sum(F.col("revenue_share") * F.col(c)), F.lit(0.0)).alias(f"segment_macro_{c}")
    return with_states.groupBy(*keys, "series_name").agg(
        *(weighted(c) for c in VALUES), F.count("*").alias("macro_token_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("revenue_share"))), F.lit(0.0)).alias("revenue_share_covered"),
    )


def macro_tensor(panel: DataFrame, tokens: DataFrame, states: DataFrame, series: list[str] | None = None) -> DataFrame:
    """`panel` with macro_token_rows, macro_geo_count, macro_area_count, three columns segment_macro_* a series, and
    macro_revenue_share_covered, the share of labels with any value. Firm-months without tokens keep nulls; missing values
    of one with tokens add nothing.

    series: names of the columns' series; all of the states' by default, read to the driver as they make the schema.
    Coverage counts every series. A row takes the tokens of its own snapshot.
    """
    keys, snapshot = ["gvkey", "permno", "date"], ["gvkey", "segment_srcdate"]
    names = series if series is not None else sorted(r["series_name"] for r in states.select("series_name").distinct().collect())
    columns = [(n, c, f"segment_macro_{n}{c.removeprefix('value')}") for n in names for c in VALUES]
    some = F.greatest(*(F.col(c).isNotNull() for c in VALUES))
    # one row a date, its areas' series side by side; one array a snapshot; each row of the panel meets one of either
    tokens = tokens.where("macro_area IS NOT NULL").select(*snapshot, F.struct("geo_label", "macro_area", "revenue_share").alias("_token"))
    grid = panel.select("date").distinct().join(tokens.select("_token.macro_area").distinct())
    known = states_at(grid, states).groupBy("date", "macro_area").agg(F.max(some).alias("_some"), *(F.max(F.when(F.col("series_name") == n, F.col(c))).alias(a) for n, c, a in columns))
    known = known.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("macro_area", F.struct("_some", *(a for _, _, a in columns))))).alias("_known"))
    sets = tokens.groupBy(*snapshot).agg(F.collect_list("_token").alias("_tokens"))
    rows = panel.join(sets, snapshot, "left").join(F.broadcast(known), "date", "left")
    of = lambda t, c: F.col("_known")[t["macro_area"]][c]
    total = lambda f: F.aggregate("_tokens", F.lit(0.0), lambda s, t: s + F.coalesce(f(t).cast("double"), F.lit(0.0)))
    different = lambda c: F.size(F.array_compact(F.array_distinct(F.transform("_tokens", lambda t: t[c])))).cast("long")
    made = {
        "macro_token_rows": F.size("_tokens").cast("long"), "macro_geo_count": different("geo_label"), "macro_area_count": different("macro_area"),
        **{a: total(lambda t, a=a: t["revenue_share"] * of(t, a)) for _, _, a in columns}, "macro_revenue_share_covered": total(lambda t: F.when(of(t, "_some"), t["revenue_share"])),
    }
    found = F.col("_tokens").isNotNull() & F.col("_known").isNotNull()
    return rows.select(*keys, *(c for c in panel.columns if c not in keys), *(F.when(found, c).alias(k) for k, c in made.items()))


def coverage(tensor: DataFrame) -> DataFrame:
    """One row of counts and rates of a tensor panel."""
    has = F.col("macro_token_rows").isNotNull()
    return tensor.agg(
        F.count("*").alias("panel_rows"), F.count("macro_token_rows").alias("firm_month_rows"), F.sum("macro_token_rows").alias("token_rows"),
        F.avg(F.when(has, (F.col("macro_revenue_share_covered") > 0).cast("double"))).alias("macro_coverage_rate"), F.avg("macro_revenue_share_covered").alias("mean_macro_revenue_share_covered"),
        F.try_divide(F.count("macro_token_rows"), F.count("*")).alias("joined_token_match_rate"),
    )
