"""Answers of four public statistics services, saved as JSON text, as one table of observations with availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import month_end, period_to_date

#: Schema and path of the observations in each service's answer.
ANSWERS = {
    "FRED": ("observations array<struct<date:string,value:string,realtime_start:string,realtime_end:string>>", "observations"),
    "BLS": ("Results struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,value:string>>>>>", "flatten(transform(a.Results.series, s -> s.data))"),
    "BEA": ("BEAAPI struct<Results:struct<Data:array<struct<TimePeriod:string,DataValue:string>>>>", "a.BEAAPI.Results.Data"),
    "EIA": ("response struct<data:array<struct<period:string,value:string>>>", "a.response.data"),
}


def observations(answers: DataFrame, source: str) -> DataFrame:
    """(series_id, macro_area, date, value, realtime_start, realtime_end) from answers (series_id, macro_area, body).
    Annual averages (period M13) and rows without a date or a number go; thousands commas are stripped."""
    schema, path = ANSWERS[source]
    rows = answers.select("series_id", "macro_area", F.from_json("body", schema).alias("a")).select("series_id", "macro_area", F.explode(F.expr(path if path.startswith(("a.", "flatten")) else f"a.{path}")).alias("o"))
    none = F.lit(None).cast("string")
    period, year, value = {"FRED": ("date", None, "value"), "BLS": ("period", "year", "value"), "BEA": ("TimePeriod", None, "DataValue"), "EIA": ("period", None, "value")}[source]
    real = (F.col("o.realtime_start"), F.col("o.realtime_end")) if source == "FRED" else (none, none)
    rows = rows.select(
        "series_id", "macro_area", F.lit(source).alias("source"), period_to_date(F.col(f"o.{period}"), F.col(f"o.{year}").try_cast("int") if year else F.lit(None).cast("int")).alias("date"),
        F.regexp_replace(F.col(f"o.{value}"), ",", "").try_cast("double").alias("value"), *(F.try_to_date(x).alias(n) for x, n in zip(real, ("realtime_start", "realtime_end"), strict=True)),
    )
    return rows.where("date IS NOT NULL AND value IS NOT NULL")


def available(rows: DataFrame, lag_days: Column | int, *, realtime: bool = False) -> DataFrame:
    """The day a value was public: with `realtime`, its vintage's first day; else its month's end plus the lag."""
    lagged = F.date_add(month_end(F.col("date")), lag_days)
    day = F.coalesce("realtime_start", lagged) if realtime else lagged
    return rows.withColumn("available_date", day).withColumn("timing_source", F.when(F.col("realtime_start").isNotNull() if realtime else F.lit(False), "realtime_start").otherwise("configured_lag"))
