"""What a database holds: probes of its tables, the choice of a table for each role, and the catalog of macro series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_end


def list_columns(spark: SparkSession, databases: list[str]) -> DataFrame:
    """(library, table, column, kind, place) of all tables of the databases."""
    rows = [(d, t.name, c.name, c.dataType, i) for d in databases for t in spark.catalog.listTables(d) for i, c in enumerate(spark.catalog.listColumns(t.name, d))]
    return spark.createDataFrame(rows, "library string, table string, column string, kind string, place int")


def date_range(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, first and last date."""
    day = F.col(column).try_cast("date")
    return df.agg(F.count("*").alias("rows"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


@dataclass(frozen=True)
class Role:
    """A table that is looked for: terms of its library and name, preferred names, groups of columns of which it needs one
    each, and date columns in order of choice."""

    name: str
    library_terms: tuple[str, ...]
    table_terms: tuple[str, ...]
    preferred: tuple[str, ...]
    needs: tuple[tuple[str, ...], ...]
    dates: tuple[str, ...] = ()


#: Scores of an equal preferred name, of one contained, of a table term, a library term and a group of columns;
#: and the date columns that any table may have, in order of choice.
EQUAL, CONTAINED, TABLE_TERM, LIBRARY_TERM, GROUP = 100, 45, 10, 8, 30
DATES = ("date", "datadate", "caldt", "fyear", "yyyymm")


def _sum(values: list[Column]) -> Column:
    return sum(values[1:], values[0]) if values else F.lit(0)


def resolve_roles(columns: DataFrame, roles: list[Role], inspected: int = 8) -> DataFrame:
    """(role, library, table, score, date_column): the best table of each role.

    Names score first: an equal preferred name 100 less its place, else one contained 45 less its place, 10 a table term, 8 a
    library term. Of the `inspected` best by name the columns score 30 for each group that has one. Ties go to the first
    library and table.
    """
    tables = columns.groupBy("library", "table").agg(F.collect_set(F.lower("column")).alias("names"))
    name, library = F.lower("table"), F.lower("library")
    parts = []
    for r in roles:
        liked = [F.when(name == p, EQUAL - i).when(F.contains(name, F.lit(p)), CONTAINED - i).otherwise(0) for i, p in enumerate(r.preferred)]
        terms = [F.when(F.contains(name, F.lit(t)), TABLE_TERM).otherwise(0) for t in r.table_terms] + [F.when(F.contains(library, F.lit(t)), LIBRARY_TERM).otherwise(0) for t in r.library_terms]
        has = [F.when(F.arrays_overlap("names", F.array(*map(F.lit, g))), GROUP).otherwise(0) for g in r.needs]
        day = F.coalesce(*(F.when(F.array_contains("names", c), F.lit(c)) for c in (*r.dates, *DATES)))
        parts.append(tables.select(F.lit(r.name).alias("role"), "library", "table", _sum(liked + terms).alias("by_name"), _sum(has).alias("by_columns"), day.alias("date_column")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = Window.partitionBy("role").orderBy(F.desc("by_name"), "library", "table")
    rows = rows.where("by_name > 0").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= inspected)
    score = F.col("by_name") + F.col("by_columns")
    best = Window.partitionBy("role").orderBy(F.desc("score"), "library", "table")
    rows = rows.withColumn("score", score).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return rows.select("role", "library", "table", "score", "date_column")


#: Services that are read, and the timings whose values carry the day on which they were published.
SERVICES = ("fred", "bls", "bea", "eia")
PUBLISHED = ("fred_initial_release", "fred_vintage_all", "fred_vintage_changes")
SERIES_SCHEMA = "source string, series_id string, series_name string, macro_area string, release_lag_days int, frequency string, timing string, revision_safe boolean"


def series_catalog(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The configured series as a table, with defaults. An entry without an id or of another service is an error."""
    rows = []
    for e in entries:
        source, key = str(e.get("source", "fred")).strip().lower(), str(e.get("series_id", "")).strip().upper()
        if not key or source not in SERVICES:
            raise ValueError(f"series {key!r} of {source!r}: an id and one of {SERVICES} are needed")
        timing = str(e.get("timing", "configured_release_lag")).strip().lower()
        safe = bool(e.get("revision_safe", source == "fred" and timing in PUBLISHED))
        rows.append((source, key, str(e.get("series_name") or key.lower()).strip(), str(e.get("macro_area", "GLOBAL")).strip().upper(), int(e.get("release_lag_days", 0)), str(e.get("frequency", "monthly")).strip().lower(), timing, safe))
    return spark.createDataFrame(rows, SERIES_SCHEMA)


def standard_frame(observations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Observations (series_id, date, value, realtime_start, realtime_end) with their series' names and availability: the day
    of publication where the timing has it, if the series has any; else the month end plus the series' lag."""
    rows = observations.select(F.upper("series_id").alias("series_id"), F.col("date").try_cast("date").alias("date"), F.col("value").try_cast("double").alias("value"), F.col("realtime_start").try_cast("date").alias("realtime_start"), F.col("realtime_end").try_cast("date").alias("realtime_end"))
    dated = rows.groupBy("series_id").agg((F.count("realtime_start") > 0).alias("_dated"))  # one row a series
    rows = rows.join(F.broadcast(catalog), "series_id").join(F.broadcast(dated), "series_id")
    published = F.col("_dated") & F.col("timing").isin(*PUBLISHED)
    return rows.select(
        "source", "series_id", "series_name", "macro_area", "date", F.when(published, F.col("realtime_start")).otherwise(F.date_add(month_end(F.col("date")), F.col("release_lag_days"))).alias("available_date"), "value",
        "realtime_start", "realtime_end", F.col("timing").alias("timing_source"), F.lit(True).alias("lookahead_safe"), (published | F.col("revision_safe")).alias("revision_safe"),
    )
