"""Counts and ranges of Parquet tables from their files' footers, without reading a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of columns whose least and largest values Spark takes from footers.
RANGED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date")


def footer_plan(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """One row (rows, low, high), aggregated by the scan itself. It belongs to a session of its own, whose settings make
    Spark's newer reader push counts and ranges down to footers; the caller's settings stay as they are."""
    own = spark.newSession()
    for key, value in {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}.items():
        own.conf.set(key, value)
    df = own.read.parquet(path)
    if column is not None and dict(df.dtypes)[column] not in RANGED:
        raise ValueError(f"{column} has no range in footers")
    ends = [F.min(column).alias("low"), F.max(column).alias("high")] if column else []
    return df.agg(F.count("*").alias("rows"), *ends)


def table_estimates(spark: SparkSession, tables: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(table, column, rows, low, high) of tables by name: their path and a column whose range is asked for, or none; low and
    high as text. A table costs one job over its footers and one row."""
    out = []
    for name, (path, column) in tables.items():
        r = footer_plan(spark, path, column).first()
        text = lambda k: None if column is None or r[k] is None else str(r[k])  # noqa: E731, B023
        out.append((name, column, r["rows"], text("low"), text("high")))
    return spark.createDataFrame(out, "table string, column string, rows long, low string, high string")
