"""Sinks: tables that appear whole or not at all, small JSON and CSV files, and loads that keep what they got before an error."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write `df` as Parquet and read it again. Spark's commit makes the files visible together."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, *, parts: bool = False) -> None:
    """A small table as one CSV file with a header, in the folder `path`; with parts, a table of any size as one such file a
    task, none of which holds the whole."""
    (df if parts else df.coalesce(1)).write.mode("overwrite").csv(path, header=True)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON value as one text file in the folder `path`, through Spark's writer, so any store will do."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_series(names: Iterable[str], load: Callable[[str], DataFrame], path: str) -> dict:
    """Load each series and write all as one table. At the first error the series so far are written beside it as
    `<path>.partial`. Returns status (ok or api_error), rows, series_attempted, series_completed, partial and the error."""
    names = list(names)
    frames: list[DataFrame] = []
    for name in names:
        try:
            frames.append(load(name))
        except Exception as error:  # noqa: BLE001  whatever a service may raise is the status
            rows = write_table(reduce(DataFrame.unionByName, frames), f"{path}.partial").count() if frames else 0
            return {"status": "api_error", "rows": rows, "series_attempted": len(frames) + 1, "series_completed": len(frames), "partial": bool(frames), "error": f"{name}: {error}"}
    rows = write_table(reduce(DataFrame.unionByName, frames), path).count() if frames else 0
    return {"status": "ok", "rows": rows, "series_attempted": len(names), "series_completed": len(names), "partial": False, "error": None}


def table_inventory(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(family, table, sample_columns) of the CSV files in each family's folder, by their header lines. The part files that
    Spark writes into one folder are one table, by the folder's name."""
    def one(family: str, folder: str) -> DataFrame:
        name, above = F.col("_metadata.file_name"), F.element_at(F.split("_metadata.file_path", "/"), -2)
        lines = spark.read.text(f"{folder}/*.csv").select(F.when(name.rlike("^part-[0-9]+-"), above).otherwise(name).alias("table"), F.col("_metadata.file_block_start").alias("at"), "value")
        head = lines.where("at = 0").groupBy("table").agg(F.first("value").alias("sample_columns"))
        return head.select(F.lit(family).alias("family"), "table", "sample_columns")

    return reduce(DataFrame.unionByName, (one(k, v) for k, v in folders.items()))
