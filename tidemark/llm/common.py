"""Shared pieces of the training-data operators: word patterns, ASCII case, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Unset, it is a temporary one in local mode and an error on
    a cluster, where each machine would write to its own disk."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str, *, bucket_by: str | None = None, buckets: int = 1) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it again.

    The files outlive the executors that wrote them, and the size of the table becomes known to the planner. With
    `bucket_by` the planner also knows that rows of equal values are together and does not shuffle them for that column.
    """
    spark, name = df.sparkSession, f"tidemark_{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{name}"
    if bucket_by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.write.bucketBy(buckets, bucket_by).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
