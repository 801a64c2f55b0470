"""Intermediate tables in the folder that all executors share: written once, read by every plan that needs them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple[str, str, str], str] = {}
#: Folders of stored() tables that were written while each kept() table, the innermost last, was built.
_USED: list[list[str]] = []
#: Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Unset, it is a temporary folder in local mode, deleted at the end, and an error on a cluster,
    where each machine would write to its own disk."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def matches(spark: SparkSession, pattern: str) -> list[str]:
    """The files and folders that a path with * stands for, sorted."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().toString() for f in found or [])


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder of any file system that Spark reaches, after making the folders above `target`."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(target).getParent())
    if not files.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside leaves no shuffle files, so those of a table's steps do not add up on the disks."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _write(df: DataFrame, path: str, by: str | None = None) -> None:
    with _shuffles_deleted(df.sparkSession):
        writer = df.write.option("compression", "zstd")
        (writer if by is None else writer.partitionBy(by)).parquet(path)


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Cut the lineage: write `df` as Parquet and read it again; with `by`, in one folder a value, so a filter on it reads
    its files only. Its folder goes when the kept() table that it is a step of is written; otherwise the caller may remove()
    its inputFiles' folder when no plan reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark_{label}_{uuid.uuid4().hex}"
    _write(df, path, by)
    if _USED:
        _USED[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` of an input folder, built and written by the first plan of this session that asks for it and read by
    all others. The folder's tables must not change meanwhile; forget() drops what was kept."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _KEPT:
        try:
            return spark.read.parquet(_KEPT[key])
        except AnalysisException as error:  # someone cleared the folder
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    path = f"{shared_dir(spark)}/tidemark_kept_{name}_{uuid.uuid4().hex}"
    _USED.append([])
    try:
        _write(build(), path)
    finally:
        for used in _USED.pop():
            remove(spark, used)
    _KEPT[key] = path
    return spark.read.parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete all tables that this session kept."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        remove(spark, _KEPT.pop(key))
