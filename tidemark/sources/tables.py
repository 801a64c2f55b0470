"""Yearly shards, tagged tables, extraction queries, and the readers and writers around them."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stored import matches, move, remove


def year_list(text: str) -> list[int]:
    """"2006,2008-2010" as sorted years, each once."""
    parts = [p.split("-") for p in text.replace(" ", "").split(",") if p]
    return sorted({y for p in parts for y in range(int(p[0]), int(p[-1]) + 1)})


def read_shards(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """All year=*/<dataset>.parquet under root, with the year as a column; an error if there is none."""
    return spark.read.option("basePath", root).option("mergeSchema", "true").parquet(f"{root}/year=*/{dataset}.parquet")


def read_optional_shards(spark: SparkSession, root: str, dataset: str) -> DataFrame | None:
    """The same, or None if there is no such shard."""
    try:
        return read_shards(spark, root, dataset)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_shards(df: DataFrame, root: str, dataset: str) -> list[str]:
    """Write the years of `df` that `root` lacks as year=*/<dataset>.parquet and return their folders' names.

    One job writes all of them to a hidden folder, from which each is moved when all are whole; a second call writes only
    what is still missing. Rows without a year have a shard of their own. An empty table writes nothing.
    """
    spark, name = df.sparkSession, lambda path: path.rstrip("/").rsplit("/", 1)[-1]
    done = [name(p[: p.rindex("/")]).removeprefix("year=") for p in matches(spark, f"{root}/year=*/{dataset}.parquet")]
    tag = F.coalesce(F.col("year").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    hidden = f"{root}/_{dataset}_{uuid.uuid4().hex}"
    df.where(~tag.isin(done)).repartition("year").write.partitionBy("year").parquet(hidden)
    new = [name(p) for p in matches(spark, f"{hidden}/year=*")]
    for folder in new:
        move(spark, f"{hidden}/{folder}", f"{root}/{folder}/{dataset}.parquet")
    remove(spark, hidden)
    return new


def read_csv(spark: SparkSession, path: str, schema: StructType | str, *, optional: bool = False) -> DataFrame:
    """A CSV table with a header. Where `optional`, a missing file is an empty table."""
    try:
        return spark.read.csv(path, schema=schema, header=True)
    except AnalysisException as error:
        if not optional or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: Model families whose predictions are read, and what their file names begin with.
FAMILIES = ("lgbm", "deepsets")


def read_predictions(spark: SparkSession, paths: list[str], family: str, run_id: str, target: str = "target") -> DataFrame:
    """Model predictions, with the variant from names such as lgbm_all_predictions.parquet (file or folder) and the run.
    Numbers are read leniently; rows that lack a date, permno, prediction or target go."""
    if family not in FAMILIES:
        raise ValueError(f"unknown model family {family!r}")
    if not run_id:
        raise ValueError("predictions need the id of their run")
    rows = spark.read.parquet(*paths).withColumn("variant", F.regexp_extract(F.input_file_name(), rf"{family}_([^/]+)_predictions\.parquet", 1))
    if missing := {"date", "permno", "prediction", target} - set(rows.columns):
        raise ValueError(f"predictions lack {sorted(missing)}")
    rows = rows.withColumns({"date": F.col("date").try_cast("date"), "permno": F.col("permno").try_cast("long"), "prediction": F.col("prediction").try_cast("double"), target: F.col(target).try_cast("double")})
    return rows.dropna(subset=["date", "permno", "prediction", target]).withColumn("model_family", F.lit(family)).withColumn("model_run_id", F.lit(run_id))


def union_tagged(tables: dict[str, DataFrame], tag: str = "model_run_id") -> DataFrame:
    """All rows by column name, columns that a table lacks null, with the table's name in `tag`."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.withColumn(tag, F.lit(k)) for k, t in tables.items()))


def write_missing_years(df: DataFrame, path: str, years: Iterable[int]) -> list[int]:
    """Write the years that `path` does not have yet, one folder each; returns them. A second call writes nothing."""
    try:
        done = {r["year"] for r in df.sparkSession.read.parquet(path).select("year").distinct().collect()}  # one row a year
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        done = set()
    todo = sorted(set(years) - done)
    if todo:
        df.where(F.col("year").isin(todo)).write.mode("append").partitionBy("year").parquet(path)
    return todo


def table_info(df: DataFrame) -> DataFrame:
    """One row: rows, columns, files and bytes of a table of files."""
    meta = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f").agg(F.count("*").alias("n"), F.first("b").alias("b"))
    return meta.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.count("*").alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))


def read_jdbc(spark: SparkSession, url: str, query: str, *, timeout_ms: int = 600_000, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, sessionInitStatement=f"SET statement_timeout = {int(timeout_ms)}", **options).load()


def query_hash(sql: str) -> str:
    from hashlib import sha256

    return sha256(sql.encode()).hexdigest()[:16]


#: The annual reports of industrial firms, standard format, domestic, consolidated.
REPORTS = "datadate BETWEEN add_months(trunc(:first, 'YEAR'), -24) AND :last AND indfmt = 'INDL' AND datafmt = 'STD' AND popsrc = 'D' AND consol = 'C'"
#: What is read of each source table from `first` to `last` (dates of one year), by the columns' names there.
#: Monthly returns, links and factors reach into the next quarter, so the last months have a return ahead.
EXTRACTS = {
    "segments": """SELECT g.gvkey, g.stype, g.sid, g.gareag, g.gareat, g.srcdate, v.datadate, v.sales, v.revts, v.ias
FROM {geo} g JOIN {amounts} v ON g.gvkey = v.gvkey AND g.stype = v.stype AND g.sid = v.sid AND g.srcdate = v.srcdate
WHERE g.srcdate BETWEEN :first AND :last AND coalesce(v.sales, v.revts, v.ias) IS NOT NULL""",
    "returns": """SELECT permno, permco, siccd, yyyymm, mthcaldt AS date, mthret AS ret, mthretx AS retx, mthprc AS prc, mthcap AS mktcap, mthvol AS vol,
cusip, ticker, sharetype, securitytype, securitysubtype, usincflg FROM {returns} WHERE mthcaldt BETWEEN :first AND last_day(add_months(:last, 3))""",
    "daily": "SELECT permno, dlycaldt AS date, dlyret AS ret, dlyretx AS retx, dlyprc AS prc, dlycap AS mktcap, dlyvol AS vol FROM {daily} WHERE dlycaldt BETWEEN :first AND :last",
    "funda": f"SELECT gvkey, datadate, fyear, fyr, tic, conm, fdate, pdate, at, sale, revt, ceq, ni, capx, xrd, dltt, dlc, prcc_f, csho FROM {{funda}} WHERE {REPORTS}",
    "filings": f"SELECT gvkey, datadate, fyear, fyr, fdate, pdate FROM {{funda}} WHERE {REPORTS}",
    "links": """SELECT gvkey, lpermno AS permno, lpermco AS permco, linkdt, linkenddt, linktype, linkprim, usedflag FROM {links}
WHERE linkdt <= last_day(add_months(:last, 3)) AND (linkenddt IS NULL OR linkenddt >= :first) AND linktype IN ('LU', 'LC') AND linkprim IN ('P', 'C')""",
    "factors": "SELECT * FROM {factors} WHERE date BETWEEN :first AND last_day(add_months(:last, 3))",
}


def extract(spark: SparkSession, name: str, first, last, **tables: DataFrame) -> DataFrame:  # noqa: ANN001
    return spark.sql(EXTRACTS[name], args={"first": first, "last": last}, **tables)


def smoke_extract(spark: SparkSession, first, last, rows: int, **tables: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    """(segments with an area, links, returns) of a short trial: at most `rows` segment rows, and of the other tables only
    their firms and permnos. The limit is the feature; without a segment the others are empty."""
    segments = extract(spark, "segments", first, last, geo=tables["geo"], amounts=tables["amounts"]).where("gareat IS NOT NULL").limit(rows)
    links = extract(spark, "links", first, last, links=tables["links"]).join(segments.select("gvkey").distinct(), "gvkey", "left_semi")
    returns = extract(spark, "returns", first, last, returns=tables["returns"]).join(links.select("permno").distinct(), "permno", "left_semi")
    return segments, links, returns
