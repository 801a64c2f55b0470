"""Exposure snapshots and the monthly panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import geo_label, is_domestic, macro_area, stepped
from ..sources.stored import stored
from .asof import asof_joins, interval_join, join_same, keep_one


def clean_segments(segments: DataFrame) -> DataFrame:
    """Rows with positive sales (sales, else revts, else ias), a source date, and one label."""
    sales = F.coalesce(*(F.col(c).try_cast("double") for c in ("sales", "revts", "ias")))
    rows = segments.select("gvkey", "sid", "srcdate", "datadate", geo_label(F.col("gareag"), F.col("gareat")).alias("geo_label"), sales.alias("sales"))
    return rows.where("sales > 0 AND srcdate IS NOT NULL")


def snapshots(segments: DataFrame) -> DataFrame:
    """One row per firm and source date: shares of labels, their concentration, and sums. Rows without a label count as
    foreign but not as a label."""
    key = ["gvkey", "srcdate"]
    # dealt by snapshot once; both groupings then stay in place
    geo = clean_segments(segments).repartition(*key).groupBy(*key, "geo_label").agg(F.sum("sales").alias("s"), F.count("sid").alias("n"), F.max("datadate").alias("datadate"))
    geo = geo.withColumn("home", is_domestic(F.col("geo_label")))
    part = lambda when: F.coalesce(F.try_divide(F.sum(F.when(when, F.col("s"))), F.sum("s")), F.lit(0.0))
    return geo.groupBy(*key).agg(
        F.max("datadate").alias("segment_datadate"), F.sum("s").alias("segment_sales_sum"), F.count("geo_label").alias("geo_count"),
        part(~F.col("home")).alias("foreign_share"), part(F.col("home")).alias("domestic_share"),
        F.coalesce(F.try_divide(F.sum(F.pow("s", F.lit(2.0))), F.pow(F.sum("s"), F.lit(2.0))), F.lit(0.0)).alias("geo_hhi"),
        F.try_divide(F.max("s"), F.sum("s")).alias("top_geo_share"), F.sum("n").alias("segment_rows"),
    ).withColumnRenamed("srcdate", "segment_srcdate")


def _present(df: DataFrame, column: str, kind: str = "date") -> Column:
    """The column as `kind` where the table has it, else null; what does not parse is null."""
    return F.col(column).try_cast(kind) if column in df.columns else F.lit(None).cast(kind)


def _last_shard(df: DataFrame, *keys: str) -> list[Column]:
    """An order in which the row of the latest yearly shard comes first; other columns, largest first, break ties."""
    rest = [c for c in df.columns if c not in (*keys, "year")]
    return [*([F.desc_nulls_last("year")] if "year" in df.columns else []), *(F.desc_nulls_last(c) for c in sorted(rest))]


def prepared_filings(filings: DataFrame) -> DataFrame:
    """The earliest filing of each firm and fiscal date, with the column that its date is from: pdate, else fdate; unless the
    table names filing_date and filing_date_source itself. Filings without a date come last."""
    pdate, fdate = _present(filings, "pdate"), _present(filings, "fdate")
    own_date, own_source = "filing_date" in filings.columns, "filing_date_source" in filings.columns
    rows = filings.select(
        F.col("gvkey").cast("string").alias("gvkey"), F.col("datadate").try_cast("date").alias("datadate"),
        (F.col("filing_date").try_cast("date") if own_date else F.coalesce(pdate, fdate)).alias("filing_date"),
        (F.col("filing_date_source") if own_source else F.when(pdate.isNotNull(), "pdate").when(fdate.isNotNull(), "fdate").otherwise("missing")).alias("filing_date_source"),
    )
    return keep_one(rows.where("datadate IS NOT NULL"), ["gvkey", "datadate"], [F.asc_nulls_last("filing_date"), F.asc_nulls_last("filing_date_source")])


def activation_dates(snaps: DataFrame, filings: DataFrame | None, lag_days: int = 1) -> DataFrame:
    """The day from which a snapshot may be used: filing date, else source date, plus the lag; and which it was."""
    if filings is None:
        found = snaps.withColumns({"filing_date": F.lit(None).cast("date"), "filing_date_source": F.lit("missing")})
    else:
        found = snaps.join(prepared_filings(filings).withColumnRenamed("datadate", "segment_datadate"), ["gvkey", "segment_datadate"], "left")
    return found.select(
        *snaps.columns, F.date_add(F.coalesce("filing_date", "segment_srcdate"), lag_days).alias("segment_activation_date"),
        F.when(F.col("filing_date").isNotNull(), F.col("filing_date_source")).otherwise("srcdate_fallback").alias("activation_source"),
    )


def prepared_returns(returns: DataFrame) -> DataFrame:
    """Numbers as numbers, and of the rows of one permno and date that of the latest shard, dealt by permno."""
    numbers = {c: F.col(c).try_cast("double") for c in ("ret", "retx", "prc", "mktcap", "vol") if c in returns.columns}
    rows = returns.withColumns({"date": F.col("date").try_cast("date"), "permno": F.col("permno").try_cast("long"), **numbers}).where("date IS NOT NULL AND permno IS NOT NULL")
    return keep_one(rows.repartition("permno"), ["permno", "date"], _last_shard(rows, "permno", "date")).drop("year")


def prepared_links(links: DataFrame) -> DataFrame:
    """Each link once; an open end is far in the future."""
    rows = links.withColumns({"gvkey": F.col("gvkey").cast("string"), "permno": F.col("permno").try_cast("long"), "linkdt": F.col("linkdt").try_cast("date")})
    rows = rows.withColumn("linkenddt", F.coalesce(F.col("linkenddt").try_cast("date"), F.lit("2100-01-01").cast("date")))
    return rows.where("permno IS NOT NULL AND linkdt IS NOT NULL").dropDuplicates(["gvkey", "permno", "linkdt", "linkenddt", "linktype", "linkprim"])


def linked_returns(returns: DataFrame, links: DataFrame, *more: str) -> DataFrame:
    """Returns with the firm of the best link valid on their date: largest linkprim, then linktype, then linkdt; with `more` of
    the links' columns. Dealt by permno."""
    returns, links = prepared_returns(returns), prepared_links(links)
    found = interval_join(returns, links.select("gvkey", "permno", "linkdt", "linkenddt", "linktype", "linkprim", *more), ["permno"], "date", "linkdt", "linkenddt")
    best = keep_one(found, ["permno", "date"], [F.desc_nulls_last(c) for c in ("linkprim", "linktype", "linkdt", "gvkey")])
    return best.select("gvkey", *returns.columns, *more)


def available_fundamentals(funda: DataFrame) -> DataFrame:
    """Public date of each report: pdate, else fdate, else six months after the fiscal date; and which it was. Of a firm's
    reports that became public on one day, that of the latest fiscal date and then of the latest shard stays."""
    pdate, fdate = _present(funda, "pdate"), _present(funda, "fdate")
    numbers = {c: F.col(c).try_cast("double") for c in ("at", "sale", "revt", "ceq", "ni", "capx", "xrd", "dltt", "dlc", "prcc_f", "csho") if c in funda.columns}
    rows = funda.withColumns({"gvkey": F.col("gvkey").cast("string"), "datadate": F.col("datadate").try_cast("date"), **numbers}).where("datadate IS NOT NULL")
    rows = rows.withColumns({
        "funda_avail_date": F.coalesce(pdate, fdate, F.add_months("datadate", 6)),
        "funda_avail_source": F.when(pdate.isNotNull(), "pdate").when(fdate.isNotNull(), "fdate").otherwise("fallback_6m"),
    })
    return keep_one(rows, ["gvkey", "funda_avail_date"], [F.desc("datadate"), *_last_shard(rows, "gvkey", "funda_avail_date", "datadate")]).drop("year")


def scaled_factors(factors: DataFrame, columns: tuple[str, ...] = ("mktrf", "smb", "hml", "umd", "rf")) -> DataFrame:
    """One row a month, of the latest shard. Columns with any value beyond 1 are in percent and divided by 100 as a whole;
    the decision is one row, joined to all. The month is dateff, or the month end of date where there is none."""
    columns = tuple(c for c in columns if c in factors.columns)
    number = lambda c: F.col(c).try_cast("double")
    top = factors.agg(*(F.max(F.abs(number(c))).alias(f"_{c}") for c in columns))
    day = F.col("dateff").try_cast("date") if "dateff" in factors.columns else F.last_day(F.col("date").try_cast("date"))
    rows = factors.join(F.broadcast(top))  # one row
    rows = rows.select(day.alias("factor_date"), *(F.when(F.col(f"_{c}") > 1, number(c) / 100).otherwise(number(c)).alias(c) for c in columns), *(["year"] if "year" in factors.columns else []))
    return keep_one(rows, ["factor_date"], _last_shard(rows, "factor_date")).drop("year")


def exposed_returns(returns: DataFrame, links: DataFrame, active: DataFrame, factors: DataFrame) -> DataFrame:
    """Linked returns of the months after the firm's first activation, with the next such row's return, plain and in excess.
    Rows stay dealt by permno: the firm's first activation comes with its links. factors: from scaled_factors()."""
    first = active.groupBy("gvkey").agg(F.min("segment_activation_date").alias("_first"))
    rows = linked_returns(returns, join_same(prepared_links(links), first, ["gvkey"], "left"), "_first").where(F.col("date") > F.col("_first")).drop("_first")
    free = F.broadcast(factors.select("factor_date", F.col("rf").alias("_rf")))  # one row a month
    rows = rows.join(free, F.col("date") == F.col("factor_date"), "left").drop("factor_date")
    ahead = Window.partitionBy("permno").orderBy("date")
    return rows.withColumns({"next_month_ret": F.lead("ret").over(ahead), "next_month_excess_ret": F.lead(F.col("ret") - F.col("_rf")).over(ahead)}).drop("_rf")


def monthly_panel(returns: DataFrame, links: DataFrame, active: DataFrame, funda: DataFrame, factors: DataFrame) -> DataFrame:
    """Firm-months with the exposure and fundamentals known strictly before, factors, and the next row's return.

    Returns are dealt by permno, then by firm, before snapshots and reports come to them; wide rows are not dealt. The first
    half is stored, so that its shuffle files are gone in the second."""
    factors = stored(scaled_factors(factors), "factors")
    rows = stored(exposed_returns(returns, links, active, factors), "exposed_returns")
    reports = stored(available_fundamentals(funda).drop("pdate", "fdate", "year").withColumnRenamed("datadate", "funda_datadate"), "reports")
    known = asof_joins(rows, [(active, "segment_activation_date", ["segment_srcdate"]), (reports, "funda_avail_date", ["funda_datadate"])], ["gvkey"], "date")
    known = known.join(F.broadcast(factors), F.col("date") == F.col("factor_date"), "left").drop("factor_date").withColumn("excess_ret", F.col("ret") - F.col("rf"))
    ahead = ["next_month_ret", "next_month_excess_ret"]
    return known.select(*(c for c in known.columns if c not in ahead), *ahead)


def geo_tokens(segments: DataFrame) -> DataFrame:
    """One row per firm, source date and label, null labels as UNKNOWN, with its share of the snapshot and macro area."""
    key = ["gvkey", "srcdate"]
    rows = clean_segments(segments).withColumn("geo_label", F.coalesce("geo_label", F.lit("UNKNOWN")))
    rows = rows.repartition(*key).groupBy(*key, "geo_label").agg(F.sum("sales").alias("segment_sales"), F.count("sid").alias("segment_rows"))
    rows = rows.withColumn("snapshot_sales", F.sum("segment_sales").over(Window.partitionBy(*key)))
    return rows.select("gvkey", F.col("srcdate").alias("segment_srcdate"), "geo_label", macro_area(F.col("geo_label")).alias("macro_area"), (F.col("segment_sales") / F.col("snapshot_sales")).alias("revenue_share"), "segment_sales", "segment_rows", "snapshot_sales")


def stepped_shares(snaps: DataFrame) -> DataFrame:
    """Shares on a grid of 1e-9, so equal ones stay equal whatever the order of addition."""
    return snaps.withColumns({c: stepped(F.col(c), 9) for c in ("foreign_share", "domestic_share", "geo_hhi", "top_geo_share")})
