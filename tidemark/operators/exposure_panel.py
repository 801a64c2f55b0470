"""The short panel for smoke runs, latest reports, and the sector by label matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sic_sector
from .asof import interval_join, keep_one
from .panel import _last_shard


def exposure_months(snaps: DataFrame, links: DataFrame, returns: DataFrame, months: int = 12) -> DataFrame:
    """Snapshots with the returns of the firm linked at their source date, after it and up to `months` later."""
    held = interval_join(snaps, links.select("gvkey", "permno", "linkdt", "linkenddt"), ["gvkey"], "segment_srcdate", "linkdt", "linkenddt").drop("linkdt", "linkenddt")
    near = (held["permno"] == returns["permno"]) & (returns["date"] > held["segment_srcdate"]) & (returns["date"] <= F.add_months(held["segment_srcdate"], months))
    return held.join(returns, near).select(*(held[c] for c in held.columns), *(returns[c] for c in returns.columns if c != "permno"))


def with_latest_report(rows: DataFrame, funda: DataFrame) -> DataFrame:
    """`rows` with the columns of the firm's last report, suffixed _funda. Of several with that date the one of the latest shard
    stays, and then the one of the largest other columns, however the rows are dealt."""
    last = keep_one(funda, ["gvkey"], [F.desc_nulls_last("datadate"), *_last_shard(funda, "gvkey", "datadate")]).drop("year")
    return rows.join(last.select("gvkey", *(F.col(c).alias(f"{c}_funda") for c in last.columns if c != "gvkey")), "gvkey", "left")


def largest(df: DataFrame, key: str, amount: str, n: int) -> DataFrame:
    """The n keys of largest total, the smaller key first among equals."""
    return df.groupBy(key).agg(F.sum(amount).alias("total")).orderBy(F.desc_nulls_last("total"), key).limit(n)


def sector_matrix(panel: DataFrame, tokens: DataFrame, labels: list[str]) -> DataFrame:
    """Mean revenue share by sector and label in the panel's last year, one column a label, 0 where none."""
    last = panel.agg(F.max(F.year("date")).alias("_y"))  # one row
    rows = panel.join(F.broadcast(last), F.year("date") == F.col("_y")).select("gvkey", "segment_srcdate", sic_sector(F.col("siccd").cast("string")).alias("sector"))
    return rows.join(tokens, ["gvkey", "segment_srcdate"]).groupBy("sector").pivot("geo_label", labels).agg(F.avg("revenue_share")).na.fill(0.0)


def exposure_by_sector(panel: DataFrame, tokens: DataFrame, returns: DataFrame, n: int = 10) -> DataFrame:
    """(sector, geo_label, mean_share, firm_months): mean revenue share in the panel's last year of the n labels of largest
    total share there. The sector is that of the returns' industry code on the firm's date; a firm-month without one is
    Unknown."""
    last = panel.agg(F.max(F.year("date")).alias("_y"))  # one row
    recent = panel.join(F.broadcast(last), F.year("date") == F.col("_y")).select("gvkey", "permno", "date", "segment_srcdate")
    codes = returns.select("permno", "date", sic_sector(F.col("siccd").cast("string")).alias("sector")).dropDuplicates(["permno", "date"])
    rows = recent.join(codes, ["permno", "date"], "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown"))).join(tokens, ["gvkey", "segment_srcdate"])
    rows = rows.join(largest(rows, "geo_label", "revenue_share", n), "geo_label", "left_semi")
    return rows.groupBy("sector", "geo_label").agg(F.avg("revenue_share").alias("mean_share"), F.count("*").alias("firm_months"))
