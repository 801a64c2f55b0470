"""Scalar expressions: calendar, labels, lenient numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a domestic label, whole words in lower case.
DOMESTIC = r"\bunited states\b|\bu\.s\.?\b|\busa\b|\bus\b"
#: The first area with a term inside the upper-case label wins.
AREA_TERMS = {
    "GLOBAL": ("GLOBAL", "WORLD", "ALL", "ALL_AREAS"),
    "USD": ("USD", "DOLLAR", "TRADE WEIGHTED"),
    "USA": ("USA", "UNITED STATES", "U.S.", "US", "N_AMER", "NORTH AMERICA"),
    "CANADA": ("CAN", "CANADA"),
    "CHINA": ("CHINA", "CHIN", "PRC"),
    "EUROPE": ("EUROPE", "EURO", "EU", "EUR", "GERMANY", "FRANCE", "ITALY", "SPAIN", "UK", "UNITED KINGDOM"),
    "ASIA_EX_CHINA": ("ASIA", "JAPAN", "KOREA", "TAIWAN", "HKG", "HONG KONG", "INDIA", "APAC"),
    "LATAM": ("LATIN", "LATAM", "MEXICO", "BRAZIL", "ARGENTINA", "CHILE"),
    "MIDDLE_EAST": ("MID_EAST", "MIDDLE EAST", "SAUDI", "UAE", "ISRAEL"),
}
#: First and last industry code of each sector.
SECTORS = {
    "Agriculture": (100, 999), "Mining": (1000, 1499), "Construction": (1500, 1799), "Manufacturing": (2000, 3999), "Transport": (4000, 4999),
    "Wholesale": (5000, 5199), "Retail": (5200, 5999), "Finance": (6000, 6799), "Services": (7000, 8999), "Public": (9000, 9999),
}


def month_end(d: Column) -> Column:
    return F.last_day(d)


def next_month_end(d: Column) -> Column:
    """This month's end, or the next one's for a month end."""
    return F.last_day(F.date_add(d, 1))


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def period_to_date(text: Column, year: Column) -> Column:
    """Month ends for M02 and Q2 (with a year), 2020Q2, 2020-Q2, 2020 and 2020-03; full dates as they are; else null."""
    t = F.upper(F.trim(text))
    number = lambda pattern, group=1: F.regexp_extract(t, pattern, group).try_cast("int")
    end = lambda y, m: F.last_day(F.make_date(y, m, F.lit(1)))
    month, quarter = number(r"^M(\d{2})$"), number(r"^Q([1-4])$")
    return (
        F.when(t.rlike(r"^M(0[1-9]|1[0-2])$"), end(year, month)).when(t.rlike(r"^Q[1-4]$"), end(year, quarter * 3))
        .when(t.rlike(r"^\d{4}-?Q[1-4]$"), end(number(r"^(\d{4})"), number(r"Q([1-4])$") * 3)).when(t.rlike(r"^\d{4}$"), end(number(r"^(\d{4})$"), F.lit(12)))
        .when(t.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), end(number(r"^(\d{4})"), number(r"-(\d{2})$"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t))
    )


def geo_label(group: Column, area: Column) -> Column:
    return F.coalesce(F.nullif(group, F.lit("")), area)


def is_domestic(label: Column) -> Column:
    """False for null and blank labels."""
    return F.coalesce(F.lower(F.trim(label)).rlike(DOMESTIC), F.lit(False))


def macro_area(label: Column) -> Column:
    text = F.coalesce(F.upper(F.trim(label)), F.lit(""))
    rules = reduce(lambda w, item: w.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(term)) for term in item[1])), F.lit(item[0])), AREA_TERMS.items(), F.when(text == "", "UNKNOWN"))
    return rules.otherwise("OTHER_FOREIGN")


def normal_label(label: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(label)), F.lit("")), F.lit("UNKNOWN"))


def quoted(text: Column, mark: str = "'") -> Column:
    """A text as a literal of a query, or as a name with a double quote as the mark; marks inside are doubled."""
    return F.concat(F.lit(mark), F.replace(text, F.lit(mark), F.lit(2 * mark)), F.lit(mark))


def text_hash(text: Column) -> Column:
    """The first 16 hex digits of a query's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def slug(text: Column) -> Column:
    """Runs of anything but letters and digits as one underscore, none at the ends."""
    body = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "_"), r"^_|_$", "")
    return F.coalesce(F.nullif(body, F.lit("")), F.lit("unknown"))


def sic_sector(code: Column) -> Column:
    number = code.try_cast("double").try_cast("int")
    return reduce(lambda w, item: w.when(number.between(*item[1]), F.lit(item[0])), SECTORS.items(), F.when(number.isNull(), "Unknown")).otherwise("Unknown")


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def stepped(x: Column, digits: int = 6) -> Column:
    """Rounded with ties shifted up, so engines that add in another order agree."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.50001)) / F.lit(10.0**digits)
