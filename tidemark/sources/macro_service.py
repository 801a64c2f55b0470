"""Series of four statistics services as a Spark data source: one partition a series, the window of dates pushed down.

read_series() registers it and reads a catalog of series (source, series_id, ...), with the options `<source>_key` and, for
another address, `<source>_url`. A catalog
entry with a `body` is read from that saved answer instead of the network. Rows have what the service says and `error`: a
series that cannot be read is one row with its error, and the others are read all the same.
"""

from __future__ import annotations

import json
import re
from calendar import monthrange
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Where the services answer, and the first and last day of FRED's vintages.
URLS = {"fred": "https://api.stlouisfed.org/fred/series/observations", "bls": "https://api.bls.gov/publicAPI/v2/timeseries/data/", "bea": "https://apps.bea.gov/api/data", "eia": "https://api.eia.gov/v2/seriesid/"}
VINTAGES = ("1776-07-04", "9999-12-31")
#: FRED's output types of timings whose values carry the day of their publication.
PUBLISHED = {"fred_initial_release": 4, "fred_vintage_all": 2, "fred_vintage_changes": 3}
EARLIEST, LATEST = date(1900, 1, 1), date(2100, 12, 31)
SECONDS = 60


def request_of(series: dict, key: str, first: date, last: date, url: str | None = None) -> Request:
    """The request for a series' observations of the window."""
    source, code = series["source"], series["series_id"]
    url = url or URLS[source]
    if source == "bls":
        body = {"seriesid": [code], "startyear": str(first.year), "endyear": str(last.year), "registrationkey": key}
        return Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}, method="POST")
    if source == "fred":
        asked = {"series_id": code, "api_key": key, "file_type": "json", "observation_start": str(first), "observation_end": str(last)}
        timing = str(series.get("timing", "")).lower()
        if timing in PUBLISHED:
            asked |= {"realtime_start": series.get("realtime_start", VINTAGES[0]), "realtime_end": series.get("realtime_end", VINTAGES[1]), "output_type": int(series.get("fred_output_type", PUBLISHED[timing]))}
        if series.get("vintage_dates"):
            asked["vintage_dates"] = series["vintage_dates"]
        return Request(f"{url}?{urlencode(asked)}")
    if source == "bea":
        years = ",".join(map(str, range(first.year, last.year + 1)))
        asked = {"UserID": key, "method": "GetData", "datasetname": series.get("dataset", "NIPA"), "TableName": series.get("table_name", ""), "LineNumber": series.get("line_number", ""), "Frequency": str(series.get("frequency", "Q")).upper(), "Year": years, "ResultFormat": "JSON"}
        return Request(f"{url}?{urlencode({k: v for k, v in asked.items() if v})}")
    return Request(f"{url}{code}?{urlencode({'api_key': key, 'start': str(first), 'end': str(last)})}")


def period_end(period: str, year: str | None = None) -> date | None:
    """The last day of M01-M12, Q1-Q4, 2020, 2020Q1, 2020M01 or 2020-01; a whole date as it is; else none."""
    period = period.strip().upper()
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", period):
        return date(*map(int, m.groups()))
    if m := re.fullmatch(r"(\d{4})?(?:M(\d\d?)|Q([1-4])|-(\d\d))?", period):
        y = m[1] or year
        month = int(m[2] or m[4] or (int(m[3]) * 3 if m[3] else 12))
        if y and 1 <= month <= 12:
            return date(int(y), month, monthrange(int(y), month)[1])
    return None


def observations(series: dict, answer: dict) -> Iterator[tuple[date, float, str | None, str | None]]:
    """(date, value, first and last day of the vintage) of an answer; periods and values that do not parse go, and so does M13,
    the annual mean."""
    source = series["source"]
    if source == "fred":
        rows = [(r.get("date", ""), None, r.get("value"), r.get("realtime_start"), r.get("realtime_end")) for r in answer.get("observations", [])]
    elif source == "bls":
        rows = [(r.get("period", ""), r.get("year"), r.get("value"), None, None) for s in answer.get("Results", {}).get("series", []) for r in s.get("data", []) if r.get("period") != "M13"]
    elif source == "bea":
        rows = [(r.get("TimePeriod", ""), None, r.get("DataValue"), None, None) for r in answer.get("BEAAPI", {}).get("Results", {}).get("Data", [])]
    else:
        rows = [(r.get("period", ""), None, r.get(series.get("data_column", "value")), None, None) for r in answer.get("response", {}).get("data", [])]
    for period, year, value, known, until in rows:
        day = period_end(str(period), year)
        try:
            number = float(str(value).replace(",", ""))
        except ValueError:
            continue
        if day is not None:
            yield day, number, known, until


@dataclass
class Series(InputPartition):
    entry: dict
    first: date
    last: date


class MacroReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.catalog = [{**e, "source": str(e.get("source", "fred")).lower(), "series_id": str(e["series_id"]).upper()} for e in json.loads(options["catalog"])]
        if other := {e["source"] for e in self.catalog} - set(URLS):
            raise ValueError(f"unknown services {sorted(other)}")
        self.first, self.last = (date.fromisoformat(options.get(k, str(d))) for k, d in (("start", EARLIEST), ("end", LATEST)))

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Narrow the window by comparisons of the date. Spark filters again, as a service may answer more than was asked."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("date",):
                self.first = max(self.first, f.value)
            if isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("date",):
                self.last = min(self.last, f.value)
            yield f

    def partitions(self) -> list[Series]:
        return [Series(e, self.first, self.last) for e in self.catalog]

    def read(self, partition: Series) -> Iterator[tuple]:
        entry, source = partition.entry, partition.entry["source"]
        name = (source, entry["series_id"])
        asked = (partition.first, partition.last)
        try:
            if "body" in entry:
                answer = json.loads(entry["body"])
            else:
                with urlopen(request_of(entry, self.options.get(f"{source}_key", ""), *asked, self.options.get(f"{source}_url")), timeout=SECONDS) as reply:
                    answer = json.loads(reply.read())
            found = list(observations(entry, answer))
        except Exception as error:  # noqa: BLE001  any failure of one series is its own row
            yield (*name, None, None, None, None, *asked, f"{type(error).__name__}: {error}"[:500])
            return
        last = date(partition.last.year, partition.last.month, monthrange(partition.last.year, partition.last.month)[1])
        for day, value, known, until in found:
            if partition.first <= day <= last:
                yield (*name, day, value, known, until, *asked, None)


class MacroService(DataSource):
    """(source, series_id, date, value, realtime_start, realtime_end, asked_from, asked_to, error)."""

    @classmethod
    def name(cls) -> str:
        return "macro_service"

    def schema(self) -> str:
        return "source string, series_id string, date date, value double, realtime_start string, realtime_end string, asked_from date, asked_to date, error string"

    def reader(self, schema) -> MacroReader:  # noqa: ANN001
        return MacroReader(dict(self.options))


def read_series(spark: SparkSession, catalog: list[dict], **options: str) -> DataFrame:
    """The catalog's series; filters on the date reach the requests, for which the session's setting is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MacroService)
    return spark.read.format("macro_service").options(catalog=json.dumps(catalog), **options).load()
