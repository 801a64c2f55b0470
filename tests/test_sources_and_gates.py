from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates, models
from tidemark.sources import catalog, macro_api, sinks, tables


def test_years_and_shards(spark, tmp_path):
    assert tables.year_list("2006,2008-2010, 2008") == [2006, 2008, 2009, 2010]
    root = str(tmp_path / "raw")
    for y in (2020, 2021):
        spark.createDataFrame([(y, "a")], "n int, s string").write.parquet(f"{root}/year={y}/links.parquet")
    assert sorted((r["year"], r["n"]) for r in tables.read_shards(spark, root, "links").collect()) == [(2020, 2020), (2021, 2021)]
    assert tables.read_optional_shards(spark, root, "daily") is None


def test_restartable_years_and_info(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(2020, 1), (2021, 2)], "year int, x int")
    assert tables.write_missing_years(rows, out, [2020]) == [2020]
    assert tables.write_missing_years(rows, out, [2020, 2021]) == [2021]
    assert tables.write_missing_years(rows, out, [2020, 2021]) == []
    info = tables.table_info(spark.read.parquet(out)).first()
    assert (info["rows"], info["columns"], info["files"]) == (2, 2, 2)


def test_optional_csv_and_tagged_union(spark, tmp_path):
    none = tables.read_csv(spark, str(tmp_path / "none.csv"), "a int", optional=True)
    assert none.count() == 0 and none.columns == ["a"]
    both = tables.union_tagged({"x": spark.createDataFrame([(1,)], "a int"), "y": spark.createDataFrame([(2,)], "b int")})
    assert sorted((r["model_run_id"], r["a"], r["b"]) for r in both.collect()) == [("x", 1, None), ("y", None, 2)]


def test_predictions_take_the_variant_from_the_name(spark, tmp_path):
    path = str(tmp_path / "lgbm_all_predictions.parquet")
    spark.createDataFrame([(date(2020, 1, 31), 1, 0.5, 0.1), (None, 2, 0.5, 0.1)], "date date, permno long, prediction double, target double").write.parquet(path)
    assert [(r["variant"], r["permno"]) for r in tables.read_predictions(spark, [path], "lgbm", "r").collect()] == [("all", 1)]
    with pytest.raises(ValueError, match="id of their run"):
        tables.read_predictions(spark, [path], "lgbm", None)


def test_extract_links_by_overlap(spark):
    rows = [("a", date(2000, 1, 1), None, "LU"), ("b", date(2000, 1, 1), date(2001, 1, 1), "LU"), ("c", date(2030, 1, 1), None, "LU"), ("d", date(2000, 1, 1), None, "XX"), ("e", date(2006, 3, 31), None, "LC")]
    links = spark.createDataFrame([(g, 1, 1, a, b, k, "P", 1) for g, a, b, k in rows], "gvkey string, lpermno long, lpermco long, linkdt date, linkenddt date, linktype string, linkprim string, usedflag int")
    assert [r["gvkey"] for r in tables.extract(spark, "links", date(2005, 1, 1), date(2005, 12, 31), links=links).collect()] == ["a", "e"]
    assert tables.extract(spark, "links", date(2005, 1, 1), date(2005, 12, 31), links=links).columns[:3] == ["gvkey", "permno", "permco"]


@pytest.mark.parametrize(
    ("source", "body", "want"),
    [("FRED", '{"observations":[{"date":"2020-01-01","value":"1.5","realtime_start":"2020-02-03"},{"date":"2020-02-01","value":"."}]}', [(date(2020, 1, 1), 1.5)]),
     ("BLS", '{"Results":{"series":[{"seriesID":"s","data":[{"year":"2020","period":"M02","value":"3"},{"year":"2020","period":"M13","value":"9"}]}]}}', [(date(2020, 2, 29), 3.0)]),
     ("BEA", '{"BEAAPI":{"Results":{"Data":[{"TimePeriod":"2020Q2","DataValue":"1,234.5"}]}}}', [(date(2020, 6, 30), 1234.5)]),
     ("EIA", '{"response":{"data":[{"period":"2020-05","value":"7"}]}}', [(date(2020, 5, 31), 7.0)])],
)
def test_service_answers(spark, source, body, want):
    rows = macro_api.observations(spark.createDataFrame([("s", "USA", body), ("t", "USA", None), ("u", "USA", "{")], "series_id string, macro_area string, body string"), source)
    assert [(r["date"], r["value"]) for r in rows.collect()] == want
    if source == "FRED":
        assert macro_api.available(rows, 7, realtime=True).first()["available_date"] == date(2020, 2, 3)


def test_release_lag_runs_from_the_month_end(spark):
    rows = spark.createDataFrame([(date(2020, 1, 1), None), (date(2020, 1, 1), date(2020, 3, 1))], "date date, realtime_start date")
    assert [r["available_date"] for r in macro_api.available(rows, 7).collect()] == [date(2020, 2, 7)] * 2
    assert [r["available_date"] for r in macro_api.available(rows, 7, realtime=True).collect()] == [date(2020, 2, 7), date(2020, 3, 1)]


def test_gates(spark):
    rows = spark.createDataFrame([(1, "proves Arbitrage", "x"), (1, "plain", "blocked until data"), (2, "plain", "y"), (None, None, None)], "k int, claim string, evidence string")
    assert [r["status"] for r in gates.claim_status(rows).orderBy(F.asc_nulls_last("k"), "claim").collect()] == ["blocked", "fail", "pass", "pass"]
    got = gates.all_of(gates.unique_keys(rows, "u", ["k"]), gates.not_empty(rows.limit(0), "e"), gates.unique_keys(rows.limit(0), "n", ["k"])).collect()
    assert [(r["check"], r["status"], r["detail"]) for r in got] == [("u", "fail", "1"), ("e", "fail", "0"), ("n", "ok", "0")]
    counts = spark.createDataFrame([("macro_only", 5, 0), ("all", 5, 3), ("all2", 5, 0)], "variant string, prediction_rows int, ic_months int")
    assert [r["status"] for r in gates.variant_status(counts).collect()] == ["diagnostic_only", "ok", "needs_review"]


def test_scaling_uses_the_train_rows_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    out = models.standardised(train, spark.createDataFrame([(2.0,), (None,), (100.0,)], "x double"), ["x"]).collect()
    assert out[0]["x"] == 0 and out[1]["x"] == 0 and out[2]["x"] > 100
    flat = models.standardised(spark.createDataFrame([(1.0,)], "x double"), spark.createDataFrame([(3.0,)], "x double"), ["x"]).first()
    assert flat["x"] == 2.0


def test_roles_take_the_best_table(spark):
    rows = [("crsp", "ccmxpf_linktable", c) for c in ("gvkey", "lpermno", "linkdt", "linkenddt")] + [("comp", "link_other", "gvkey"), ("x", "unrelated", "gvkey")]
    columns = spark.createDataFrame(rows, "library string, table string, column string")
    role = catalog.Role("links", ("crsp", "comp"), ("ccm", "link"), ("ccmxpf_linktable",), (("gvkey",), ("lpermno", "permno"), ("linkdt",)), ("linkdt",))
    assert [tuple(r) for r in catalog.resolve_roles(columns, [role]).collect()] == [("links", "crsp", "ccmxpf_linktable", 218, "linkdt")]


def test_series_catalog_and_standard_frame(spark):
    series = catalog.series_catalog(spark, [{"series_id": "gdp", "release_lag_days": 7}, {"series_id": "cpi", "timing": "FRED_initial_release", "macro_area": "usa"}])
    with pytest.raises(ValueError):
        catalog.series_catalog(spark, [{"source": "nowhere", "series_id": "x"}])
    seen = spark.createDataFrame([("GDP", "2020-01-01", "1", None, None), ("CPI", "2020-01-01", "x", "2020-02-13", None)], "series_id string, date string, value string, realtime_start string, realtime_end string")
    out = {r["series_id"]: (r["available_date"], r["revision_safe"], r["value"]) for r in catalog.standard_frame(seen, series).collect()}
    assert out == {"GDP": (date(2020, 2, 7), False, 1.0), "CPI": (date(2020, 2, 13), True, None)}


def test_sinks_keep_what_came_before_an_error(spark, tmp_path):
    load = lambda n: spark.createDataFrame([(n, 1.0)], "series_id string, value double") if n != "b" else 1 / 0
    done = sinks.load_series(["a", "b", "c"], load, str(tmp_path / "m"))
    assert (done["status"], done["rows"], done["series_attempted"], done["partial"]) == ("api_error", 1, 2, True)
    assert spark.read.parquet(str(tmp_path / "m.partial")).count() == 1
    assert sinks.load_series(["a"], load, str(tmp_path / "n"))["status"] == "ok"
    sinks.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "t"))
    sinks.write_json(spark, {"a": 1}, str(tmp_path / "j"))
    assert [tuple(r)[::2] for r in sinks.table_inventory(spark, {"f": str(tmp_path / "t")}).collect()] == [("f", "a,b")]
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a": 1}'
