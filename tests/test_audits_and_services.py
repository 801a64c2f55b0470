"""Audits by rules, the freeze, estimates from footers, and the statistics services as a data source."""

from __future__ import annotations

import json
import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits
from tidemark.sources import footers, macro_service


def whole_state() -> dict[str, dict]:
    ok = {"status": "ok"}
    out = {
        "schema": {"wrds": {"connection_status": "ok", "smoke_test_ok": True}, "errors": [], "roles": {"a": {"selected": {"missing_required_groups": []}}, "b": {"selected": {"missing_required_groups": []}}}},
        "full_extract": {**ok, "execute": True, "years": list(range(2006, 2026)), "shards": {str(y): {} for y in range(2006, 2026)}},
        "panel": {**ok, "checks": {"panel_rows": 936897, "activation_rule_violations": 0, "max_date": "2025-12-31"}}, "baseline": {**ok, "checks": {"rank_ic_months": 238}},
        "holdout_protocol": {"status": "frozen", "holdout_opened": False, "selected_model": {"variant": "all_plus_macro"}, "checks": {"failed": 0}},
        "deepsets": {**ok, "checks": {"variants_ok": 2}}, "set_transformer": {**ok, "checks": {"variants_ok": 1}},
    }
    for c in audits.CHAINS:
        safe = c == "fred_initial"
        out[f"macro_{c}"] = {**ok, "checks": {"source_count": 4, "series_count": 8, "lookahead_safe": True, "revision_safe": safe}}
        out[f"macro_tensor_{c}"] = {**ok, "checks": {"aggregation": {"macro_coverage_rate": 1.0, "macro_feature_count": 24}, "joined_token_match_rate": 1.0, "macro": {"lookahead_safe": True, "revision_safe": safe, "availability_source": "available_date"}}}
        out[f"lgbm_{c}"] = {**ok, "checks": {"variants_ok": 7, "variants_diagnostic_only": 1, "best_spread_variant": "all_plus_macro"}}
        out[f"factor_{c}"] = {**ok, "checks": {"variants": 7, "factor_months": 238}}
        out[f"claim_ledger_{c}"] = {**ok, "checks": {"validation_failures": 0, "blocked_claims": 1 if c == "nonfred" else 0}}
        out[f"publication_tables_{c}"] = {**ok, "checks": {"review_failures": 0, "claim_validation_failures": 0}}
        out[f"visual_pack_{c}"] = {**ok, "checks": {"figure_count": 9}}
    return out


def audited(spark, state: dict) -> tuple[dict, str]:
    rows = audits.audit(spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in state.items()], "run string, body string"), audits.private_state_rules()).cache()
    return {(r["area"], r["check"]): r["status"] for r in rows.collect()}, audits.verdict(rows).first()["status"]


def test_whole_state_passes_and_each_change_is_found(spark):
    state = whole_state()
    rows, status = audited(spark, state)
    assert status == "ok" and set(rows.values()) == {"pass"} and rows["macro_nonfred", "revision_safe_covered"] == "pass" and ("claim_ledger_nonfred", "blocked_claims") not in rows
    del state["baseline"]
    state["panel"]["checks"]["panel_rows"] = 12
    state["schema"]["roles"]["b"]["selected"]["missing_required_groups"] = [["x"]]
    state["visual_pack_nonfred"] = "no json"
    state["macro_tensor_fred_initial"]["checks"]["macro"] = {"vintage_safe": True}
    rows, status = audited(spark, state)
    failed = {k for k, v in rows.items() if v != "pass"}
    assert status == "fail" and failed == {
        ("baseline", "manifest_exists"), ("baseline", "status_ok"), ("baseline", "rank_ic_months"), ("panel", "row_count"), ("schema", "required_columns_resolved"),
        ("visual_pack_nonfred", "manifest_exists"), ("visual_pack_nonfred", "status_ok"), ("visual_pack_nonfred", "figures"), ("macro_nonfred", "revision_safe_covered"), ("macro_tensor_nonfred", "revision_safe_covered"),
    }


def test_blocked_claims_block_only_if_no_chain_is_free_of_them(spark):
    state = whole_state()
    for c in audits.CHAINS:
        state[f"claim_ledger_{c}"]["checks"]["blocked_claims"] = 1
    rows, _ = audited(spark, state)
    assert rows["claim_ledger_nonfred", "blocked_claims"] == "blocked" and rows["claim_ledger_full_catalog", "no_blocked_claims"] == "fail"


SUMMARY = "model_family string, variant string, mean_rank_ic double, t_rank_ic double, mean_q5_minus_q1 double, t_q5_minus_q1 double, prediction_rows long"
ROBUST = "model_family string, variant string, mean_net_q5_minus_q1 double, t_net_q5_minus_q1 double, gross_alpha double, gross_alpha_t double, alpha_months long"


def test_freeze_needs_all_checks_and_one_changed_figure_breaks_it(spark):
    state = {
        "panel": {"status": "ok", "checks": {"max_date": "2025-12-31", "activation_rule_violations": 0}}, "models": {"status": "ok", "checks": {"best_spread_variant": "all_plus_macro"}, "outputs": {"variants": {"all_plus_macro": {"status": "ok"}}}},
        "factor": {"status": "ok"}, "claims": {"checks": {"validation_failures": 0}}, "tables": {"checks": {"review_failures": 0}}, "figures": {"status": "ok"}, "models_summary": {"rows": 1}, "factor_summary": {"rows": 1},
    }
    summary = spark.createDataFrame([("lgbm", "all_plus_macro", 0.02, 2.0, 0.01, 3.0, 10), ("lgbm", "all", 0.01, 1.0, 0.0, 0.1, 10)], SUMMARY)
    robust = spark.createDataFrame([("lgbm", "all_plus_macro", 0.009, 2.7, 0.008, 2.4, 81)], ROBUST)

    def statuses(summary, state, before=None):
        bodies = spark.createDataFrame([(k, json.dumps(v)) for k, v in state.items()], "run string, body string")
        return {r["check"]: (r["status"], r["detail"]) for r in audits.frozen(audits.audit(bodies, audits.freeze_rules("all_plus_macro")), audits.selection_hash(summary, robust, "lgbm", "all_plus_macro"), before=before).collect()}

    first = statuses(summary, state)
    assert len(first) == 14 and {s for s, _ in first.values()} == {"pass"}
    content = first["selection_unchanged"][1]
    assert len(content) == 64 and statuses(summary.orderBy(F.rand(1)), state, content)["selection_unchanged"] == ("pass", content)
    moved = summary.withColumn("t_rank_ic", F.when(F.col("variant") == "all_plus_macro", 2.000002).otherwise(F.col("t_rank_ic")))
    assert statuses(moved, state, content)["selection_unchanged"][0] == "fail"
    assert statuses(summary.where("variant = 'all'"), state)["selection_unchanged"] == ("fail", "none")
    state["panel"]["checks"]["max_date"] = "2026-01-31"
    state["models"]["checks"]["best_spread_variant"] = "all"
    assert {k for k, (s, _) in statuses(summary, state).items() if s == "fail"} == {"holdout_unopened_by_panel_max_date", "selected_by_development_spread"}


def test_estimates_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).select("id", (F.col("id") % 7).cast("int").alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.lit("x").alias("s")).repartition(3).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    rows = footers.table_estimates(spark, {"a": (path, "k"), "b": (path, "d"), "c": (path, None)}).collect()
    assert [tuple(r) for r in rows] == [("a", "k", 1000, "0", "6"), ("b", "d", 1000, "2020-01-01", "2022-09-26"), ("c", None, 1000, None, None)]
    plan = footers.footer_plan(spark, path, "d")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(d), MAX(d)]" in plan and "ReadSchema: struct<count(*):bigint" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    with pytest.raises(ValueError, match="no range"):
        footers.footer_plan(spark, path, "s")


def test_requests_name_the_window_and_vintages():
    ask = lambda e: macro_service.request_of(e, "k", date(2020, 1, 1), date(2021, 6, 30))
    fred = parse_qs(urlparse(ask({"source": "fred", "series_id": "X", "timing": "fred_initial_release"}).full_url).query)
    assert fred["observation_start"] == ["2020-01-01"] and fred["output_type"] == ["4"] and fred["realtime_start"] == ["1776-07-04"]
    assert "realtime_start" not in ask({"source": "fred", "series_id": "X"}).full_url
    bls = ask({"source": "bls", "series_id": "S"})
    assert bls.get_method() == "POST" and json.loads(bls.data) == {"seriesid": ["S"], "startyear": "2020", "endyear": "2021", "registrationkey": "k"}
    assert parse_qs(urlparse(ask({"source": "bea", "series_id": "S", "table_name": "T1"}).full_url).query)["Year"] == ["2020,2021"]
    assert ask({"source": "eia", "series_id": "E.M"}).full_url.startswith("https://api.eia.gov/v2/seriesid/E.M?api_key=k&start=2020-01-01")


@pytest.mark.parametrize(("period", "year", "want"), [("M02", "2020", date(2020, 2, 29)), ("M13", "2020", None), ("Q3", "2021", date(2021, 9, 30)), ("2020Q1", None, date(2020, 3, 31)), ("2020M11", None, date(2020, 11, 30)), ("2020-05", None, date(2020, 5, 31)), ("2020-05-06", None, date(2020, 5, 6)), ("2020", None, date(2020, 12, 31)), ("x", "2020", None), ("M02", None, None)])
def test_periods(period, year, want):
    assert macro_service.period_end(period, year) == want


@pytest.fixture
def service():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked = parse_qs(urlparse(self.path).query)
            seen.append(asked)
            if asked["series_id"] == ["BAD"]:
                self.send_response(500)
                self.end_headers()
                return
            body = json.dumps({"observations": [{"date": f"{y}-{m:02d}-01", "value": f"1,{y}", "realtime_start": f"{y}-12-31"} for y in range(2018, 2023) for m in (1, 7)] + [{"date": "2020-02-01", "value": "."}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", seen
    server.shutdown()


def test_filters_reach_the_requests_and_a_bad_series_leaves_the_others(spark, service):
    url, seen = service
    catalog = [{"series_id": "good"}, {"series_id": "bad"}, {"source": "eia", "series_id": "e", "body": "{"}, {"source": "bls", "series_id": "b", "body": '{"Results":{"series":[{"data":[{"year":"2020","period":"M03","value":"7"},{"year":"2020","period":"M13","value":"8"}]}]}}'}]
    rows = macro_service.read_series(spark, catalog, fred_url=url, fred_key="secret")
    assert rows.rdd.getNumPartitions() == 4
    found = rows.where("date >= date '2020-01-01' AND date <= date '2021-03-31'").select("source", "series_id", "date", "value", "asked_from", "asked_to").collect()
    assert sorted((r["source"], r["series_id"], str(r["date"]), r["value"]) for r in found) == [("bls", "B", "2020-03-31", 7.0), *(("fred", "GOOD", d, v) for d, v in (("2020-01-01", 12020.0), ("2020-07-01", 12020.0), ("2021-01-01", 12021.0)))]
    assert {(str(r["asked_from"]), str(r["asked_to"])) for r in found} == {("2020-01-01", "2021-03-31")}
    assert ["2020-01-01"] in [a["observation_start"] for a in seen] and all(a["api_key"] == ["secret"] for a in seen)
    errors = {r["series_id"]: r["error"] for r in rows.where("error IS NOT NULL").collect()}
    assert set(errors) == {"BAD", "E"} and "500" in errors["BAD"] and "JSON" in errors["E"]
    with pytest.raises(Exception, match="unknown services"):
        macro_service.read_series(spark, [{"source": "x", "series_id": "y"}]).collect()
