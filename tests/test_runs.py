"""Runs of the models and of reporting over generated datasets, from the raw files to the star schema."""

import json

import pytest

from gridspark import monitoring_run, pipelines, runs
from gridspark.sources import files

START, END = "2026-01-01 00:00:00", "2026-01-01 12:00:00"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    done = runs.run_generation(spark, {"output_root": str(root), "start": START, "end": END, "regions": 2, "substations": 2, "feeders": 2, "meters": 3, "seed": 1}, "g")
    return root, done


def told(run):
    return json.loads(open(run.paths["metrics"]).read())


def test_generation_then_all_runs(spark, made, tmp_path):
    root, done = made
    assert done.counts["smart_meter_events"]["records"] <= 24 * 12 and done.counts["substation_events"]["records"] == 8 * 12 and done.counts["asset_inventory"]["records"] == 4 + 8 * 5
    at = {"interim_root": str(root)}
    h = runs.run_asset_health(spark, at | {"output_root": str(tmp_path / "h"), "now": END}, "ah-1")
    rows = spark.read.parquet(h.paths["health"]).collect()
    assert len(rows) == 44 == sum(h.counts["counts_by_health_band"].values()) and told(h)["assets_discovered"] == 44
    weights = {"age": 0.18, "inspection": 0.17, "maintenance": 0.2, "telemetry_stress": 0.2, "alarm": 0.1, "outage": 0.15}
    for r in rows:
        assert r.health_score == pytest.approx(sum(r[f"{k}_component_score"] * w for k, w in weights.items()))
    f = runs.run_forecasting(spark, at | {"output_root": str(tmp_path / "f"), "backtest_folds": 2}, "fc-1")
    got = spark.read.parquet(f.paths["forecasts"]).collect()
    # Two regions: validation and test of three models, and two folds of the selected one.
    assert f.status == "COMPLETED" and len(got) == 2 * (2 * 3 + 2), (f, told(f))
    assert all(r.prediction_lower <= r.predicted_value <= r.prediction_upper for r in got)
    own = {(r.entity_id, r.forecast_timestamp): r.actual_value for r in got}
    last = {(r.entity_id, r.forecast_timestamp): r.predicted_value for r in got if r.model_name == "persistence" and r.data_split == "test"}
    before = {(r.entity_id, r.forecast_timestamp): r.actual_value for r in got if r.data_split == "validation"}
    assert {e: v for (e, _), v in last.items()} == pytest.approx({e: v for (e, _), v in before.items()}) and len(own) == 4
    errors = {m: sum(abs(r.actual_value - r.predicted_value) for r in got if r.model_name == m and r.data_split == "validation") / 2 for m in ("persistence", "moving_average", "autoregressive_linear")}
    assert told(f)["selected_model"] == min(errors, key=errors.get) and told(f)["selected_value"] == pytest.approx(min(errors.values()))
    o = runs.run_outage_prediction(spark, at | {"output_root": str(tmp_path / "o")}, "op-1")
    assert o.status == "COMPLETED" and o.found == [], o
    # Eleven ticks have their hour ahead within the telemetry, and the one before validation is purged; five unplanned outages begin in such hours.
    assert (told(o)["positive"], told(o)["negative"]) == (5, 8 * 10 - 5) and o.counts["rows"] == {"train": 64, "validation": 8, "test": 8}
    scored = spark.read.parquet(o.paths["outage_risk"])
    assert {r.model_name for r in scored.collect()} == set(runs.OUTAGE["candidate_models"]) and scored.filter("risk_score < 0 OR risk_score > 1").isEmpty()
    report = {"output_root": str(tmp_path / "r"), "date_dimension_start": "2026-01-01", "date_dimension_end": "2026-01-31", "runs": [x.paths["metrics"] for x in (h, f, o)],
              "sources": {"assets": f"{root}/asset_inventory", "health": h.paths["health"], "priorities": h.paths["priorities"], "forecasts": f.paths["forecasts"], "outage_risk": o.paths["outage_risk"]}}
    r = runs.run_reporting(spark, report, "rp-1")
    assert r.status == "COMPLETED" and r.found == [], r
    assert r.counts["fact_asset_health"]["rows"] == 44 and r.counts["dim_asset"]["rows"] == 45 and r.counts["dim_date"]["rows"] == 31
    assert told(r)["measures"]["Average Health Score"] == pytest.approx(sum(x.health_score for x in rows) / 44)
    assert told(r)["kpis"]["KPI_P1_MAINT"] == h.counts["counts_by_priority"].get("P1_IMMEDIATE_REVIEW", 0)
    # Sources that aren't there are empty, and what is measured over them is null.
    few = runs.run_reporting(spark, report | {"output_root": str(tmp_path / "r3"), "sources": {n: p for n, p in report["sources"].items() if n in ("assets", "health")}}, "rp-3")
    assert few.status == "COMPLETED" and told(few)["measures"]["Forecast MAE"] is None and told(few)["measures"]["Average Health Score"] == told(r)["measures"]["Average Health Score"]
    lost = runs.run_reporting(spark, report | {"output_root": str(tmp_path / "r2"), "date_dimension_end": "2025-12-31", "date_dimension_start": "2025-12-01"}, "rp-2")
    assert lost.status == "FAILED_RELATIONSHIPS" and {n for n, _ in lost.found} == {"fact_asset_health.date_key", "fact_demand_forecast.date_key"}


def test_runs_refuse(spark, made, tmp_path):
    root, _ = made
    at = {"interim_root": str(root), "output_root": str(tmp_path)}
    f = runs.run_forecasting(spark, at | {"candidate_models": ["seasonal_naive"]}, "x")
    assert f.status == "FAILED_FORECASTING_MODELS" and f.found[0][0] == "seasonal_naive"
    assert runs.run_forecasting(spark, at | {"minimum_history_intervals": 99}, "y").status == "FAILED_FORECASTING_INPUT"
    assert runs.run_outage_prediction(spark, at | {"minimum_positive_examples": 10_000}, "z").status == "FAILED_OUTAGE_INPUT"
    for run, bad in ((runs.run_forecasting, {"candidate_models": ["oracle"]}), (runs.run_asset_health, {"now": START, "missing_data_policy": "guess"}), (runs.run_generation, {"start": END, "end": START})):
        with pytest.raises(pipelines.ConfigError):
            run(spark, {k: v for k, v in at.items() if run is not runs.run_generation or k != "interim_root"} | bad)


def test_all_runs_by_uri_into_reporting(spark, made, tmp_path):
    """Every path is a URI; what reporting measures are sums over what the runs wrote."""
    root, _ = made
    plain = runs.run_asset_health(spark, {"interim_root": str(root), "output_root": str(tmp_path / "plain"), "now": END}, "ah-1")
    uri = lambda n: f"file://{tmp_path}/{n}"
    at = {"interim_root": f"file://{root}"}
    h = runs.run_asset_health(spark, at | {"output_root": uri("h"), "now": END}, "ah-1")
    scores = spark.read.parquet(h.paths["health"]).collect()
    assert {(r.asset_id, r.health_score) for r in scores} == {(r.asset_id, r.health_score) for r in spark.read.parquet(plain.paths["health"]).collect()}
    f = runs.run_forecasting(spark, at | {"output_root": uri("f")}, "fc-1")
    o = runs.run_outage_prediction(spark, at | {"output_root": uri("o")}, "op-1")
    k = pipelines.run_reliability(spark, at | {"output_root": uri("k"), "start": START, "end": END}, "rl-1")
    roots = [uri(n) for n in "hfok"]
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "metrics.json").write_text(json.dumps({"ingestion_run_id": "in-1", "run_status": "PASSED_WITH_WARNINGS", "generated_at": "2026-01-01T13:00:00Z", "totals": {"source_records_discovered": 10, "invalid_records": 1, "warning_records": 3}}))
    names = ["smart_meter_events", "substation_events", "outage_history", "nothing_here"]
    watch = at | {"output_root": uri("m"), "datasets": names, "now": "2026-01-02 13:30:00", "run_roots": [*roots, uri("i"), uri("gone")], "required_components": ["gone"],
                  "freshness_thresholds": {"outage_history": 43_200}, "current": {"asset_health": h.paths["health"], "outage_prediction": o.paths["outage_risk"]}, "baseline": {"asset_health": h.paths["health"]},
                  "contracts": {"d": CONTRACT | {"fields": [*CONTRACT["fields"], {"name": "more", "type": "string", "required": True}]}, "new": CONTRACT | {"dataset": "new"}}, "baseline_contracts": {"d": CONTRACT}}
    m = monitoring_run.run_monitoring(spark, watch, "mo-1")
    checks = {(r.monitor_type, r.component_name, r.scope_id, r.metric_name): r for r in spark.read.parquet(m.paths["checks"]).collect()}
    told_m = json.loads(files.read_text(spark, m.paths["metrics"]))
    assert set(told_m["records_by_family"]) == {"pipeline_health", "data_freshness", "data_volume", "data_quality", "schema_drift", "distribution_drift", "model_health", "analytical_health"}
    code = lambda *key: checks[key].reason_code
    assert code("data_freshness", "ingestion", "nothing_here", "freshness_age_minutes") == "DATASET_EMPTY" and code("data_freshness", "ingestion", "smart_meter_events", "freshness_age_minutes") == "DATA_STALE"
    assert code("data_freshness", "ingestion", "outage_history", "freshness_age_minutes") == "DATA_FRESH"
    assert code("data_volume", "ingestion", "nothing_here", "record_count") == "BELOW_MINIMUM_VOLUME" and code("data_volume", "ingestion", "outage_history", "record_count") == "NO_BASELINE_AVAILABLE"
    assert code("data_quality", "ingestion", "overall", "invalid_record_rate") == "ERROR_RATE_THRESHOLD_EXCEEDED" and float(checks["data_quality", "ingestion", "overall", "warning_record_rate"].metric_value) == 0.3
    assert code("pipeline_health", "ingestion", "in-1", "run_status") == "COMPONENT_RUN_WARNING" and code("pipeline_health", "forecasting", "fc-1", "run_status") == "COMPONENT_HEALTHY"
    assert code("pipeline_health", "gone", "not-available", "run_status") == "COMPONENT_NOT_AVAILABLE|MISSING_REQUIRED_COMPONENT"
    assert code("schema_drift", "ingestion", "d", "more") == "BREAKING_SCHEMA_DRIFT" and code("schema_drift", "ingestion", "new", "__schema__") == "BASELINE_MISSING"
    assert code("distribution_drift", "asset_health", "asset_health", "health_score") == "NO_DISTRIBUTION_DRIFT" and code("distribution_drift", "outage_prediction", "outage_prediction", "risk_score") == "BASELINE_MISSING"
    selected = json.loads(files.read_text(spark, f.paths["metrics"]))
    test = next(r for r in selected["metrics"] if r["model_name"] == selected["selected_model"] and r["split"] == "test")
    assert float(checks["model_health", "forecasting", "forecasting", "mae"].metric_value) == pytest.approx(test["mae"]) and ("model_health", "outage_prediction", "outage_prediction", "brier_score") in checks
    assert float(checks["analytical_health", "reliability", "reliability", "population_coverage"].metric_value) == 1.0
    assert ("analytical_health", "asset_health", "asset_health", "insufficient_data_rate") in checks
    alerts = spark.read.parquet(m.paths["alerts"]).collect()
    assert {r.suppressed for r in alerts} == {"True", "False"} and len(alerts) == len(checks)

    r = runs.run_reporting(spark, {"output_root": uri("r"), "date_dimension_start": "2026-01-01", "date_dimension_end": "2026-01-31", "roots": [*roots, uri("i"), uri("m")], "sources": {"assets": f"{at['interim_root']}/asset_inventory"}}, "rp-1")
    assert r.status == "COMPLETED" and r.found == [], r
    got = json.loads(files.read_text(spark, r.paths["metrics"]))
    kpis, predictions, risks = (spark.read.parquet(p).collect() for p in (k.paths["reliability"], f.paths["forecasts"], o.paths["outage_risk"]))
    total = lambda c: sum(x[c] or 0 for x in kpis)
    want = {
        "Total Unplanned Outages": total("unplanned_outage_count"), "Average Health Score": sum(x.health_score for x in scores) / 44, "System SAIFI": total("customer_interruptions") / total("population_denominator"),
        "System SAIDI": total("customer_interruption_minutes") / total("population_denominator"), "System CAIDI": total("customer_interruption_minutes") / total("customer_interruptions"), "System ASAI": 1 - total("asui") / len(kpis),
        "High Outage Risk Count": sum(x.risk_band in ("HIGH", "CRITICAL") for x in risks), "Forecast MAE": sum(abs(x.predicted_value - x.actual_value) for x in predictions) / len(predictions),
        "Active Warning Alerts": sum(x.severity == "WARNING" and x.suppressed == "False" for x in alerts), "Active Critical Alerts": sum(x.severity == "CRITICAL" and x.suppressed == "False" for x in alerts)}
    assert {n: got["measures"][n] for n in want} == pytest.approx(want) and want["Active Critical Alerts"] > 0
    assert got["measures"]["Grounded Response Rate"] is None and got["kpis"]["KPI_STALE_DATASETS"] == sum(c.monitor_type == "data_freshness" and c.status != "HEALTHY" for c in checks.values()) > 1
    assert got["kpis"]["KPI_SCHEMA_DRIFT"] == sum(c.monitor_type == "schema_drift" and c.status != "HEALTHY" for c in checks.values()) == 2
    dims = {x.source_run_id: (x.component_name, x.run_status) for x in spark.read.parquet(r.paths["dim_component_run"]).collect()}
    assert dims == {"ah-1": ("asset_health", "COMPLETED"), "fc-1": ("forecasting", "COMPLETED"), "op-1": ("outage_prediction", "COMPLETED"), "rl-1": ("reliability", "COMPLETED"), "mo-1": ("monitoring", "COMPLETED"), "in-1": ("ingestion", "PASSED_WITH_WARNINGS")}
    assert r.counts["fact_monitoring_check"]["rows"] == len(checks) and r.counts["fact_reliability_kpi"]["rows"] == len(kpis)


CONTRACT = {"dataset": "d", "schema_version": "2.0.0", "format": "csv", "primary_key": "k", "fields": [{"name": "k", "type": "string", "required": True}, {"name": "x", "type": "number"}]}


def test_discovery_of_unlike_documents(spark, tmp_path):
    from gridspark.sources import discovery

    put = lambda path, text: ((tmp_path / path).parent.mkdir(parents=True, exist_ok=True), (tmp_path / path).write_text(text))
    put("reliability/r1/metrics.json", '{"entities_assessed": 4, "assessment_timestamp": "2026-01-01T00:00:00Z"}')
    put("reliability/r1/reliability_manifest.json", '{"schema_version": "7.0.0", "assessment_start": "2025-12-01T00:00:00Z"}')
    put("reliability/r2/metrics.json", '{"run_id": "r2", "generated_at": "2026-02-01T00:00:00Z", "run_status": "FAILED_INPUT"}')
    put("reliability/r3/metrics.json", "{not json")
    put("reliability/r4/metrics.json", "[1, 2]")
    put("copies/a/x.json", '{"ingestion_run_id": "same", "totals": {"source_records_discovered": 7, "valid_records": 6, "invalid_records": "x"}}')
    put("copies/b/x.json", '{"component": "ingestion", "run_id": "same"}')
    (tmp_path / "nothing").mkdir()
    docs = discovery.documents(spark, [str(tmp_path / n) for n in ("reliability", "copies", "nothing", "gone")])
    got = {(r.component_name, r.source_run_id): r for r in discovery.component_runs(docs).collect()}
    assert set(got) == {("reliability", f"r{i}") for i in range(1, 5)} | {("ingestion", "same"), ("nothing", "not-available"), ("gone", "not-available")}
    one = got["reliability", "r1"]
    assert (one.run_status, one.output_records, one.schema_version, one.assessment_start, one.run_timestamp, one.documents, one.copies) == ("PASSED", 4, "7.0.0", "2025-12-01T00:00:00Z", "2026-01-01T00:00:00Z", 2, 1)
    assert got["reliability", "r2"].newest and got["reliability", "r2"].run_status == "FAILED_INPUT" and not one.newest
    assert all(got["reliability", r].malformed and got["reliability", r].run_status == "FAILED_MALFORMED_JSON" for r in ("r3", "r4"))
    same = got["ingestion", "same"]
    assert (same.copies, same.input_records, same.output_records, same.invalid_records) == (2, 7, 6, None)
    assert got["gone", "not-available"].run_status == got["nothing", "not-available"].run_status == "NOT_AVAILABLE"
    assert discovery.as_source(discovery.component_runs(docs)).count() == 5
