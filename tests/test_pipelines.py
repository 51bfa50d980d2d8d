"""Runs over generated files: ingestion, then reliability and monitoring of what it left."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gridspark import cli, monitoring_run, pipelines
from gridspark.sources import generator

NAMES = {"string": "string", "bigint": "integer", "double": "number", "boolean": "boolean", "timestamp": "timestamp", "date": "date"}


@pytest.fixture()
def raw(spark, tmp_path):
    """Raw files of a small network, with their manifest and contracts; (config, manifest writer)."""
    net = generator.network(spark, 2, 1, 2, 3)
    assets = generator.assets(net, "2026-01-01")
    made = {"smart_meter_events": generator.smart_meter_events(spark, net, "2026-01-01", "2026-01-01 06:00:00", drop=0.0), "asset_inventory": assets, "outage_history": generator.outages(net, assets, "2026-01-01", 6, chance=1.0)}
    keys = {"smart_meter_events": "event_id", "asset_inventory": "asset_id", "outage_history": "outage_id"}
    source, kinds = tmp_path / "raw", {}
    source.mkdir()
    for name, df in made.items():
        fields = [{"name": n, "type": NAMES.get(t, "integer"), "required": n in (keys[name], "feeder_id") and name != "asset_inventory"} for n, t in df.dtypes]
        kinds[name] = {"dataset": name, "schema_version": "2.0.0", "format": "jsonl", "primary_key": [keys[name]], "fields": fields}
        out = df.select(*[F.date_format(n, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(n) if t == "timestamp" else F.col(n) for n, t in df.dtypes])
        (source / f"{name}.jsonl").write_text("".join(r + "\n" for r in out.toJSON().collect()))

    def manifest():
        files = [{"dataset": n, "name": f"{n}.jsonl", "size": len(b), "sha256": hashlib.sha256(b).hexdigest(), "records": len([x for x in b.split(b"\n") if x.strip()])} for n in made if (b := (source / f"{n}.jsonl").read_bytes()) is not None]
        (source / "manifest.json").write_text(json.dumps({"files": files}))

    manifest()
    config = {f"{k}_root": str(tmp_path / k) for k in ("interim", "quarantine", "report")} | {"source_root": str(source), "contracts": kinds, "relations": [("outage_history", "primary_asset_id", "asset_inventory", "asset_id")]}
    return config, manifest, source


def test_ingestion_then_reliability_then_monitoring(spark, raw, tmp_path):
    config, _, _ = raw
    done = pipelines.run_ingestion(spark, config, "one")
    assert done.found == [] and done.status in ("PASSED", "PASSED_WITH_WARNINGS"), (done.found, done.counts)
    assert (done.counts["smart_meter_events"]["discovered"], done.counts["smart_meter_events"]["valid"]) == (72, 72)
    assert done.counts["ALL"]["invalid"] == 0 and done.counts["outage_history"]["valid"] == 4, (json.loads(open(done.paths["metrics"]).read())["issues"], spark.read.json(config["quarantine_root"]).collect())
    assert spark.read.parquet(done.paths["smart_meter_events"]).count() == 72
    k = pipelines.run_reliability(spark, {"interim_root": config["interim_root"], "output_root": str(tmp_path / "out"), "start": "2026-01-01", "end": "2026-01-02"}, "r")
    rows = spark.read.parquet(k.paths["reliability"]).collect()
    assert k.counts["results"]["n"] == len(rows) == 2 + 2 + 4 and {r.population_denominator for r in rows} == {6, 3}
    days = pipelines.run_reliability(spark, {"interim_root": config["interim_root"], "output_root": str(tmp_path / "days"), "start": "2026-01-01", "end": "2026-01-03 12:00:00", "frequency": "daily"}, "d")
    daily = spark.read.parquet(days.paths["reliability"]).collect()
    # Every entity in each of three days, the last one of twelve hours; all outages are on the first.
    assert len(daily) == 3 * 8 and {(r.period_start, r.period_end) for r in daily} == {(f"2026-01-0{d}T00:00:00Z", e) for d, e in ((1, "2026-01-02T00:00:00Z"), (2, "2026-01-03T00:00:00Z"), (3, "2026-01-03T12:00:00Z"))}
    assert {r.asai for r in daily if "01-01T" not in r.period_start} == {1.0} and {(r.entity_id, r.customer_interruptions) for r in daily if "01-01T" in r.period_start} == {(r.entity_id, r.customer_interruptions) for r in rows}
    told = json.loads(open(k.paths["metrics"]).read())
    assert sum(told["counts_by_reliability_band"].values()) == 8 and told["status"] == "COMPLETED"
    m = monitoring_run.run_monitoring(spark, {"interim_root": config["interim_root"], "output_root": str(tmp_path / "mon"), "datasets": ["smart_meter_events", "outage_history", "weather_data"], "now": "2026-01-03 00:00:00",
                                              "run_roots": [config["report_root"], str(tmp_path / "none")], "required_components": ["none"]}, "m")
    got = {(r.scope_id, r.monitor_type): (r.reason_code, r.alert_status) for r in spark.read.parquet(m.paths["alerts"]).collect()}
    assert got["smart_meter_events", "data_freshness"] == ("DATA_STALE", "TRIGGERED")
    assert got["weather_data", "data_freshness"][0] == "DATASET_EMPTY" and got["weather_data", "data_volume"][0] == "BELOW_MINIMUM_VOLUME"
    assert got["one", "pipeline_health"][0] == "COMPONENT_HEALTHY" and got["not-available", "pipeline_health"] == ("COMPONENT_NOT_AVAILABLE|MISSING_REQUIRED_COMPONENT", "TRIGGERED")


def test_ingestion_quarantines_and_refuses(spark, raw):
    config, manifest, source = raw
    at = source / "outage_history.jsonl"
    rows = [json.loads(x) for x in at.read_text().splitlines()]
    rows[0]["primary_asset_id"] = "AST-NOBODY"
    rows[1]["duration_minutes"] = "x"
    rows[2]["more"] = 1
    at.write_text("".join(json.dumps(r) + "\n" for r in [*rows, rows[3]]) + "{broken\n")
    refused = pipelines.run_ingestion(spark, config, "two")
    assert refused.status == "FAILED_MANIFEST" and {c for _, c in refused.found} == {"MANIFEST_SIZE_MISMATCH"}
    manifest()
    done = pipelines.run_ingestion(spark, config | {"maximum_error_rate": 0.5}, "three")
    kept = spark.read.json(config["quarantine_root"])
    codes = sorted(i.code for r in kept.collect() for i in r.issues)
    assert {"FOREIGN_KEY_NOT_FOUND", "INVALID_DATA_TYPE", "MALFORMED_RECORD", "DUPLICATE_PRIMARY_KEY"} <= set(codes)
    assert (done.counts["outage_history"]["discovered"], done.counts["outage_history"]["valid"]) == (6, 1)
    assert {json.loads(r.record)["_row"] for r in kept.collect() if any(i.code == "MALFORMED_RECORD" for i in r.issues)} == {6}
    assert pipelines.run_ingestion(spark, config | {"maximum_error_rate": 0.001}, "four").status == "FAILED_QUALITY_THRESHOLD"
    (source / "strange.txt").write_text("x")
    (source / "asset_inventory.jsonl").unlink()
    odd = config | {"contracts": config["contracts"] | {"odd": config["contracts"]["outage_history"] | {"dataset": "odd", "format": "xml"}}}
    found = {c for _, c in pipelines.run_ingestion(spark, odd, "five").found}
    assert {"FILE_UNEXPECTED", "FILE_MISSING", "UNSUPPORTED_FORMAT"} <= found


def test_settings_are_checked(spark, tmp_path):
    for bad in ({}, {"interim_root": "a", "output_root": "b", "start": "2026-01-01", "end": "2026-01-02", "frequency": 3}, {"interim_root": "a", "output_root": "b", "start": "x", "end": "y", "what": 1}):
        with pytest.raises(pipelines.ConfigError):
            pipelines.run_reliability(spark, bad)
    with pytest.raises(pipelines.ConfigError):
        pipelines.run_reliability(spark, {"interim_root": "a", "output_root": "b", "start": "2026-01-02", "end": "2026-01-01"})
    f = tmp_path / "c.yaml"
    f.write_text("interim_root: a\n")
    assert cli.main(["reliability", "--config", str(f)]) == 2 and cli.main(["reliability"]) == 2
