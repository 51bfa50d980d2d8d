"""Operators on hand-made rows: known numbers, zero denominators, band limits, empty tables, and models against NumPy."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions.scalar import known, short_id, surrogate_key
from gridspark.operators import health, mart, metrics, models, monitoring, reliability, retrieval, risk, series, splits, validation

HOUR = dt.timedelta(hours=1)
T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame([("e", T0 + i * HOUR, float(v)) for i, v in enumerate((10, 20, 30, 40, 50, 60))], "entity_id string, ts timestamp_ntz, target double")


def test_lag_rolling_and_horizon(line):
    f = series.with_horizons(series.lag_rolling(line, (1,), (2,)), line, (1,))
    first = f.orderBy("ts").first()
    assert (first.ts, first.lag_1, first.rolling_mean_2, first.actual) == (T0 + HOUR, 20.0, 15.0, 30.0)


def test_chronological_split(line):
    f = series.lag_rolling(line, (1,), (2,))
    got = {r.ts: r.split for r in splits.chronological(f, 1, 1).collect()}
    assert got[T0 + 5 * HOUR] == "test" and got[T0 + 4 * HOUR] == "validation" and got[T0 + 3 * HOUR] == "train"


def test_fill_policies(spark):
    gap = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + 4 * HOUR, 2.0), ("b", T0, 5.0)], "entity_id string, ts timestamp_ntz, target double")
    assert series.filled(gap, "drop").count() == 3
    assert series.filled(gap, "mark").count() == 6
    filled = series.filled(gap, "forward_fill", 2).orderBy("entity_id", "ts").collect()
    assert [(r.ts.hour, r.target, r.imputed) for r in filled if r.entity_id == "a"] == [(0, 1.0, False), (1, 1.0, True), (2, 1.0, True), (4, 2.0, False)]
    with pytest.raises(ValueError):
        series.filled(gap, "fail")
    with pytest.raises(ValueError):
        series.history_gate(gap, 2)
    assert series.filled(gap.limit(0), "mark").count() == 0
    assert rows(series.recent_values(gap, 1).orderBy("entity_id")) == [("a", [2.0]), ("b", [5.0])]


def test_forecast_metrics_zero_denominators(spark):
    m = metrics.forecast(spark.createDataFrame([("m", 0.0, 1.0)], "model string, actual double, predicted double"), ["model"]).first()
    assert m.mape is None and m.wape is None and m.smape == 200.0 and m.mae == 1.0


def test_selection_ties_and_missing(spark):
    m = spark.createDataFrame([("b", 1.0, 1), ("a", 1.0, 1), ("c", None, 1)], "model string, mae double, n int").withColumn("k", F.lit(1))
    assert metrics.select_model(m, ["k"]).first().model == "a"
    s = spark.createDataFrame([(1, "x", None, 2), (1, "y", None, 2)], "k int, model string, f1 double, n int")
    assert metrics.select_classifier(s, ["k"], "f1", ["prevalence", "x"]).first().model == "prevalence"


def outage(start, end, customers=10, planned=False, cause="unknown"):
    return ("feeder", "F1", start, end, end - start, customers, 1.0, planned, cause, False)


OUT = "level string, entity_id string, start_min long, end_min long, duration_minutes long, customers long, load_mw double, planned boolean, cause string, severe boolean"


def test_kpis(spark):
    pop = spark.createDataFrame([("feeder", "F1", 5), ("feeder", "F2", 0)], "level string, entity_id string, population long")
    k = {r.entity_id: r for r in reliability.kpis(spark.createDataFrame([outage(0, 60)], OUT), ["level", "entity_id"], pop, 120).collect()}
    one = k["F1"]
    assert (one.saifi, one.saidi_minutes, one.caidi_minutes, one.asai, one.asui, one.ctaidi_minutes, one.caifi) == (2.0, 120.0, 60.0, 0.5, 0.5, None, None)
    assert k["F2"].saifi is None and k["F2"].asai is None and k["F2"].outage_count == 0


def test_interval_union(spark):
    m = reliability.merged_minutes(spark.createDataFrame([outage(0, 60), outage(30, 90), outage(90, 100)], OUT), ["entity_id"]).first()
    assert (m.merged_minutes, m.overlap_count) == (100, 1)


def test_bands(spark):
    x = spark.createDataFrame([(34.9, 1.0), (35.1, 1.0), (80.0, 0.2)], "health_score double, completeness double")
    assert [r[0] for r in x.select(health.health_band()).collect()] == ["CRITICAL", "DEGRADED", "INSUFFICIENT_DATA"]
    assert spark.createDataFrame([(0.8,)], "score double").select(risk.band()).first()[0] == "CRITICAL"


def test_risk_reasons_default(spark):
    r = risk.reasons(spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "prior_unplanned_outage_count double, alarm_count double")).collect()
    assert r[0].reason_codes == ["RECENT_UNPLANNED_OUTAGE"] and r[1].reason_codes == ["LOW_RECENT_STRESS"]


def test_labels_and_prior(spark):
    obs = spark.createDataFrame([("f", 0), ("f", 60), ("f", 500)], "entity_id string, obs long")
    o = spark.createDataFrame([("f", 60, 120, 60, "B", False, "unknown", False), ("f", 60, 100, 40, "A", False, "equipment_failure", True), ("f", 30, 40, 10, "P", True, "unknown", False)], "entity_id string, start_min long, end_min long, duration_minutes long, outage_id string, planned boolean, cause string, severe boolean")
    got = {r.obs: (r.label, r.outage_id) for r in risk.label(obs, o, 60).collect()}
    assert got == {0: (1, "A"), 60: (0, None), 500: (0, None)}
    p = {r.obs: r for r in risk.prior_outage_features(obs, o, 480).collect()}
    assert p[500].prior_unplanned_outage_count == 2 and p[500].historical_outage_duration_minutes == 100 and p[60].days_since_previous_unplanned_outage == 999


def test_panel(spark):
    t = spark.createDataFrame([("a", 0), ("a", 60), ("a", 120), ("b", 120)], "entity_id string, ts_min long")
    got = {(r.entity_id, r.obs): r.available_history for r in risk.panel(t, t, 60, 2, 0).collect()}
    assert got == {("a", 0): 1, ("a", 60): 2, ("a", 120): 2, ("b", 120): 1}
    assert {r.obs for r in risk.panel(t, t, 60, 2, 1).collect()} == {0, 60}


def test_disjunctive_join(spark):
    a = spark.createDataFrame([("x", "f", "s"), ("y", None, "s"), ("z", "g", "t")], "asset_id string, feeder_id string, substation_id string")
    o = spark.createDataFrame([("o1", "x", "f", "s"), ("o2", "q", "g", "u")], "outage_id string, primary_asset_id string, feeder_id string, substation_id string")
    assert sorted((r.asset_id, r.outage_id, r.direct) for r in health.linked_outages(a, o).collect()) == [("x", "o1", True), ("y", "o1", False), ("z", "o2", False)]


def test_outage_evidence_like_the_pairs(spark):
    """Sums by inclusion and exclusion against the pairs themselves, with nulls on either side and outages of nobody."""
    rng = random.Random(2)
    pick = lambda n: rng.choice([None, *range(n)])
    a = spark.createDataFrame([(i, pick(3), pick(2)) for i in range(12)], "asset_id long, feeder_id long, substation_id long")
    o = spark.createDataFrame([(f"o{i}", pick(14), pick(3), pick(2), rng.random() < 0.5, rng.choice(["equipment_failure", "x"]), i, i, rng.random() < 0.5, i) for i in range(80)],
                              "outage_id string, primary_asset_id long, feeder_id long, substation_id long, planned boolean, cause string, duration_minutes long, customers long, severe boolean, start_min long")
    pairs = health.linked_outages(a, o).collect()
    for r in health.outage_evidence(a, o).collect():
        mine = [p for p in pairs if p.asset_id == r.asset_id]
        direct, around = [p for p in mine if p.direct], [p for p in mine if not p.direct]
        assert (r.direct_outage_count, r.direct_unplanned_count, r.equipment_failure_count, r.direct_minutes, r.last_direct_start) == (len(direct), sum(not p.planned for p in direct), sum(p.cause == "equipment_failure" for p in direct), sum(p.duration_minutes for p in direct), max((p.start_min for p in direct), default=None))
        assert (r.contextual_count, r.contextual_severe_count) == (len(around), sum(p.severe for p in around))


def test_ridge_and_logistic_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 1.5 + x @ [2.0, -1.0] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c), int(c > 1.5)) for (a, b), c in zip(x, y)], "a double, b double, actual double, label int")
    fit = models.fit_ridge(df, ["a", "b"])
    m = np.column_stack([np.ones(200), x])
    want = np.linalg.solve(m.T @ m + 0.01 * np.diag([0, 1, 1]), m.T @ y)
    assert np.allclose([fit.intercept, *fit.coefficients], want)
    got = models.fit_logistic(df, ["a", "b"], iterations=15, positive_weight=2.0)
    z, label = (x - x.mean(0)) / x.std(0), (y > 1.5).astype(float)
    w, b, base = np.zeros(2), 0.0, min(max(label.mean(), 0.001), 0.999)
    b = np.log(base / (1 - base))
    for _ in range(15):
        e = np.where(label == 1, 2.0, 1.0) * (1 / (1 + np.exp(-(z @ w + b))) - label)
        w, b = w - 0.05 * (z.T @ e / 200 + 0.01 * w), b - 0.05 * e.mean()
    assert np.allclose(got.coefficients, w / x.std(0)) and np.isclose(got.intercept, b - (w * x.mean(0) / x.std(0)).sum())


def test_logistic_steps_in_spark_and_numpy_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(a), int(b), None if i == 7 else int(a + b > 3)) for i, (a, b) in enumerate(rng.integers(0, 4, (80, 2)))], "a double, b int, label int")
    held = models.fit_logistic(df, ["a", "b"], iterations=5)
    monkeypatch.setattr(models, "HELD_ROWS", 3)
    jobs = models.fit_logistic(df, ["a", "b"], iterations=5)
    assert np.allclose([held.intercept, *held.coefficients], [jobs.intercept, *jobs.coefficients])


def test_curves_against_brute_force(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 10, 80) / 10
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(y, s)] + [(2, 1, 0.5)], "k int, label int, score double")
    auc = {r.k: r.roc_auc for r in metrics.roc_auc(df, ["k"]).collect()}
    pairs = [(p > q) + 0.5 * (p == q) for p in s[y == 1] for q in s[y == 0]]
    assert auc[1] == pytest.approx(np.mean(pairs)) and auc[2] is None


CONTRACT = {"dataset": "weather_data", "schema_version": "2.0.0", "format": "csv", "primary_key": ["id"], "fields": [{"name": "id", "type": "string"}, {"name": "humidity_pct", "type": "number"}, {"name": "n", "type": "integer", "required": False}, {"name": "flag", "type": "boolean", "required": False}, {"name": "at", "type": "timestamp", "required": False}, {"name": "kind", "type": "string", "required": False, "allowed_values": ["a", "b"]}, {"name": "schema_version", "type": "string"}]}


def test_typed_projection(spark):
    raw = spark.createDataFrame([("1", "50", "1_000", "YES", "2024-01-01T00:00:00Z", "a", "2.0.0", None, 0), ("2", "150", "1.0", "t", "x", "c", "1.0.0", "z", 1), (" ", "nan", None, None, "2024-13-01", None, "2.0.0", None, 2)], "id string, humidity_pct string, n string, flag string, at string, kind string, schema_version string, other string, _row int")
    got = {r._row: r for r in validation.typed(raw, CONTRACT).collect()}
    assert (got[0].n, got[0].flag, got[0].issues) == (1000, True, [])
    assert {(i.field, i.code) for i in got[1].issues} == {("humidity_pct", "VALUE_OUT_OF_RANGE"), ("n", "INVALID_DATA_TYPE"), ("flag", "INVALID_DATA_TYPE"), ("at", "INVALID_TIMESTAMP"), ("kind", "INVALID_CATEGORY"), ("schema_version", "SCHEMA_VERSION_MISMATCH"), ("other", "UNEXPECTED_FIELD")}
    assert {(i.field, i.code) for i in got[2].issues} == {("id", "REQUIRED_FIELD_MISSING"), ("humidity_pct", "INVALID_DATA_TYPE"), ("at", "INVALID_TIMESTAMP")}
    good, bad = validation.split(validation.typed(raw, CONTRACT))
    assert (good.count(), bad.count()) == (1, 2)


def test_duplicate_multiplicity(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "k string, _row int")
    assert {r._row: r.n_duplicate_issues for r in validation.duplicate_issues(d, ["k"], ["_row"]).collect()} == {1: 2, 2: 1, 3: 1, 4: 0}
    same = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), (None, 2), (None, 2)], "k string, _row int")
    assert sorted(r.n_duplicate_issues for r in validation.duplicate_issues(same, ["k"], ["_row"]).collect()) == [0, 0, 1, 1, 2]


def test_outage_chronology(spark):
    o = spark.createDataFrame([(T0, T0 + HOUR, 60, True, "planned"), (T0 + HOUR, T0, 60, False, "planned")], "outage_start timestamp, restoration_time timestamp, duration_minutes long, planned_flag boolean, outage_type string")
    got = o.select(validation.issues(*validation.chronology_issues("outage_history")).alias("i")).collect()
    assert got[0].i == [] and {x.code for x in got[1].i} == {"CHRONOLOGY_INVALID", "DERIVED_VALUE_MISMATCH"}


def test_freshness_ladder(spark):
    now = "2024-01-05 00:00:00"
    at = dt.datetime(2024, 1, 5)
    f = spark.createDataFrame([("a", at - HOUR), ("b", at - 72 * HOUR), ("c", None)], "dataset string, ts timestamp_ntz")
    got = {r.dataset: r.reason for r in monitoring.expected_datasets(monitoring.freshness(f, "dataset", "ts", now), ["a", "d"]).collect()}
    assert got == {"a": "DATA_FRESH", "b": "DATA_VERY_STALE", "c": "EVENT_TIMESTAMP_MISSING", "d": "DATASET_EMPTY"}
    got = {r.dataset: (r.status, r.severity) for r in monitoring.expected_datasets(monitoring.freshness(f, "dataset", "ts", now), ["a", "d"]).collect()}
    assert got == {"a": ("HEALTHY", "INFO"), "b": ("FAILED", "HIGH"), "c": ("DEGRADED", "WARNING"), "d": ("NOT_AVAILABLE", "WARNING")}


def test_drift_needs_a_sample(spark):
    one, two = spark.createDataFrame([(1.0, "x")], "v double, k string"), spark.createDataFrame([(1.0, "x"), (5.0, "y")], "v double, k string")
    few = monitoring.numeric_drift(one, two, ["v"], 0.5).first()
    assert (few.drift, few.drifted, few.reason) == (None, False, "INSUFFICIENT_SAMPLE_FOR_DRIFT")
    assert monitoring.categorical_drift(one, two, "k").first().reason == "INSUFFICIENT_SAMPLE_FOR_DRIFT"
    assert monitoring.numeric_drift(two, two, ["v"], 0.5).first().reason == "NO_DISTRIBUTION_DRIFT"


def test_planned_outages_are_a_reason(spark):
    k = spark.createDataFrame([(5, 0.0, 0.0, 0.0, 1.0, 3, 0, 0, 0, 0, 1, 4)], "population int, saifi double, saidi_minutes double, mean_duration double, asai double, unplanned_count int, severe_count int, equipment_count int, customer_interruptions int, prolonged_count int, planned_count int, outage_count int")
    assert reliability.reasons(k).first().reason_codes == ["REPEATED_UNPLANNED_OUTAGES", "PLANNED_OUTAGE_CONCENTRATION", "STRONG_SERVICE_AVAILABILITY"]
    assert reliability.reasons(k.withColumn("completeness", F.lit(0.4))).first().reason_codes[0] == "LOW_DATA_COMPLETENESS"


def test_quality_limits(spark):
    q = monitoring.quality(spark.createDataFrame([(10, 1, 3)], "discovered int, invalid int, warnings int")).first()
    assert q.invalid_exceeded and q.warning_exceeded


def test_keys(spark):
    d = spark.createDataFrame([("AST-1",), ("AST-1",), ("AST-2",), ("",)], "a string")
    k = [r[0] for r in d.select(surrogate_key("SK", "a")).collect()]
    assert k[0] == k[1] != k[2] and k[3] == "SK_UNKNOWN"
    assert d.select(known("a"), short_id("X", "a")).collect()[3][0] == "UNKNOWN"


def test_dimension_and_integrity(spark):
    d = mart.dimension([spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], "n string, v string")], "D", ["n"], "k", {"v": F.col("v")})
    assert sorted(rows(d.select("n", "v"))) == [("UNKNOWN", None), ("a", "y")] or {r.n for r in d.collect()} == {"a", "UNKNOWN"}
    assert mart.integrity(d, "k", ["n"], "d").first().duplicate_keys == 0


def test_safety_and_classification(spark):
    q = spark.createDataFrame([("Open this breaker now.",), ("Show the latest SAIFI for FDR-12",), ("real live status?",), (None,)], "t string")
    c = retrieval.classify(q, "t").collect()
    assert (c[0].restricted, c[0].safety_reason) == (True, "RESTRICTED_OPERATIONAL_CONTROL")
    assert (c[1].query_category, c[1].entities, c[1].time_scope) == ("reliability_performance", ["FDR-12"], "latest_repository_evidence")
    assert c[2].unsupported_current and c[2].query_category == "unsupported" and c[3].query_category == "unsupported"


def test_chunks_and_sections(spark):
    d = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "   ")], "id long, t string")
    assert [(r.id, r.chunk_index, r.chunk) for r in retrieval.chunks(d, "id", "t", 4, 1).orderBy("id", "chunk_index").collect()] == [(1, 1, "abcd"), (1, 2, "defg"), (1, 3, "ghij")]
    s = retrieval.sections(spark.createDataFrame([(1, "<p>x</p><h1>A <b>b</b></h1>c<script>h</script><h2>D</h2>e")], "id long, h string"), "id", "h")
    assert rows(s.orderBy("section").select("heading", "body")) == [("", "x"), ("A b", "c"), ("D", "e")]


def test_alert_suppression(spark):
    r = spark.createDataFrame([(1, "c", "HIGH", "FAILED", "x", 9), (2, "c", "HIGH", "FAILED", "x", 9), (3, "c", "INFO", "HEALTHY", "y", 9), (4, "d", "HIGH", "DEGRADED", "x", 1), (5, "d", "INFO", "FAILED", "COMPONENT_RUN_FAILED", None), (6, "e", "WARNING", "HEALTHY", "x", 9)],
                              "i int, component string, severity string, status string, reason_code string, sample_size int")
    got = {x.i: (x.alert_status, x.suppression_reason, x.severity) for x in monitoring.alerts(r, ["i"]).collect()}
    assert got == {1: ("TRIGGERED", None, "HIGH"), 2: ("SUPPRESSED", "DUPLICATE_ALERT_SUPPRESSED", "HIGH"), 3: ("SUPPRESSED", "INFO_ALERT_SUPPRESSED", "INFO"), 4: ("SUPPRESSED", "INSUFFICIENT_SAMPLE_SUPPRESSED", "HIGH"), 5: ("TRIGGERED", None, "CRITICAL"), 6: ("NOT_TRIGGERED", None, "WARNING")}
    assert {x.i for x in monitoring.alerts(r, ["i"], suppress=()).filter("alert_status = 'SUPPRESSED'").collect()} == set()
