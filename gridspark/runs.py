"""Runs of the models over ingested files: forecasting, outage prediction, asset health, and the reporting star schema over what all
runs left; and a run that generates raw files.

Like the runs of `pipelines`, each takes settings, writes Parquet tables and one JSON file of figures, and returns a Run. Tables have the
columns of `operators.star.SOURCES`, so that reporting reads them as they are.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import epoch_minutes
from .operators import health, metrics, models, risk, series, splits, star
from .pipelines import ConfigError, Run, finished, run_name, settings
from .sources import discovery, generator, shared, sinks


def _minutes(at: object) -> int:
    when = dt.datetime.fromisoformat(str(at))
    return int(when.replace(tzinfo=when.tzinfo or dt.UTC).timestamp()) // 60


def _read(spark: SparkSession, root: str, name: str, columns: str | None = None) -> DataFrame:
    """A dataset of an ingestion; an optional one (with columns given) may be absent, and is empty then."""
    found = shared.there(spark, f"{root}/{name}") if columns is not None else spark.read.parquet(f"{root}/{name}")
    return spark.createDataFrame([], columns) if found is None else found


def _day(at: str | Column) -> Column:
    return F.datediff(F.col(at).cast("date") if isinstance(at, str) else at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def _outages(spark: SparkSession, root: str) -> DataFrame:
    names = {"start_min": epoch_minutes("outage_start"), "planned": F.coalesce("planned_flag", F.lit(False)), "cause": F.col("cause_category"), "severe": F.coalesce("severe_weather_related", F.lit(False)), "customers": F.col("customers_interrupted")}
    rows = _read(spark, root, "outage_history").withColumns(names)
    return rows.withColumn("end_min", F.col("start_min") + F.col("duration_minutes"))


def _counts(rows: DataFrame, column: str) -> dict[str, int]:
    """How many rows have each value of a column with few of them (bands, models, codes)."""
    return {r[0]: r[1] for r in rows.groupBy(column).agg(F.count("*")).collect()}


def _told(rows: DataFrame) -> list[dict]:
    """Metrics by model and split as a run file has them; a row per model and split."""
    return [r.asDict() for r in rows.withColumnRenamed("model", "model_name").orderBy("model_name", "split").collect()]


MAINTENANCE = "asset_id string, maintenance_type string, maintenance_status string, scheduled_start timestamp, actual_start timestamp, completed_at timestamp, downtime_minutes long, maintenance_cost_gbp double, follow_up_required boolean"
SUBSTATION = "substation_id string, feeder_id string, grid_region string, event_timestamp timestamp, load_mw double, utilisation_pct double, transformer_temperature_c double, alarm_code string, operational_status string, frequency_hz double, voltage_kv double"
WEATHER = "weather_timestamp timestamp, grid_region string, temperature_c double, humidity_pct double, wind_speed_mps double, wind_gust_mps double, precipitation_mm double, pressure_hpa double, severe_weather_flag boolean"
#: How much a tier matters.
CRITICALITY = {"tier_1": 3, "tier_2": 2, "tier_3": 1}
HEALTH = {"included_asset_types": [], "missing_data_policy": "neutral", "minimum_data_completeness": 0.4, "lookback_days": 365, "max_reason_codes": 5}


def run_asset_health(spark: SparkSession, config: dict | str, run_id: str | None = None) -> Run:
    """Score, band, reasons and maintenance priority of every asset. Maintenance and telemetry may be absent.

    config: interim_root, output_root, now (a timestamp), and HEALTH's other settings. An asset that repeats an id, or whose life isn't
    positive, ends the run as FAILED_ASSET_HEALTH_INPUT.
    """
    c = settings(config, ("interim_root", "output_root", "now"), HEALTH)
    if c["missing_data_policy"] not in health.MISSING:
        raise ConfigError(f"missing_data_policy: {c['missing_data_policy']}")
    run, col = Run("asset_health", run_name(run_id), "COMPLETED"), F.col
    now, back = _minutes(c["now"]), c["lookback_days"] * 1440
    inventory = _read(spark, c["interim_root"], "asset_inventory")
    tier = F.coalesce(reduce(lambda e, kv: F.when(col("criticality_tier") == kv[0], kv[1]).otherwise(e), CRITICALITY.items(), F.lit(None)), F.lit(1))
    assets = inventory.select("asset_id", "asset_type", "grid_region", "substation_id", "feeder_id", "operational_status", "criticality_tier", "expected_life_years", tier.alias("criticality"), _day("commissioned_date").alias("commissioned_day"),
                              _day("last_inspection_date").alias("last_inspection_day"), _day("next_inspection_due").alias("next_due_day"))
    try:
        assets = health.population(assets, c["included_asset_types"], now // 1440)
    except ValueError as e:
        run.status, run.found = "FAILED_ASSET_HEALTH_INPUT", [("asset_inventory", str(e))]
        return finished(run, c["output_root"], {})
    logs = _read(spark, c["interim_root"], "maintenance_logs", MAINTENANCE)
    logs = logs.select("asset_id", _day(F.coalesce("completed_at", "actual_start", "scheduled_start")).alias("day"), "maintenance_type", "maintenance_status", "downtime_minutes", col("maintenance_cost_gbp").alias("cost"), F.coalesce("follow_up_required", F.lit(False)).alias("follow_up"))
    in_reach = (col("ts_min") <= now) & (col("ts_min") >= now - back)
    told = _read(spark, c["interim_root"], "substation_events", SUBSTATION).withColumn("ts_min", epoch_minutes("event_timestamp")).filter(in_reach)
    cuts = _outages(spark, c["interim_root"]).filter((col("start_min") <= now) & (col("start_min") >= now - back)).select("outage_id", "primary_asset_id", "feeder_id", "substation_id", "start_min", "duration_minutes", "planned", "cause", "severe", "customers", F.lit(None).cast("string").alias("asset_id"))
    rows = health.outage_evidence(health.telemetry_evidence(health.maintenance_evidence(assets, logs, now // 1440, c["lookback_days"]), told), cuts)
    rows = health.component_scores(rows, now // 1440, c["missing_data_policy"]).withColumn("health_band", health.health_band(least=c["minimum_data_completeness"]))
    rows = health.priority(health.reasons(rows, now // 1440, c["max_reason_codes"]))
    parts = {"age": "age_component_score", "inspection": "inspection_component_score", "maintenance": "maintenance_component_score", "telemetry": "telemetry_stress_component_score", "alarm": "alarm_component_score", "outage": "outage_component_score"}
    at = F.lit(str(c["now"]))
    scores = rows.select(F.lit(run.run_id).alias("asset_health_run_id"), "asset_id", "asset_type", "grid_region", "criticality_tier", at.alias("assessment_timestamp"), "health_score", "health_band", "maintenance_priority", col("completeness").alias("data_completeness_ratio"),
                         *[col(f"{k}_score").alias(v) for k, v in parts.items()], F.get("reason_codes", F.lit(0)).alias("primary_reason_code"), F.concat_ws("|", "reason_codes").alias("reason_codes"), (col("inspection_overdue_days") > 0).alias("inspection_overdue"), "priority_reasons")
    run.paths = {n: f"{c['output_root']}/{n}" for n in ("health", "priorities")}
    sinks.write_parquet(scores, run.paths["health"])
    scores = spark.read.parquet(run.paths["health"])
    sinks.write_parquet(scores.select("asset_health_run_id", "asset_id", col("maintenance_priority").alias("priority"), "health_band", "criticality_tier", col("primary_reason_code").alias("primary_reason"), col("maintenance_priority").isin(*health.PRIORITIES[:2]).alias("review_recommended"), F.concat_ws("|", "priority_reasons").alias("priority_reasons")), run.paths["priorities"])
    whole = scores.agg(F.count("*").alias("assets_scored"), F.avg("health_score").alias("mean"), F.min("health_score").alias("minimum"), F.max("health_score").alias("maximum"), F.coalesce(F.count_if("inspection_overdue"), F.lit(0)).alias("overdue_inspection_count"), *[F.avg(v).alias(v) for v in parts.values()]).first().asDict()
    run.counts = {"counts_by_health_band": _counts(scores, "health_band"), "counts_by_priority": _counts(scores, "maintenance_priority"), "counts_by_asset_type": _counts(scores, "asset_type"),
                  "reason_code_counts": _counts(scores.select(F.explode(F.split("reason_codes", r"\|")).alias("r")).filter("r <> ''"), "r")}
    return finished(run, c["output_root"], {"fleet": whole, "assets_discovered": inventory.count(), "assets_scored": whole["assets_scored"], "insufficient_data_assets": run.counts["counts_by_health_band"].get("INSUFFICIENT_DATA", 0), "assessment_timestamp": str(c["now"])})


FORECASTING = {"target_source": "smart_meter_events", "target_column": "active_energy_kwh", "aggregation_level": "grid_region", "timestamp_frequency_minutes": 60, "forecast_horizons": [1], "minimum_history_intervals": 6, "validation_intervals": 1, "test_intervals": 1, "backtest_folds": 1,
               "include_weather_features": True, "lag_intervals": [1], "rolling_windows": [2], "candidate_models": ["persistence", "moving_average", "autoregressive_linear"], "selection_metric": "mae", "missing_interval_policy": "drop", "missing_interval_limit": 2, "prediction_interval_level": 0.8}
#: The season of the seasonal model in steps, and the unit of each target.
SEASON, UNITS = 24, {"active_energy_kwh": "kWh"}
KINDS = {"grid_region": "grid_region", "substation_id": "substation", "feeder_id": "feeder", "meter_id": "meter"}


def run_forecasting(spark: SparkSession, config: dict | str, run_id: str | None = None) -> Run:
    """Fits the candidates on all but the last forecast times, predicts validation and test with intervals, selects by validation, and
    backtests the selected one.

    config: interim_root, output_root, and FORECASTING's other settings; aggregation_level is a column of the source. A candidate that
    can't be fitted or lacks its lag is left out and named in `found`; too short a history ends the run as FAILED_FORECASTING_INPUT.
    """
    c = settings(config, ("interim_root", "output_root"), FORECASTING)
    if unknown := set(c["candidate_models"]) - {"persistence", "moving_average", "seasonal_naive", "autoregressive_linear"}:
        raise ConfigError(f"candidate_models: {sorted(unknown)}")
    if c["aggregation_level"] not in KINDS:
        raise ConfigError(f"aggregation_level: {c['aggregation_level']}")
    run, col = Run("forecasting", run_name(run_id), "COMPLETED", paths={n: f"{c['output_root']}/{n}" for n in ("features", "forecasts", "comparison")}), F.col
    step, level = c["timestamp_frequency_minutes"], c["aggregation_level"]
    source = _read(spark, c["interim_root"], c["target_source"]).withColumn("ts", col("event_timestamp").cast("timestamp_ntz"))
    member = "meter_id" if "meter_id" in source.columns else "feeder_id"
    points = series.hourly(source, level, c["target_column"], member, first={} if level == "grid_region" else {"grid_region": "grid_region"})
    points = points if "grid_region" in points.columns else points.withColumn("grid_region", col("entity_id"))
    points = series.coverage(series.filled(points, c["missing_interval_policy"], c["missing_interval_limit"], step))
    lags, windows = tuple(c["lag_intervals"]), tuple(c["rolling_windows"])
    rows = series.with_calendar(series.with_horizons(series.lag_rolling(points, lags, windows), points, tuple(c["forecast_horizons"]), step))
    kinds = [col("entity_id")]
    if c["include_weather_features"]:
        seen = _read(spark, c["interim_root"], "weather_data", WEATHER).select("grid_region", col("weather_timestamp").cast("timestamp_ntz").alias("ts"), *risk.WEATHER).withColumn("_order", F.hash(*risk.WEATHER))
        rows = series.with_weather(rows, seen, ["grid_region", "ts"], "_order")
    sinks.write_parquet(splits.chronological(rows, c["validation_intervals"], c["test_intervals"], "forecast_ts"), run.paths["features"])
    rows = spark.read.parquet(run.paths["features"])
    parts = _counts(rows, "split")
    try:
        series.history_gate(points, c["minimum_history_intervals"])
        if absent := [s for s in ("train", "validation", "test") if not parts.get(s)]:
            raise ValueError(f"no rows for {absent}")
    except ValueError as e:
        run.status, run.found = "FAILED_FORECASTING_INPUT", [(c["target_source"], str(e))]
        return finished(run, c["output_root"], {"rows": parts})
    keep = {"entity_id", "forecast_ts", "ts", "grid_region", "imputed", "horizon", "actual", "split"}
    names = sorted(set(rows.columns) - keep)
    fits = {"persistence": lambda _: models.persistence, "moving_average": lambda _: models.moving_average(min(windows, default=2)), "seasonal_naive": lambda _: models.seasonal_naive(SEASON), "autoregressive_linear": lambda train: models.fit_ridge(train, names).forecast}
    needs = {"persistence": 1, "seasonal_naive": SEASON}
    fitted = {}
    for name in c["candidate_models"]:
        if needs.get(name, lags[0]) not in lags or name == "moving_average" and not windows:
            run.found.append((name, "its lag or window isn't configured"))
            continue
        try:
            fitted[name] = fits[name](rows.filter("split = 'train'"))
        except (ValueError, ArithmeticError) as e:
            run.found.append((name, str(e)))
    if not fitted:
        run.status = "FAILED_FORECASTING_MODELS"
        return finished(run, c["output_root"], {"rows": parts})
    tail = (1 - c["prediction_interval_level"]) / 2
    with_bounds = lambda all_rows, train: metrics.intervals(all_rows, metrics.nearest_rank(train.withColumn("residual", col("actual") - col("predicted")), ["model"], "residual", {"q_lo": tail, "q_hi": 1 - tail}), ["model"])
    predicted = models.scored(rows, fitted)
    out = with_bounds(predicted.filter("split <> 'train'"), predicted.filter("split = 'train'"))
    by_entity = metrics.forecast(out, ["model", "split", "entity_id", "horizon"])
    overall = metrics.overall(by_entity, ["model", "split"]).filter("split = 'validation'").withColumn("value", F.abs(c["selection_metric"]))
    best = overall.filter("value IS NOT NULL").agg(F.min(F.struct("value", "model")).alias("b")).select("b.*").first()
    if best.model is None:
        run.status = "FAILED_FORECASTING_MODELS"
        return finished(run, c["output_root"], {"rows": parts})
    folds = []
    for (cut,) in rows.filter("split <> 'train'").select("ts").distinct().orderBy(col("ts").desc()).limit(c["backtest_folds"]).collect()[::-1]:  # as many as folds
        past, now = rows.filter(col("forecast_ts") <= F.lit(cut)), rows.filter(col("ts") == F.lit(cut))
        fit, name = fits[best.model](past), f"{best.model}_backtest_fold_{len(folds) + 1}"
        tell = lambda r, fit=fit, name=name: fit(r).withColumn("model", F.lit(name))
        folds.append(with_bounds(tell(now), tell(past)).withColumn("split", F.lit(f"backtest_cutoff_{cut.isoformat()}")))
    told = reduce(DataFrame.unionByName, [out, *folds])
    iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    sinks.write_parquet(told.select(F.lit(run.run_id).alias("forecast_run_id"), F.lit(KINDS[level]).alias("entity_type"), *kinds, "grid_region", col("model").alias("model_name"), F.lit(c["target_column"]).alias("target_name"), F.lit(UNITS.get(c["target_column"], "MW")).alias("target_unit"), iso("ts").alias("forecast_origin"), iso("forecast_ts").alias("forecast_timestamp"),
                                    col("horizon").alias("forecast_horizon_intervals"), col("predicted").alias("predicted_value"), col("lower").alias("prediction_lower"), col("upper").alias("prediction_upper"), col("actual").alias("actual_value"), col("split").alias("data_split")), run.paths["forecasts"])
    again = spark.read.parquet(run.paths["forecasts"]).withColumnsRenamed({"model_name": "model", "data_split": "split", "forecast_horizon_intervals": "horizon", "actual_value": "actual", "predicted_value": "predicted", "prediction_lower": "lower", "prediction_upper": "upper"})
    sinks.write_parquet(metrics.forecast(again, ["model", "split", "entity_id", "horizon"]), run.paths["comparison"])
    base = overall.filter("model = 'persistence'").select("value").first()
    run.counts = {"rows": parts, "predictions": _counts(again, "model")}
    return finished(run, c["output_root"], {"selected_model": best.model, "selected_value": best.value, "baseline_value": base and base.value, "beats_baseline": bool(base and base.value is not None and best.value < base.value), "features": names,
                                                "output_records": sum(run.counts["predictions"].values()), "metrics": _told(metrics.overall(by_entity, ["model", "split"]))})


OUTAGE = {"observation_frequency_minutes": 60, "prediction_horizon_intervals": 1, "feature_lookback_intervals": 2, "minimum_history_intervals": 1, "validation_intervals": 1, "test_intervals": 1, "selection_metric": "f1", "positive_class_weight": 3.0, "classification_threshold": 0.5,
          "minimum_positive_examples": 1, "minimum_negative_examples": 1, "minimum_data_completeness": 0.0, "max_reason_codes": 5, "prior_outage_days": 365, "candidate_models": ["prevalence", "recent_outage_heuristic", "operational_warning_heuristic", "logistic_regression"]}


def run_outage_prediction(spark: SparkSession, config: dict | str, run_id: str | None = None) -> Run:
    """Risk of an unplanned outage per feeder and tick: features without a look ahead, purged splits, four candidates, selection by
    validation, bands and reasons.

    config: interim_root, output_root, and OUTAGE's other settings. Weather, meters and maintenance may be absent. Too few examples of
    a class end the run as FAILED_OUTAGE_INPUT; a candidate that can't be fitted is left out and named in `found`.
    """
    c = settings(config, ("interim_root", "output_root"), OUTAGE)
    run, col, root = Run("outage_prediction", run_name(run_id), "COMPLETED", paths={n: f"{c['output_root']}/{n}" for n in ("panel", "outage_risk", "comparison")}), F.col, c["interim_root"]
    step, look, ahead = c["observation_frequency_minutes"], c["feature_lookback_intervals"], c["prediction_horizon_intervals"]
    if look < 1:
        raise ConfigError("feature_lookback_intervals is under 1")
    # Observations of the tick itself are one interval; the joins take windows of a minute at least.
    reach = max(step * (look - 1), 1)
    told = _read(spark, root, "substation_events").withColumns({"entity_id": col("feeder_id"), "ts_min": epoch_minutes("event_timestamp")})
    places = told.groupBy("entity_id").agg(F.max(F.struct("grid_region", "substation_id")).alias("_p")).select("entity_id", "_p.*")
    cuts = _outages(spark, root).withColumn("entity_id", col("feeder_id"))
    rows = risk.label(risk.panel(places, told, step, look, ahead, c["minimum_history_intervals"]), cuts, ahead * step)
    rows = rows.join(places, "entity_id")
    rows = risk.telemetry_features(rows, told.select("entity_id", "ts_min", "load_mw", "utilisation_pct", "transformer_temperature_c", "alarm_code", "operational_status", "frequency_hz", "voltage_kv"), reach)
    rows = risk.weather_features(rows, _read(spark, root, "weather_data", WEATHER).withColumn("ts_min", epoch_minutes("weather_timestamp")).select("grid_region", "ts_min", *risk.WEATHER, "severe_weather_flag"), reach)
    meters = _read(spark, root, "smart_meter_events", "event_id string, meter_id string, feeder_id string, event_timestamp timestamp, active_energy_kwh double, quality_code string, voltage_v double")
    rows = risk.meter_features(rows, meters.select(col("feeder_id").alias("entity_id"), epoch_minutes("event_timestamp").alias("ts_min"), "event_id", "meter_id", "active_energy_kwh", "quality_code", "voltage_v"), reach)
    assets = _read(spark, root, "asset_inventory")
    bridge = assets.filter("feeder_id IS NOT NULL").select(col("feeder_id").alias("entity_id"), "asset_id")
    logs = _read(spark, root, "maintenance_logs", MAINTENANCE).withColumn("ts_min", epoch_minutes(F.coalesce("completed_at", "actual_start", "scheduled_start")))
    rows = risk.maintenance_features(rows, bridge, logs.select("asset_id", "ts_min", "maintenance_type", "maintenance_status", "follow_up_required", "downtime_minutes"), c["prior_outage_days"] * 1440)
    rows = risk.prior_outage_features(rows, cuts.select("entity_id", "start_min", "end_min", "planned", "cause", "severe", "duration_minutes"), c["prior_outage_days"] * 1440)
    rows = risk.asset_features(rows, bridge, assets.select("asset_id", "expected_life_years", "criticality_tier", "operational_status", _day("commissioned_date").alias("commissioned_day"), _day("next_inspection_due").alias("due_day")))
    at = lambda m: F.timestamp_seconds(m * 60).cast("timestamp_ntz")
    rows = rows.withColumns({"ts": at(col("obs")), "end": at(col("label_end"))})
    sinks.write_parquet(splits.purged(rows, c["validation_intervals"], c["test_intervals"], ahead, step, "ts", "end"), run.paths["panel"])
    rows = spark.read.parquet(run.paths["panel"])
    classes = {(r["split"], r["label"]): r["n"] for r in rows.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    n = lambda y: sum(v for (_, label), v in classes.items() if label == y)
    lacking = [s for s in ("train", "validation", "test") if not any(k[0] == s for k in classes)]
    if lacking or n(1) < c["minimum_positive_examples"] or n(0) < c["minimum_negative_examples"]:
        run.status, run.found = "FAILED_OUTAGE_INPUT", [("panel", f"{n(1)} positive and {n(0)} negative rows; none for {lacking}")]
        return finished(run, c["output_root"], {})
    apart = {"entity_id", "obs", "label", "outage_id", "label_end", "grid_region", "substation_id", "ts", "end", "split"}
    names = [x for x in sorted(rows.columns) if x not in apart]
    fits = {"prevalence": models.prevalence, "recent_outage_heuristic": lambda _: models.recent_outage, "operational_warning_heuristic": lambda _: models.operational_warning, "logistic_regression": lambda train: models.fit_logistic(train, names, positive_weight=c["positive_class_weight"]).probability}
    if unknown := set(c["candidate_models"]) - set(fits):
        raise ConfigError(f"candidate_models: {sorted(unknown)}")
    fitted = {}
    for name in c["candidate_models"]:
        try:
            fitted[name] = fits[name](rows.filter("split = 'train'"))
        except (ValueError, ArithmeticError) as e:
            run.found.append((name, str(e)))
    if not fitted:
        run.status = "FAILED_OUTAGE_MODELS"
        return finished(run, c["output_root"], {})
    cut = c["classification_threshold"]
    told = models.scored(risk.reasons(rows, c["max_reason_codes"]), fitted).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    told = told.withColumn("risk_band", risk.band("score", "completeness", c["minimum_data_completeness"]))
    sinks.write_parquet(told.select(F.lit(run.run_id).alias("outage_prediction_run_id"), F.lit("feeder").alias("entity_type"), "entity_id", "grid_region", "substation_id", col("entity_id").alias("feeder_id"), col("model").alias("model_name"), col("ts").alias("observation_timestamp"), col("ts").alias("prediction_window_start"), col("end").alias("prediction_window_end"),
                                    col("score").alias("risk_score"), "risk_band", (col("score") >= cut).alias("predicted_outage_flag"), col("label").alias("actual_outage_flag"), F.lit(cut).alias("classification_threshold"), col("split").alias("data_split"), col("completeness").alias("data_completeness_ratio"), F.get("reason_codes", F.lit(0)).alias("primary_reason_code"), F.concat_ws("|", "reason_codes").alias("reason_codes")), run.paths["outage_risk"])
    again = spark.read.parquet(run.paths["outage_risk"]).withColumnsRenamed({"model_name": "model", "data_split": "split", "actual_outage_flag": "label", "risk_score": "score"})
    found = metrics.confusion(again, ["model", "split"], threshold=cut).join(metrics.probabilistic(again, ["model", "split"]), ["model", "split"])
    sinks.write_parquet(found, run.paths["comparison"])
    compared = spark.read.parquet(run.paths["comparison"])
    best = metrics.select_classifier(compared.filter("split = 'validation'"), [], c["selection_metric"], list(fitted)).first()
    chosen = again.filter(col("model") == best.model)
    run.counts = {"risk_band_counts": _counts(chosen, "risk_band"), "rows": _counts(rows, "split"), "reason_code_counts": _counts(chosen.select(F.explode(F.split("reason_codes", r"\|")).alias("r")), "r")}
    return finished(run, c["output_root"], {"selected_model": best.model, "selected_value": best.value, "positive": n(1), "negative": n(0), "features": names,
                                                "output_records": sum(run.counts["risk_band_counts"].values()), "metrics": _told(compared.withColumnRenamed("brier", "brier_score").withColumn("positive_count", col("tp") + col("fn")))})


REPORTING = {"sources": {}, "roots": [], "runs": [], "date_dimension_start": "2024-01-01", "date_dimension_end": "2027-12-31"}


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of any file system: CSV with a header and JSON lines by their ending, else Parquet; None where there is nothing."""
    ending = path.rstrip("/").rpartition(".")[2]
    if ending == "csv":
        try:
            return spark.read.option("header", True).csv(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
    return shared.there(spark, path, "json" if ending in ("json", "jsonl") else "parquet")


def found_sources(spark: SparkSession, roots: list[str]) -> dict[str, list[DataFrame]]:
    """Tables below the roots that have the name of a source."""
    out: dict[str, list[DataFrame]] = {}
    for root in roots:  # a few folders, and as many names as there are sources
        for name in star.SOURCES:
            if name != "runs" and (df := shared.there(spark, f"{root}/{name}")) is not None:
                out.setdefault(name, []).append(df)
    return out


def run_reporting(spark: SparkSession, config: dict | str, run_id: str | None = None) -> Run:
    """Writes the star schema over the tables that other runs left, with its checks, measures and KPIs.

    config: output_root, and what to report: roots (output folders of runs, in which tables are found by their source's name and runs by
    their JSON files), sources ({name of a source: path or paths, Parquet, .csv or .jsonl}) and runs (JSON files or folders of them);
    and the ends of the date dimension. A table that is named in sources and isn't there is an error; any other absent source is empty.
    Repeated keys or keys without their dimension end the run as FAILED_RELATIONSHIPS; the tables are there to look at.
    """
    c = settings(config, ("output_root",), REPORTING)
    if unknown := set(c["sources"]) - set(star.SOURCES):
        raise ConfigError(f"sources: {sorted(unknown)}")
    if not c["sources"] and not c["roots"]:
        raise ConfigError("neither sources nor roots are given")
    run = Run("reporting", run_name(run_id), "COMPLETED")
    parts = found_sources(spark, c["roots"])
    for name, paths in c["sources"].items():
        for path in [paths] if isinstance(paths, str) else paths:
            if (df := load(spark, path)) is None:
                raise FileNotFoundError(path)
            parts.setdefault(name, []).append(df)
    given = {n: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs) for n, dfs in parts.items()}
    if c["roots"] or c["runs"]:
        told = discovery.as_source(discovery.component_runs(discovery.documents(spark, [*c["roots"], *c["runs"]])))
        given["runs"] = shared.written(given["runs"].unionByName(told, allowMissingColumns=True) if "runs" in given else told)
    tables = star.build(spark, given, str(c["date_dimension_start"]), str(c["date_dimension_end"]))
    for name, df in tables.items():
        run.paths[name] = f"{c['output_root']}/{name}"
        sinks.write_parquet(df, run.paths[name])
    tables = {n: spark.read.parquet(run.paths[n]) for n in tables}
    for name, df in (("relationships", star.relationships(tables)), ("checks", star.checks(tables)), ("measures", star.measures(tables)), ("kpis", star.kpis(tables))):
        run.paths[name] = f"{c['output_root']}/_{name}"
        sinks.write_parquet(df, run.paths[name])
    run.found = [(f"{r.from_table}.{r.from_column}", f"{r.orphans} keys aren't in {r.to_table}") for r in spark.read.parquet(run.paths["relationships"]).filter("orphans > 0").collect()]
    seen = spark.read.parquet(run.paths["checks"]).collect()  # one row a table
    run.found += [(r.table, f"{r.duplicate_keys} repeated keys") for r in seen if r.duplicate_keys]
    run.counts = {r.table: {"rows": r.rows, "unknown_members": r.unknown_members, "null_critical": r.null_critical} for r in seen}
    if run.found:
        run.status = "FAILED_RELATIONSHIPS"
    figures = {"measures": {r["name"]: r["value"] for r in spark.read.parquet(run.paths["measures"]).collect()}, "kpis": {r.kpi_id: r.value for r in spark.read.parquet(run.paths["kpis"]).collect()}}
    return finished(run, c["output_root"], figures)


GENERATION = {"regions": 5, "substations": 2, "feeders": 2, "meters": 8, "step_minutes": 60, "seed": 42}


def run_generation(spark: SparkSession, config: dict | str, run_id: str | None = None) -> Run:
    """Writes the six raw datasets of a synthetic network as Parquet; every value follows from its key and the seed.

    config: output_root, start and end (timestamps), and GENERATION's sizes.
    """
    c = settings(config, ("output_root", "start", "end"), GENERATION)
    start, end = (str(c[k]).replace("T", " ").rstrip("Z") for k in ("start", "end"))
    hours = (_minutes(end) - _minutes(start)) // 60
    if hours < 1:
        raise ConfigError("the end isn't an hour after the start")
    run = Run("data_generation", run_name(run_id), "COMPLETED")
    net = generator.network(spark, *(c[k] for k in ("regions", "substations", "feeders", "meters")))
    assets = generator.assets(net, start[:10], c["seed"])
    made = {
        "smart_meter_events": generator.smart_meter_events(spark, net, start, end, c["step_minutes"], c["seed"]), "substation_events": generator.substation_events(spark, net, start, end, c["step_minutes"], c["seed"]), "weather_data": generator.weather(spark, start, end, c["regions"], c["step_minutes"], c["seed"]),
        "asset_inventory": assets, "maintenance_logs": generator.maintenance(assets, start, c["seed"]), "outage_history": generator.outages(net, assets, start, hours, c["seed"])}
    for name, df in made.items():
        run.paths[name] = f"{c['output_root']}/{name}"
        sinks.write_parquet(df, run.paths[name])
        run.counts[name] = {"records": spark.read.parquet(run.paths[name]).count()}
    return finished(run, c["output_root"], {"seed": c["seed"]})


RUNS = {"asset_health": run_asset_health, "forecasting": run_forecasting, "outage_prediction": run_outage_prediction, "reporting": run_reporting, "data_generation": run_generation}
