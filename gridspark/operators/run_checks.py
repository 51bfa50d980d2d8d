"""Monitoring records of runs, datasets, schemas and distributions, in the columns that the star schema reads.

A record says what was measured (component, run, scope, metric, value, unit), against what (baseline, threshold), and what follows
(status, severity, reason code, sample size). Eight families: pipeline health, freshness, volume, quality, schema drift, distribution
drift, model health, analytical health.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from . import monitoring, star

#: Columns of a record after the monitoring run's id.
RECORD = star.SOURCES["checks"][1:]
#: Fixed values: (metric, how it breaks its limit, usual limit, reason code) by component, and what a lack of metrics is called.
MODEL_RULES = {
    "forecasting": (("mae", "max", 500.0, "FORECAST_MAE_HIGH"), ("wape", "max", 0.5, "FORECAST_WAPE_HIGH"), ("bias", "abs", 200.0, "FORECAST_BIAS_HIGH")),
    "outage_prediction": (("precision", "min", 0.2, "OUTAGE_PRECISION_LOW"), ("recall", "min", 0.2, "OUTAGE_RECALL_LOW"), ("brier_score", "max", 0.4, "OUTAGE_BRIER_HIGH")),
}
NO_METRICS = {"forecasting": ("forecast_metrics", "FORECAST_SAMPLE_TOO_SMALL"), "outage_prediction": ("outage_metrics", "OUTAGE_SAMPLE_TOO_SMALL")}
#: The score and the band that are compared with a baseline, by component.
DISTRIBUTIONS = {"asset_health": ("health_score", "health_band"), "outage_prediction": ("risk_score", "risk_band"), "reliability": ("reliability_score", "reliability_band")}
#: Limits of the analytical checks.
INSUFFICIENT, COVERED = 0.25, 0.8
CHANGES = {"ADDED_REQUIRED": "field_added", "ADDED_OPTIONAL": "field_added", "REMOVED": "field_removed"}


def record(rows: DataFrame, **what: Column | str | float | None) -> DataFrame:
    """Rows as records: each column by name; texts that aren't columns of `rows` are taken as they are."""
    def column(name: str) -> Column:
        v = what.get(name)
        c = v if isinstance(v, Column) else F.col(v) if isinstance(v, str) and v in rows.columns else F.lit(v)
        return c.cast("long" if name == "sample_size" else "string").alias(name)

    if unknown := set(what) - set(RECORD):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return rows.select(*map(column, RECORD))


def none(spark: SparkSession) -> DataFrame:
    return record(spark.range(0).select(F.lit(0).alias("_")))


def pipeline_health(runs: DataFrame, required: list[str]) -> DataFrame:
    """A record per run of discovery.component_runs; a required component without a run has failed."""
    status, is_required = F.upper("run_status"), F.col("component_name").isin(required)
    absent = ~F.col("malformed") & (status == "NOT_AVAILABLE")
    failed = ~F.col("malformed") & ~absent & status.contains("FAILED")
    well = ~F.col("malformed") & ~absent & ~failed
    warned, twice = well & status.contains("WARNING"), F.col("copies") > 1
    lost = absent & is_required
    rules = [(F.col("malformed"), "MALFORMED_JSON"), (absent, "COMPONENT_NOT_AVAILABLE"), (failed, "COMPONENT_RUN_FAILED"), (warned, "COMPONENT_RUN_WARNING"), (twice, "DUPLICATE_RUN_ID"), (lost, "MISSING_REQUIRED_COMPONENT")]
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules])), "|")
    bad = F.col("malformed") | failed
    state = (F.when(lost, "FAILED").when(twice, "DEGRADED").when(bad, "FAILED").when(absent, "NOT_AVAILABLE").when(warned, "HEALTHY_WITH_WARNINGS").otherwise("HEALTHY"))
    severity = F.when(lost, "CRITICAL").when(twice, "WARNING").when(bad, "CRITICAL").otherwise("INFO")
    return record(runs, component_name="component_name", source_run_id="source_run_id", scope_type="run", scope_id="source_run_id", monitor_type="pipeline_health", metric_name=F.lit("run_status"), metric_value="run_status",
                  metric_unit="status", threshold="component must complete", status=state, severity=severity, reason_code=F.when(reasons == "", "COMPONENT_HEALTHY").otherwise(reasons), sample_size="output_records")


def freshness(found: DataFrame, limits: Column) -> DataFrame:
    """Records of monitoring.freshness, by dataset."""
    return record(found, component_name="ingestion", source_run_id="current-datasets", scope_type="dataset", scope_id="dataset", monitor_type="data_freshness", metric_name="freshness_age_minutes", metric_value="age_minutes",
                  metric_unit="minutes", threshold=limits, status="status", severity="severity", reason_code=F.col("reason"), sample_size="n")


def volume(found: DataFrame, least: Column, most: Column) -> DataFrame:
    """Records of (dataset, n, baseline); reason codes are fixed values."""
    delta = ratio(F.col("n") - F.col("baseline"), F.col("baseline"))
    reason = (F.when(F.col("n") < least, "BELOW_MINIMUM_VOLUME").when(F.col("n") > most, "ABOVE_MAXIMUM_VOLUME").when(F.col("baseline").isNull(), "NO_BASELINE_AVAILABLE")
              .when(delta <= -0.5, "VOLUME_DROP").when(delta >= 0.5, "VOLUME_SPIKE").otherwise("VOLUME_WITHIN_EXPECTATION"))
    well = F.col("_r").isin("NO_BASELINE_AVAILABLE", "VOLUME_WITHIN_EXPECTATION")
    return record(found.withColumn("_r", reason), component_name="ingestion", source_run_id="current-datasets", scope_type="dataset", scope_id="dataset", monitor_type="data_volume", metric_name="record_count", metric_value="n",
                  metric_unit="records", baseline_value="baseline", threshold=F.concat_ws("-", least, most), status=F.when(well, "HEALTHY").otherwise("DEGRADED"), severity=F.when(well, "INFO").otherwise("WARNING"), reason_code="_r", sample_size="n")


def quality(runs: DataFrame, invalid_limit: float, warning_limit: float) -> DataFrame:
    """Two records per ingestion run: its rates of invalid rows and of warnings."""
    own = runs.filter((F.col("component_name") == "ingestion") & (F.col("documents") > 0))
    found = F.coalesce("input_records", F.lit(0))
    both = []
    for name, count, limit, reason in (("invalid_record_rate", "invalid_records", invalid_limit, "ERROR_RATE_THRESHOLD_EXCEEDED"), ("warning_record_rate", "warning_records", warning_limit, "WARNING_RATE_THRESHOLD_EXCEEDED")):
        rated = own.withColumn("_v", ratio(F.coalesce(count, F.lit(0)), found))
        bad = F.coalesce(F.col("_v") > limit, F.lit(False))
        state = F.when(F.col("_v").isNull(), "NOT_AVAILABLE").when(bad, "DEGRADED").otherwise("HEALTHY")
        code = F.when(F.col("_v").isNull(), "METRIC_UNAVAILABLE").when(bad, reason).otherwise("QUALITY_STABLE")
        both.append(record(rated, component_name="ingestion", source_run_id="source_run_id", scope_type="component", scope_id="overall", monitor_type="data_quality", metric_name=name, metric_value="_v", metric_unit="ratio",
                           threshold=limit, status=state, severity=F.when(bad, "WARNING").otherwise("INFO"), reason_code=code, sample_size=found))
    return reduce(DataFrame.unionByName, both)


def contract_fields(spark: SparkSession, contracts: dict[str, dict]) -> DataFrame:
    """(dataset, field, type, required): one row per field; the version is a field of its own."""
    rows = [(d, f["name"], "|".join([f["type"], *map(str, f.get("allowed_values") or [])]), bool(f.get("required"))) for d, c in contracts.items() for f in c["fields"]]
    rows += [(d, "__schema_version__", str(c.get("schema_version")), False) for d, c in contracts.items()]
    return spark.createDataFrame(rows, "dataset string, field string, type string, required boolean")


def schema_drift(spark: SparkSession, old: dict[str, dict], new: dict[str, dict]) -> DataFrame:
    """A record per changed field of a contract, one for a contract without changes, one for a contract without a baseline."""
    known = {d: c for d, c in new.items() if d in old}
    diff = monitoring.schema_diff(contract_fields(spark, {d: old[d] for d in known}), contract_fields(spark, known), ["dataset"])
    version = F.col("field") == "__schema_version__"
    change = F.when(version, "version_changed").otherwise(F.coalesce(*[F.when(F.col("change") == k, v) for k, v in CHANGES.items()], F.lit("field_changed")))
    mild = version | (F.col("change") == "ADDED_OPTIONAL")
    severity = F.when(mild, "INFO").when(F.col("change") == "ADDED_REQUIRED", "WARNING").otherwise("HIGH")
    usual = dict(component_name="ingestion", source_run_id="contracts", scope_type="dataset", scope_id="dataset", monitor_type="schema_drift", metric_unit="schema_change")
    changed = record(diff, **usual, metric_name="field", metric_value=change, status="DEGRADED", severity=severity, reason_code=F.when(mild, "NON_BREAKING_SCHEMA_DRIFT").otherwise("BREAKING_SCHEMA_DRIFT"))
    names = spark.createDataFrame([(d, d in old) for d in new], "dataset string, has boolean").join(diff.select("dataset").distinct(), "dataset", "left_anti")
    still = record(names, **usual, metric_name="__schema__", metric_value=F.when(F.col("has"), "no_change").otherwise("baseline"), status=F.when(F.col("has"), "HEALTHY").otherwise("NOT_AVAILABLE"), severity="INFO",
                   reason_code=F.when(F.col("has"), "NO_SCHEMA_DRIFT").otherwise("BASELINE_MISSING"))
    return changed.unionByName(still)


def distribution_drift(spark: SparkSession, component: str, now: DataFrame | None, before: DataFrame | None, limit: float, least: int = 2) -> DataFrame:
    """Records of a component's score and band against a baseline's: shift of the mean, total variation distance."""
    score, band = DISTRIBUTIONS[component]
    usual = dict(component_name=component, source_run_id="latest", scope_type="component", scope_id=component, monitor_type="distribution_drift")
    if now is None or before is None:
        lacking = "CURRENT_DISTRIBUTION_MISSING" if now is None else "BASELINE_MISSING"
        return record(spark.range(1).select("id"), **usual, metric_name=score, metric_unit="drift_score", status="NOT_AVAILABLE", severity="INFO", reason_code=lacking)
    one = lambda df: df.withColumn("_1", F.lit(1))
    n = one(now.agg(F.count(score).alias("_ns"), F.count("*").alias("_n")))
    told = lambda rows, size, unit, baseline: record(
        one(rows).join(F.broadcast(n), "_1"), **usual, metric_name="field", metric_value="drift", metric_unit=unit, baseline_value=baseline, threshold=limit, reason_code=F.col("reason"), sample_size=size,
        status=F.when(F.col("reason").startswith("INSUFFICIENT"), "NOT_AVAILABLE").when(F.col("reason") == "NO_DISTRIBUTION_DRIFT", "HEALTHY").otherwise("DEGRADED"),
        severity=F.when(F.col("reason").startswith("INSUFFICIENT") | (F.col("reason") == "NO_DISTRIBUTION_DRIFT"), "INFO").otherwise("WARNING"))
    numbers = lambda df: df.select(F.col(score).try_cast("double").alias(score))
    shift = told(monitoring.numeric_drift(numbers(before), numbers(now), [score], limit, least), "_ns", "absolute_mean_shift", "old_mean")
    return shift.unionByName(told(monitoring.categorical_drift(before, now, band, limit, least), "_n", "total_variation_distance", None))


METRIC_ROWS = "array<struct<model_name: string, split: string, data_split: string, mae: double, wape: double, bias: double, precision: double, recall: double, brier_score: double, positive_count: double>>"


def model_health(runs: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Records of each model run's first test metrics of the selected model, against rules; METRIC_UNAVAILABLE where one is null."""
    out = [none(runs.sparkSession)]
    for component, rules in MODEL_RULES.items():
        own = runs.filter((F.col("component_name") == component) & (F.col("documents") > 0)).withColumn("_d", F.explode("docs"))
        v = F.try_parse_json("_d")
        chosen = F.try_variant_get(v, "$.selected_model", "string")
        rows = F.filter(F.try_variant_get(v, "$.metrics", METRIC_ROWS), lambda m: (m.model_name == chosen) & (F.coalesce(m.split, m.data_split) == "test"))
        each = own.withColumn("_m", F.try_element_at(rows, F.lit(1))).groupBy("component_name", "source_run_id").agg(F.max("output_records").alias("output_records"), F.max("_m").alias("_m"))
        usual = dict(component_name="component_name", source_run_id="source_run_id", scope_type="component", scope_id="component_name", monitor_type="model_health", metric_unit="metric", sample_size="output_records")
        name, reason = NO_METRICS[component]
        out.append(record(each.filter("_m IS NULL"), **usual, metric_name=name, status="NOT_AVAILABLE", severity="INFO", reason_code=reason))
        there = each.filter("_m IS NOT NULL")
        if component == "outage_prediction":
            out.append(record(there.filter("coalesce(_m.positive_count, 0) = 0"), **usual, metric_name="positive_examples", status="NOT_AVAILABLE", severity="INFO", reason_code="OUTAGE_VALIDATION_NO_POSITIVES"))
        for metric, kind, limit, broken in rules:
            limit = (limits or {}).get(broken, limit)
            x = F.col(f"_m.{metric}")
            bad = F.abs(x) > limit if kind == "abs" else x > limit if kind == "max" else x < limit
            code = F.when(x.isNull(), "METRIC_UNAVAILABLE").when(bad, broken).otherwise(F.concat(F.upper("component_name"), F.lit("_ACCEPTABLE")))
            out.append(record(there, **usual, metric_name=metric, metric_value=x, threshold=limit, status=F.when(x.isNull(), "NOT_AVAILABLE").when(bad, "DEGRADED").otherwise("HEALTHY"), severity=F.when(bad, "WARNING").otherwise("INFO"), reason_code=code))
    return reduce(DataFrame.unionByName, out)


def analytical_health(runs: DataFrame) -> DataFrame:
    """Records of asset health's share of unscored assets, and of reliability's covered population and null KPIs."""
    each = runs.filter("documents > 0").withColumn("_d", F.explode("docs")).withColumn("_v", F.try_parse_json("_d"))
    number = lambda p: F.try_variant_get("_v", f"$.{p}", "double")
    nulls = F.try_variant_get("_v", "$.null_kpi_counts", "map<string,double>")
    found = each.groupBy("component_name", "source_run_id").agg(
        F.max(number("assets_scored")).alias("scored"), F.max(number("insufficient_data_assets")).alias("lacking"), F.max(number("population_coverage")).alias("covered"),
        F.max(F.aggregate(F.map_values(nulls), F.lit(0.0), lambda a, x: a + x)).alias("nulls"), F.max(number("entities_assessed")).alias("entities"), F.max("output_records").alias("output_records"))
    usual = dict(component_name="component_name", source_run_id="source_run_id", scope_type="component", scope_id="component_name", monitor_type="analytical_health")
    health = found.filter("component_name = 'asset_health'").withColumn("_v", ratio(F.coalesce("lacking", F.lit(0.0)), F.col("scored")))
    many = F.coalesce(F.col("_v") > INSUFFICIENT, F.lit(False))
    first = record(health, **usual, metric_name="insufficient_data_rate", metric_value="_v", metric_unit="ratio", threshold=INSUFFICIENT, status=F.when(many, "DEGRADED").otherwise("HEALTHY"), severity=F.when(many, "WARNING").otherwise("INFO"),
                   reason_code=F.when(many, "ASSET_HEALTH_INSUFFICIENT_DATA_INCREASE").otherwise("ASSET_HEALTH_DISTRIBUTION_STABLE"), sample_size=F.coalesce("scored", F.lit(0)))
    kpis = found.filter("component_name = 'reliability'").withColumn("nulls", F.coalesce("nulls", F.lit(0.0)).cast("long"))
    low = F.col("covered") < COVERED
    second = record(kpis, **usual, metric_name="population_coverage", metric_value="covered", metric_unit="metric", threshold=COVERED, status=F.when(F.col("covered").isNull(), "NOT_AVAILABLE").when(low, "DEGRADED").otherwise("HEALTHY"),
                    severity=F.when(low, "WARNING").otherwise("INFO"), reason_code=F.when(F.col("covered").isNull(), "METRIC_UNAVAILABLE").when(low, "POPULATION_DENOMINATOR_SHIFT").otherwise("RELIABILITY_ACCEPTABLE"), sample_size="output_records")
    some = F.col("nulls") > 0
    third = record(kpis, **usual, metric_name="null_kpi_count", metric_value="nulls", metric_unit="count", threshold=0, status=F.when(some, "DEGRADED").otherwise("HEALTHY"), severity=F.when(some, "WARNING").otherwise("INFO"),
                   reason_code=F.when(some, "RELIABILITY_KPI_UNAVAILABLE").otherwise("RELIABILITY_STABLE"), sample_size="entities")
    return first.unionByName(second).unionByName(third)
