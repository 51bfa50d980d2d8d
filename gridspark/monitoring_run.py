"""The monitoring run: eight families of checks over ingested datasets and what other runs left, and the alerts that follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import monitoring, run_checks, star
from .pipelines import Run, finished, load_contracts, run_name, settings
from .sources import discovery, shared, sinks

MONITORING = {
    "freshness_minutes": 1440, "freshness_thresholds": {}, "minimum_records": 1, "maximum_records": 1_000_000, "minimum_expected_records": {}, "maximum_expected_records": {}, "baseline_counts": {},
    "invalid_limit": 0.01, "warning_limit": 0.1, "minimum_sample_size": 2, "run_roots": [], "required_components": [], "contracts": {}, "baseline_contracts": {}, "current": {}, "baseline": {},
    "distribution_drift_threshold": 15.0, "metric_limits": {},
}


def _by(name: str, given: dict, usual: float) -> Column:
    """A setting that may differ by dataset."""
    pairs = [F.lit(x) for kv in given.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(name)), F.lit(usual)) if pairs else F.lit(usual)


def run_monitoring(spark: SparkSession, config: dict | str, run_id: str | None = None) -> Run:
    """Writes check records and alerts in the columns of star.SOURCES, and the runs that it found.

    config: interim_root, output_root, datasets, now (a timestamp), and MONITORING's settings. run_roots are folders of any file system in
    which runs have left JSON files; one that holds none is a component without a run, and it has failed if it is among required_components.
    current and baseline map a component to the table of its scores; contracts and baseline_contracts are as run_ingestion takes them.
    """
    c = settings(config, ("interim_root", "output_root", "datasets", "now"), MONITORING)
    run = Run("monitoring", run_name(run_id), "COMPLETED", paths={n: f"{c['output_root']}/{n}" for n in ("checks", "alerts", "runs")})
    empty = spark.createDataFrame([], "dataset string, at timestamp_ntz")
    found = {d: shared.there(spark, f"{c['interim_root']}/{d}") for d in c["datasets"]}
    stamped = reduce(DataFrame.unionByName, [df.select(F.lit(d).alias("dataset"), monitoring.event_time(df).alias("at")) for d, df in found.items() if df is not None], empty)
    limit = _by("dataset", c["freshness_thresholds"], c["freshness_minutes"])
    fresh = shared.written(monitoring.expected_datasets(monitoring.freshness(stamped, "dataset", "at", str(c["now"]), limit), list(c["datasets"])))
    counts = fresh.select("dataset", "n").withColumn("baseline", _by("dataset", c["baseline_counts"], None).cast("long"))
    # Before the first read, so that a run never finds its own file.
    runs = shared.written(discovery.component_runs(discovery.documents(spark, c["run_roots"])))
    newest = runs.filter("newest")
    records = [
        run_checks.pipeline_health(runs, c["required_components"]),
        run_checks.freshness(fresh, limit),
        run_checks.volume(counts, _by("dataset", c["minimum_expected_records"], c["minimum_records"]), _by("dataset", c["maximum_expected_records"], c["maximum_records"])),
        run_checks.quality(runs, c["invalid_limit"], c["warning_limit"]),
        run_checks.model_health(newest, c["metric_limits"]),
        run_checks.analytical_health(newest),
    ]
    if c["contracts"]:
        old = load_contracts(spark, c["baseline_contracts"]) if c["baseline_contracts"] else {}
        records.append(run_checks.schema_drift(spark, old, load_contracts(spark, c["contracts"])))
    tables = {k: {n: shared.there(spark, p) for n, p in c[k].items()} for k in ("current", "baseline")}
    for component in sorted({*c["current"], *c["baseline"]}):
        records.append(run_checks.distribution_drift(spark, component, tables["current"].get(component), tables["baseline"].get(component), c["distribution_drift_threshold"], c["minimum_sample_size"]))
    told = monitoring.combined(*records).select(F.lit(run.run_id).alias("monitoring_run_id"), *run_checks.RECORD)
    sinks.write_parquet(told, run.paths["checks"])
    sinks.write_parquet(discovery.as_source(runs), run.paths["runs"])
    told = spark.read.parquet(run.paths["checks"])
    order = ["component", "source_run_id", "monitor_type", "scope_type", "scope_id", "metric"]
    judged = monitoring.alerts(told.withColumnsRenamed({"component_name": "component", "metric_name": "metric"}), order, least_sample=c["minimum_sample_size"])
    judged = judged.withColumnsRenamed({"component": "component_name", "metric": "metric_name", "metric_value": "observed_value"})
    judged = judged.withColumn("suppressed", F.when(F.col("suppression_reason").isNull(), "False").otherwise("True"))
    sinks.write_parquet(judged.select(*star.SOURCES["alerts"], "source_run_id", "monitor_type", "status"), run.paths["alerts"])
    alerts = spark.read.parquet(run.paths["alerts"])
    run.counts = {r["alert_status"]: {"n": r["n"]} for r in alerts.groupBy("alert_status").agg(F.count("*").alias("n")).collect()}
    families = {r["monitor_type"]: r["n"] for r in told.groupBy("monitor_type").agg(F.count("*").alias("n")).collect()}
    parts = monitoring.roll_up(told.withColumnRenamed("component_name", "component"), ["component"]).orderBy("component").collect()  # a row a component
    return finished(run, c["output_root"], {"components": [r.asDict() for r in parts], "records_by_family": families})
