"""Freshness, volume, quality, schema and distribution drift, model health, and alert evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import ratio

#: Fields that may hold an event's time, in order of preference.
TIME_FIELDS = ("reading_timestamp", "event_timestamp", "weather_timestamp", "timestamp", "outage_start", "restoration_time", "maintenance_date", "actual_start", "scheduled_start", "completed_at", "commissioned_date")


def event_time(rows: DataFrame) -> Column:
    """The first time field that isn't null."""
    have = [F.col(c).cast("timestamp_ntz") for c in TIME_FIELDS if c in rows.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("timestamp_ntz")


def freshness(rows: DataFrame, by: str, at: str, now: str, limit_minutes: int = 120) -> DataFrame:
    """(by, n, latest, without_time, age_minutes, status, reason, severity) per dataset: up to the limit healthy, up to twice degraded,
    else failed. A dataset of which a row has no time is degraded, one without rows not available."""
    agg = rows.groupBy(by).agg(F.count("*").alias("n"), F.max(at).alias("latest"), F.sum(F.col(at).isNull().cast("long")).alias("without_time"))
    age = F.timestamp_diff("MINUTE", F.col("latest"), F.lit(now).cast("timestamp_ntz"))
    out = agg.withColumn("age_minutes", age)
    reason = (F.when(F.col("n") == 0, "DATASET_EMPTY").when(F.col("latest").isNull() | (F.col("without_time") > 0), "EVENT_TIMESTAMP_MISSING").when(F.col("age_minutes") <= limit_minutes, "DATA_FRESH").when(F.col("age_minutes") <= 2 * limit_minutes, "DATA_STALE").otherwise("DATA_VERY_STALE"))
    out = out.withColumn("reason", reason)
    return out.withColumn("status", F.when(F.col("reason") == "DATASET_EMPTY", "NOT_AVAILABLE").when(F.col("reason") == "DATA_FRESH", "HEALTHY").when(F.col("reason") == "DATA_VERY_STALE", "FAILED").otherwise("DEGRADED")).withColumn("severity", F.when(F.col("reason") == "DATA_FRESH", "INFO").when(F.col("reason") == "DATA_VERY_STALE", "HIGH").otherwise("WARNING"))


def expected_datasets(found: DataFrame, expected: list[str], by: str = "dataset") -> DataFrame:
    """Adds the datasets that gave no rows, as DATASET_EMPTY."""
    spark = found.sparkSession
    missing = spark.createDataFrame([(e,) for e in expected], f"{by} string").join(found.select(by), by, "left_anti")
    return found.unionByName(missing.withColumns({"n": F.lit(0).cast("long"), "reason": F.lit("DATASET_EMPTY"), "status": F.lit("NOT_AVAILABLE"), "severity": F.lit("WARNING")}), allowMissingColumns=True)


def volume(counts: DataFrame, least: int, most: int, count: str = "n", baseline: str = "baseline", change: float = 0.5) -> DataFrame:
    """Adds pct_change and reason: under the minimum, over the maximum, no baseline, dropped or grown by the share, else in range."""
    delta = ratio(F.col(count) - F.col(baseline), F.col(baseline))
    reason = F.when(F.col(count) < least, "VOLUME_BELOW_MINIMUM").when(F.col(count) > most, "VOLUME_ABOVE_MAXIMUM").when(delta.isNull(), "NO_VOLUME_BASELINE").when(delta <= -change, "VOLUME_DROP").when(delta >= change, "VOLUME_SPIKE").otherwise("VOLUME_IN_RANGE")
    return counts.withColumn("pct_change", delta).withColumn("reason", reason)


def quality(counts: DataFrame, invalid_limit: float = 0.05, warning_limit: float = 0.2) -> DataFrame:
    """Invalid and warning rates of (discovered, invalid, warnings), and whether each is beyond its limit."""
    out = counts.withColumns({"invalid_rate": ratio("invalid", "discovered"), "warning_rate": ratio("warnings", "discovered")})
    return out.withColumns({"invalid_exceeded": F.coalesce(F.col("invalid_rate") > invalid_limit, F.lit(False)), "warning_exceeded": F.coalesce(F.col("warning_rate") > warning_limit, F.lit(False))})


def schema_diff(old: DataFrame, new: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(on..., field, change, breaking, severity) between two tables (on..., field, type, required)."""
    on = [*(on or []), "field"]
    a = old.select(*on, F.col("type").alias("old_type"), F.col("required").alias("old_required"))
    b = new.select(*on, F.col("type").alias("new_type"), F.col("required").alias("new_required"))
    both = a.join(b, on, "full_outer")
    change = (F.when(F.col("old_type").isNull() & F.col("new_required"), "ADDED_REQUIRED").when(F.col("old_type").isNull(), "ADDED_OPTIONAL").when(F.col("new_type").isNull(), "REMOVED").when(F.col("old_type") != F.col("new_type"), "TYPE_CHANGED").when(F.col("old_required") != F.col("new_required"), "REQUIREMENT_CHANGED"))
    out = both.withColumn("change", change).filter("change is not null")
    return out.select(*on, "change", (F.col("change") != "ADDED_OPTIONAL").alias("breaking"), F.when(F.col("change") == "ADDED_OPTIONAL", "INFO").when(F.col("change") == "ADDED_REQUIRED", "WARNING").otherwise("HIGH").alias("severity"))


def _drift_reason(kind: str, limit: float | None, enough: Column) -> Column:
    beyond = F.lit(False) if limit is None else F.coalesce(F.col("drift") > limit, F.lit(False))
    return F.when(~enough, "INSUFFICIENT_SAMPLE_FOR_DRIFT").when(beyond, f"{kind}_DISTRIBUTION_DRIFT").otherwise("NO_DISTRIBUTION_DRIFT")


def numeric_drift(old: DataFrame, new: DataFrame, columns: list[str], limit: float, least: int = 2) -> DataFrame:
    """(field, old_mean, new_mean, drift, drifted, reason): the absolute difference of means; both sides are one aggregate each.

    A field with fewer than `least` values on a side has no drift (null).
    """
    def means(df: DataFrame, side: str) -> DataFrame:
        of = df.agg(*[F.struct(F.avg(c).alias("mean"), F.count(c).alias("n")).alias(c) for c in columns]).unpivot([], columns, "field", "x")
        return of.select("field", F.col("x.mean").alias(f"{side}_mean"), F.col("x.n").alias(f"{side}_n"))

    both = means(old, "old").join(means(new, "new"), "field", "full_outer")
    enough = F.least(F.coalesce("old_n", F.lit(0)), F.coalesce("new_n", F.lit(0))) >= least
    out = both.withColumn("drift", F.when(enough, F.abs(F.col("new_mean") - F.col("old_mean")))).withColumn("reason", _drift_reason("NUMERIC", limit, enough))
    return out.select("field", "old_mean", "new_mean", "drift", (F.col("reason") == "NUMERIC_DISTRIBUTION_DRIFT").alias("drifted"), "reason")


def categorical_drift(old: DataFrame, new: DataFrame, column: str, limit: float | None = None, least: int = 2) -> DataFrame:
    """(field, drift, reason): the total variation distance between two distributions, in [0, 1]; null under `least` rows on a side."""
    c = F.col(column).cast("string")
    one = F.lit(1)
    n = lambda df, side: df.groupBy(c.alias("_c")).agg(F.count("*").alias(side))
    both = n(old, "a").withColumn("b", F.lit(0).cast("long")).unionByName(n(new, "b").withColumn("a", F.lit(0).cast("long"))).groupBy("_c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = both.groupBy(one.alias("_1")).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    shares = both.withColumn("_1", one).join(F.broadcast(totals), "_1")  # the totals are one row
    found = shares.groupBy("_1").agg((0.5 * F.sum(F.abs(F.coalesce(ratio("a", "ta"), F.lit(0.0)) - F.coalesce(ratio("b", "tb"), F.lit(0.0))))).alias("drift"), F.min(F.least("ta", "tb")).alias("least"))
    enough = F.col("least") >= least
    return found.withColumn("drift", F.when(enough, F.col("drift"))).select(F.lit(column).alias("field"), "drift", _drift_reason("CATEGORICAL", limit, enough).alias("reason"))


def model_health(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(metric, value, limit, kind, breached) from (metric, value) rows and rules (metric, max | min | abs, limit)."""
    table = metrics.sparkSession.createDataFrame(rules, "metric string, kind string, limit double")
    v = F.col("value")
    breach = F.when(F.col("kind") == "max", v > F.col("limit")).when(F.col("kind") == "min", v < F.col("limit")).otherwise(F.abs(v) > F.col("limit"))
    return metrics.join(F.broadcast(table), "metric").select("metric", "value", "limit", "kind", F.coalesce(breach, F.lit(False)).alias("breached"))


#: What an alert is known by, and severities that reason codes bring with them.
ALERT_FIELDS = ("monitoring_run_id", "component", "source_run_id", "scope_type", "scope_id", "monitor_type", "metric", "reason_code")
SEVERITY_OF = {"DATA_VERY_STALE": "HIGH", "COMPONENT_RUN_FAILED": "CRITICAL", "CHECKSUM_MISMATCH": "HIGH", "BREAKING_SCHEMA_DRIFT": "HIGH"}


def alerts(records: DataFrame, order: list[str], severities: dict[str, str] = SEVERITY_OF, least_sample: int = 2, suppress: tuple[str, ...] = ("info", "sample", "repeated")) -> DataFrame:
    """Adds alert_id, alert_status and suppression_reason to monitoring records (status, severity, ALERT_FIELDS, sample_size, ...), and
    replaces their severity by that of their reason code, if it has one.

    A record that is DEGRADED or FAILED is TRIGGERED, others are NOT_TRIGGERED; suppressed ones are SUPPRESSED either way. The last
    reason to suppress that holds is told: INFO records, samples under the least size, later records of one alert id in the given
    order. `order` has to tell records apart. Absent fields count as blank.
    """
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in records.columns else F.lit("")
    levels = F.create_map(*[F.lit(x) for kv in severities.items() for x in kv]) if severities else F.create_map().cast("map<string,string>")
    out = records.withColumn("alert_id", F.substring(F.sha2(F.concat_ws("|", *map(given, ALERT_FIELDS)), 256), 1, 16)).withColumn("severity", F.coalesce(F.try_element_at(levels, given("reason_code")), F.col("severity")))
    rank = F.row_number().over(Window.partitionBy("alert_id").orderBy(*order))
    small = F.coalesce(F.col("sample_size") < least_sample, F.lit(False)) if "sample_size" in records.columns else F.lit(False)
    rules = [("repeated", rank > 1, "DUPLICATE_ALERT_SUPPRESSED"), ("sample", small, "INSUFFICIENT_SAMPLE_SUPPRESSED"), ("info", F.col("severity") == "INFO", "INFO_ALERT_SUPPRESSED")]
    out = out.withColumn("suppression_reason", F.coalesce(*[F.when(c, F.lit(r)) for name, c, r in rules if name in suppress], F.lit(None).cast("string")))
    return out.withColumn("alert_status", F.when(F.col("suppression_reason").isNotNull(), "SUPPRESSED").when(F.col("status").isin("DEGRADED", "FAILED"), "TRIGGERED").otherwise("NOT_TRIGGERED"))


def roll_up(records: DataFrame, by: list[str]) -> DataFrame:
    """Counts of records by status, and the worst status."""
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s.lower())
    worst = F.when(F.max((F.col("status") == "FAILED").cast("int")) == 1, "FAILED").when(F.max((F.col("status") == "DEGRADED").cast("int")) == 1, "DEGRADED").otherwise("HEALTHY")
    return records.groupBy(*by).agg(F.count("*").alias("records"), n("HEALTHY"), n("DEGRADED"), n("FAILED"), worst.alias("status"))


def combined(*streams: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def repeated_runs(runs: DataFrame) -> DataFrame:
    """Run ids that occur more than once."""
    return runs.groupBy("run_id").agg(F.count("*").alias("n")).filter("n > 1")


def analytical_health(k: DataFrame) -> DataFrame:
    """One row of shares over KPI rows: insufficient entities, covered population, null KPIs, and what they break."""
    n = F.count("*")
    out = k.agg(ratio(F.sum((F.col("reliability_band") == "INSUFFICIENT_DATA").cast("long")), n).alias("insufficient_share"), ratio(F.sum((F.col("population") > 0).cast("long")), n).alias("population_coverage"), F.sum(F.col("saifi").isNull().cast("long")).alias("null_kpis"))
    rules = [(F.col("insufficient_share") > 0.25, "TOO_MANY_INSUFFICIENT"), (F.col("population_coverage") < 0.8, "LOW_POPULATION_COVERAGE"), (F.col("null_kpis") > 0, "NULL_KPIS")]
    return out.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules])))
