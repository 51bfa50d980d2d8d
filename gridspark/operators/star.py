"""The reporting star schema: dimensions, facts, bridges, their relationships, checks, measures and KPIs.

`SOURCES` names what the runs leave; `build` makes every table lazily from those that are there. An absent source or column counts
as empty or null. Times may be timestamps or ISO texts; in keys they are ISO texts (yyyy-MM-ddTHH:mm:ssZ).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import UNKNOWN, UNKNOWN_KEY, known
from ..functions.scalar import surrogate_key as key
from . import mart

#: The columns of each source. Scores and counts that measures sum are numbers, the rest is text.
SOURCES: dict[str, tuple[str, ...]] = {
    "assets": ("asset_id", "asset_name", "asset_type", "grid_region", "substation_id", "feeder_id", "manufacturer", "model", "commissioned_date", "expected_life_years", "rated_capacity", "criticality_tier", "operational_status"),
    "forecasts": ("forecast_run_id", "entity_type", "entity_id", "grid_region", "model_name", "target_name", "target_unit", "forecast_origin", "forecast_timestamp", "forecast_horizon_intervals", "predicted_value", "prediction_lower", "prediction_upper", "actual_value", "data_split"),
    "health": ("asset_health_run_id", "asset_id", "grid_region", "assessment_timestamp", "health_score", "health_band", "maintenance_priority", "data_completeness_ratio", "age_component_score", "inspection_component_score", "maintenance_component_score", "telemetry_stress_component_score", "alarm_component_score", "outage_component_score", "primary_reason_code", "reason_codes"),
    "priorities": ("asset_health_run_id", "asset_id", "priority", "health_band", "criticality_tier", "primary_reason", "review_recommended"),
    "outage_risk": ("outage_prediction_run_id", "entity_type", "entity_id", "grid_region", "substation_id", "feeder_id", "model_name", "observation_timestamp", "prediction_window_start", "prediction_window_end", "risk_score", "risk_band", "predicted_outage_flag", "actual_outage_flag", "classification_threshold", "data_split", "data_completeness_ratio", "primary_reason_code"),
    "reliability": ("reliability_run_id", "entity_type", "entity_id", "grid_region", "substation_id", "feeder_id", "period_start", "period_end", "population_denominator", "outage_count", "planned_outage_count", "unplanned_outage_count", "customer_interruptions", "customer_interruption_minutes", "saifi", "saidi_minutes", "caidi_minutes", "asai", "asui", "reliability_score", "reliability_band", "data_completeness_ratio", "primary_reason_code"),
    "reliability_reasons": ("reliability_run_id", "entity_type", "entity_id", "period_start", "reason_code", "reason_rank"),
    "checks": ("monitoring_run_id", "component_name", "source_run_id", "scope_type", "scope_id", "monitor_type", "metric_name", "metric_value", "metric_unit", "baseline_value", "threshold", "status", "severity", "reason_code", "sample_size"),
    "alerts": ("alert_id", "monitoring_run_id", "component_name", "scope_type", "scope_id", "metric_name", "observed_value", "threshold", "severity", "alert_status", "suppressed", "suppression_reason", "reason_code"),
    "responses": ("assistant_run_id", "query_id", "query_category", "response_status", "retrieval_score", "grounding_coverage", "citation_coverage", "response_confidence", "safety_reason_code", "citation_ids"),
    "runs": ("component_name", "source_run_id", "run_status", "run_timestamp", "assessment_start", "assessment_end"),
}
#: The version of each component's tables.
SCHEMA_VERSIONS = {"forecasting": "4.0.0", "asset_health": "5.0.0", "outage_prediction": "6.0.0", "reliability": "7.0.0", "monitoring": "8.0.0", "genai": "9.0.0"}


#: Columns of SOURCES that are numbers: text in them is read as one, and they are doubles where a source or column is absent.
NUMBERS = frozenset((
    "predicted_value", "prediction_lower", "prediction_upper", "actual_value", "health_score", "data_completeness_ratio", "age_component_score", "inspection_component_score",
    "maintenance_component_score", "telemetry_stress_component_score", "alarm_component_score", "outage_component_score", "risk_score", "population_denominator", "outage_count",
    "planned_outage_count", "unplanned_outage_count", "customer_interruptions", "customer_interruption_minutes", "saifi", "saidi_minutes", "caidi_minutes", "asai", "asui",
    "reliability_score", "reason_rank", "retrieval_score", "grounding_coverage", "citation_coverage", "response_confidence"))


def sources(spark: SparkSession, given: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every source with all its columns and none besides."""
    out = {}
    for name, columns in SOURCES.items():
        df = given.get(name)
        if df is None:
            df = spark.createDataFrame([], ", ".join(f"{c} {'double' if c in NUMBERS else 'string'}" for c in columns))
        types = dict(df.dtypes)
        iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if types[c].startswith("timestamp") else F.col(c).cast("string") if types[c] == "date" else F.col(c).try_cast("double") if c in NUMBERS and types[c] == "string" else F.col(c)
        out[name] = df.select(*[(iso(c) if c in types else F.lit(None).cast("double" if c in NUMBERS else "string")).alias(c) for c in columns])
    return out


def _latest(rows: DataFrame, member: str, columns: dict[str, Column]) -> DataFrame:
    """One row per member that is given: that of the largest asset id."""
    named = rows.filter(F.coalesce(F.col(member), F.lit("")) != "")
    return named.groupBy(member).agg(F.max_by(F.struct(*[c.alias(n) for n, c in columns.items()]), "asset_id").alias("_r")).select(member, *[F.col(f"_r.{n}").alias(n) for n in columns])


def _values(parts: Sequence[tuple[DataFrame, str]], name: str) -> DataFrame:
    """Distinct values of a column of several sources, without null and blank."""
    rows = reduce(DataFrame.union, [df.select(F.col(c).cast("string").alias(name)).distinct() for df, c in parts])
    return rows.filter(F.col(name) != "").distinct()


def _with_unknown(rows: DataFrame, its_key: str, natural: str) -> DataFrame:
    """The table's key first; the unknown member has its key and name, and nulls."""
    rows = rows.select(its_key, *[c for c in rows.columns if c != its_key])
    one = rows.sparkSession.range(1).select(*[F.lit({its_key: UNKNOWN_KEY, natural: UNKNOWN}.get(c)).cast(t).alias(c) for c, t in rows.dtypes])
    return rows.unionByName(one)


def _date(at: str) -> Column:
    """yyyyMMdd of an ISO text, whatever the session's time zone."""
    return F.coalesce(F.nullif(F.replace(F.substring(at, 1, 10), F.lit("-"), F.lit("")), F.lit("")), F.lit(UNKNOWN_KEY))


def _hour(at: str) -> Column:
    """HH00 of an ISO text: facts join the hour."""
    return F.when(F.contains(F.col(at), F.lit("T")), F.concat(F.substring(at, 12, 2), F.lit("00"))).otherwise(UNKNOWN_KEY)


def reason_family(code: Column) -> Column:
    has = lambda w: F.contains(code, F.lit(w))
    return F.when(has("OUTAGE"), "outage").when(has("ALERT") | has("QUALITY") | has("SCHEMA"), "monitoring").when(has("INSUFFICIENT"), "data_completeness").otherwise("operational")


def metric_group(name: Column) -> Column:
    has = lambda w: F.contains(name, F.lit(w))
    return F.when(has("drift"), "drift").when(has("rate"), "rate").when(has("status"), "status").otherwise("measurement")


def dimensions(s: dict[str, DataFrame], start: str, end: str) -> dict[str, DataFrame]:
    """Ten dimensions; dates from start to end."""
    spark = s["assets"].sparkSession
    c = F.col
    assets = s["assets"]
    place = {"grid_region": known("grid_region"), "region_key": key("REG", "grid_region")}
    regions = _values([(s[n], "grid_region") for n in ("assets", "forecasts", "health", "outage_risk", "reliability")], "grid_region")
    models = (s["forecasts"].select(F.lit("forecasting").alias("component_name"), "model_name", "target_name", "target_unit", "entity_type")
              .unionByName(s["outage_risk"].select(F.lit("outage_prediction").alias("component_name"), "model_name", F.lit("outage_flag").alias("target_name"), F.lit("flag").alias("target_unit"), "entity_type")))
    # Of several units and grains of one model the largest count, whatever the order of rows.
    models = models.withColumns({"model_name": known("model_name"), "target_name": known("target_name")}).groupBy("component_name", "model_name", "target_name").agg(F.max(F.struct("target_unit", "entity_type")).alias("_m"))
    reasons = _values([(s["alerts"], "reason_code"), *[(s[n], "primary_reason_code") for n in ("health", "outage_risk", "reliability")]], "reason_code")
    metrics = _values([(s["checks"], "metric_name"), (s["alerts"], "metric_name")], "metric_name")
    version = F.element_at(F.create_map(*[F.lit(x) for kv in SCHEMA_VERSIONS.items() for x in kv]), c("component_name"))
    return {
        "dim_date": mart.date_dimension(spark, start, end),
        "dim_time": mart.time_dimension(spark),
        "dim_grid_region": _with_unknown(regions.select(key("REG", "grid_region").alias("region_key"), "grid_region", F.replace("grid_region", F.lit("GRID-"), F.lit("Synthetic ")).alias("region_name")), "region_key", "grid_region"),
        "dim_substation": _with_unknown(_latest(assets, "substation_id", place | {"asset_id": c("asset_id"), "operational_status": known("operational_status"), "criticality_tier": known("criticality_tier")}).withColumn("substation_key", key("SUB", "substation_id")), "substation_key", "substation_id"),
        "dim_feeder": _with_unknown(_latest(assets, "feeder_id", {"substation_id": known("substation_id"), "substation_key": key("SUB", "substation_id")} | place | {"rated_capacity": c("rated_capacity"), "operational_status": known("operational_status")}).withColumn("feeder_key", key("FDR", "feeder_id")), "feeder_key", "feeder_id"),
        "dim_asset": _with_unknown(assets.select(
            key("AST", "asset_id").alias("asset_key"), known("asset_id").alias("asset_id"), "asset_name", known("asset_type").alias("asset_type"), *[v.alias(n) for n, v in place.items()], known("substation_id").alias("substation_id"), key("SUB", "substation_id").alias("substation_key"),
            known("feeder_id").alias("feeder_id"), key("FDR", "feeder_id").alias("feeder_key"), "manufacturer", "model", "commissioned_date", "expected_life_years", known("criticality_tier").alias("criticality_tier"), known("operational_status").alias("operational_status")), "asset_key", "asset_id"),
        "dim_model": _with_unknown(models.select(key("MDL", "component_name", "model_name", "target_name").alias("model_key"), "component_name", "model_name", F.lit("0.1.0").alias("model_version"), "target_name", F.col("_m.target_unit").alias("target_unit"), known("_m.entity_type").alias("entity_grain")), "model_key", "model_name"),
        "dim_component_run": s["runs"].select(key("RUN", "component_name", "source_run_id").alias("run_key"), *SOURCES["runs"], version.alias("schema_version")),
        "dim_alert_reason": _with_unknown(reasons.select(key("RSN", "reason_code").alias("reason_key"), "reason_code", reason_family(c("reason_code")).alias("reason_family")), "reason_key", "reason_code"),
        "dim_metric": _with_unknown(metrics.select(key("MET", "metric_name").alias("metric_key"), "metric_name", metric_group(c("metric_name")).alias("metric_group")), "metric_key", "metric_name"),
    }


class Fact(NamedTuple):
    """A fact is its source's rows with keys: its own from the grain, those of dimensions, and the columns it takes over."""

    source: str
    name: str
    prefix: str
    grain: tuple[str, ...]
    run: tuple[str, str]
    keys: dict[str, Column]
    columns: tuple[str, ...]


def _fact_specs() -> dict[str, Fact]:
    c = F.col
    is_a = lambda kind: F.when(c("entity_type") == kind, c("entity_id"))
    place = {"region_key": key("REG", "grid_region"), "substation_key": key("SUB", "substation_id"), "feeder_key": key("FDR", "feeder_id")}
    asset = {"asset_key": key("AST", "asset_id")}
    when = lambda t: {"date_key": _date(t), "time_key": _hour(t)}
    after = lambda source, first: SOURCES[source][SOURCES[source].index(first):]
    return {
        "fact_demand_forecast": Fact("forecasts", "forecast_fact_id", "FF", ("forecast_run_id", "entity_id", "forecast_timestamp", "model_name"), ("forecasting", "forecast_run_id"),
                                     {"model_key": key("MDL", F.lit("forecasting"), "model_name", "target_name")} | when("forecast_timestamp") | {"region_key": place["region_key"], "substation_key": key("SUB", is_a("substation")), "feeder_key": key("FDR", is_a("feeder"))}, ("target_name", "target_unit", *after("forecasts", "forecast_origin"))),
        "fact_asset_health": Fact("health", "asset_health_fact_id", "AHF", ("asset_health_run_id", "asset_id"), ("asset_health", "asset_health_run_id"), asset | {"date_key": _date("assessment_timestamp")}, after("health", "assessment_timestamp")[:-1]),
        "fact_outage_risk": Fact("outage_risk", "outage_risk_fact_id", "ORF", ("outage_prediction_run_id", "entity_id", "observation_timestamp", "model_name"), ("outage_prediction", "outage_prediction_run_id"),
                                 {"model_key": key("MDL", F.lit("outage_prediction"), "model_name", F.lit("outage_flag"))} | when("observation_timestamp") | place, after("outage_risk", "observation_timestamp")),
        "fact_reliability_kpi": Fact("reliability", "reliability_fact_id", "RKF", ("reliability_run_id", "entity_type", "entity_id", "period_start"), ("reliability", "reliability_run_id"),
                                     {"date_key": _date("period_start"), "entity_key": _entity_key()} | place, ("entity_type", *after("reliability", "period_start"))),
        "fact_monitoring_check": Fact("checks", "monitoring_check_fact_id", "MCF", ("monitoring_run_id", "component_name", "scope_type", "scope_id", "metric_name"), ("monitoring", "monitoring_run_id"), {}, after("checks", "component_name")),
        "fact_monitoring_alert": Fact("alerts", "monitoring_alert_fact_id", "MAF", ("alert_id",), ("monitoring", "monitoring_run_id"), {"alert_key": key("ALT", "alert_id")}, after("alerts", "component_name")),
        "fact_assistant_response": Fact("responses", "assistant_response_fact_id", "ARF", ("assistant_run_id", "query_id"), ("genai", "assistant_run_id"), {"query_key": key("QRY", "query_id")}, after("responses", "query_category")[:-1]),
        "fact_maintenance_priority": Fact("priorities", "maintenance_priority_fact_id", "MPF", ("asset_health_run_id", "asset_id"), ("asset_health", "asset_health_run_id"), asset, after("priorities", "priority")),
    }


def _entity_key() -> Column:
    """The prefix is the first three letters of the entity's type; an entity without an id is the unknown member."""
    named = F.nullif("entity_id", F.lit(""))
    digits = F.substring(key("ENT", "entity_id"), 4, 17)
    return F.when(named.isNull(), UNKNOWN_KEY).otherwise(F.concat(F.upper(F.substring(F.coalesce("entity_type", F.lit("")), 1, 3)), digits))


def facts(s: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Eight facts, one row for each row of their sources; no shuffle."""
    out = {}
    for name, f in _fact_specs().items():
        rows = s[f.source]
        more = [F.coalesce(F.size(_citations(rows)), F.lit(0)).alias("citation_count")] if f.source == "responses" else []
        out[name] = rows.select(key(f.prefix, *f.grain).alias(f.name), key("RUN", F.lit(f.run[0]), f.run[1]).alias("run_key"), *[v.alias(n) for n, v in f.keys.items()], *f.columns, *more)
    return out


def _citations(responses: DataFrame) -> Column:
    """The ids as an array, whether the source has one or a text joined by `|`."""
    c = F.col("citation_ids")
    return c if dict(responses.dtypes)["citation_ids"].startswith("array") else F.when(c != "", F.split(c, r"\|"))


def bridges(s: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Three bridges: reasons of assets and of entities, citations of responses. Blank reasons give no row, but keep their rank."""
    health = s["health"].select("*", F.posexplode(F.split("reason_codes", r"\|")).alias("_at", "reason_code")).filter("reason_code <> ''")
    period = ("reliability_run_id", "entity_type", "entity_id", "period_start")
    answer = ("assistant_run_id", "query_id")
    cited = s["responses"].select(*answer, F.explode(_citations(s["responses"])).alias("citation_id"))
    return {
        "bridge_asset_reason": health.select(key("BAR", "asset_health_run_id", "asset_id", "reason_code").alias("bridge_asset_reason_id"), key("AHF", "asset_health_run_id", "asset_id").alias("asset_health_fact_id"), key("AST", "asset_id").alias("asset_key"), key("RSN", "reason_code").alias("reason_key"), "reason_code", (F.col("_at") + 1).alias("reason_rank")),
        "bridge_entity_reason": s["reliability_reasons"].select(key("BER", *period, "reason_code").alias("bridge_entity_reason_id"), key("RKF", *period).alias("reliability_fact_id"), "entity_type", "entity_id", key("RSN", "reason_code").alias("reason_key"), "reason_code", "reason_rank"),
        "bridge_response_citation": cited.select(key("BRC", *answer, "citation_id").alias("bridge_response_citation_id"), key("ARF", *answer).alias("assistant_response_fact_id"), key("QRY", "query_id").alias("query_key"), "citation_id"),
    }


def build(spark: SparkSession, given: dict[str, DataFrame], start: str, end: str) -> dict[str, DataFrame]:
    """All 21 tables by name."""
    s = sources(spark, given)
    return dimensions(s, start, end) | facts(s) | bridges(s)


#: Fixed values: (fact, its key, dimension), each many-to-one and filtering one way.
RELATIONSHIPS = [
    ("fact_demand_forecast", "run_key", "dim_component_run"), ("fact_demand_forecast", "model_key", "dim_model"), ("fact_demand_forecast", "date_key", "dim_date"), ("fact_demand_forecast", "time_key", "dim_time"),
    ("fact_asset_health", "run_key", "dim_component_run"), ("fact_asset_health", "asset_key", "dim_asset"), ("fact_asset_health", "date_key", "dim_date"),
    ("fact_outage_risk", "run_key", "dim_component_run"), ("fact_outage_risk", "model_key", "dim_model"), ("fact_reliability_kpi", "run_key", "dim_component_run"),
    ("fact_monitoring_check", "run_key", "dim_component_run"), ("fact_monitoring_alert", "run_key", "dim_component_run"), ("fact_assistant_response", "run_key", "dim_component_run"), ("fact_maintenance_priority", "asset_key", "dim_asset"),
]


def relationships(tables: dict[str, DataFrame]) -> DataFrame:
    """(from_table, from_column, to_table, orphans): rows of a fact whose key is given and not in the dimension. Keys are counted
    before they are joined, so a busy member is one row."""
    out = []
    for fact, column, dim in RELATIONSHIPS:
        used = tables[fact].groupBy(column).agg(F.count("*").alias("n")).filter(F.col(column) != UNKNOWN_KEY)
        lost = used.join(tables[dim].select(column), column, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
        out.append(lost.select(F.lit(fact).alias("from_table"), F.lit(column).alias("from_column"), F.lit(dim).alias("to_table"), "orphans"))
    return reduce(DataFrame.unionByName, out)


def checks(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, duplicate_keys, unknown_members, null_critical): the first key column is a table's own; unknown members are
    counted over all its ids and keys, and a fact's run_key is critical."""
    out = []
    for name, df in tables.items():
        keys = [c for c in df.columns if c.endswith(("_id", "_key"))]
        own = next(c for c in df.columns if c.endswith(("_fact_id", "_key")) or c.startswith("bridge_"))
        unknown = reduce(lambda a, b: a + b, [F.coalesce((F.col(c).cast("string") == UNKNOWN_KEY).cast("long"), F.lit(0)) for c in keys])
        critical = F.coalesce(F.col("run_key"), F.lit("")) == "" if name.startswith("fact_") else F.lit(False)
        total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
        # Summed per own key first: distinct keys are counted without a second pass over the rows.
        per = df.groupBy(F.coalesce(F.col(own).cast("string"), F.lit("")).alias("_own")).agg(F.count("*").alias("_n"), F.sum(unknown).alias("_u"), F.sum(critical.cast("long")).alias("_c"))
        out.append(per.agg(total("_n").alias("rows"), total(F.col("_n") - 1).alias("duplicate_keys"), total("_u").alias("unknown_members"), total("_c").alias("null_critical")).select(F.lit(name).alias("table"), "*"))
    return reduce(DataFrame.unionByName, out)


def _of(a: str, b: str) -> str:
    return f"CAST(sum({a}) AS DOUBLE) / nullif(sum({b}), 0)"


def _live(severity: str) -> str:
    return f"count_if(severity = '{severity}' AND lower(CAST(suppressed AS STRING)) = 'false')"


_ERROR, _MINUTES, _CUT, _PEOPLE = "predicted_value - actual_value", "customer_interruption_minutes", "customer_interruptions", "population_denominator"
#: Measures with their table; each is an aggregate, ratios are ratios of sums.
MEASURES: dict[str, tuple[str, str]] = {
    "Total Unplanned Outages": ("fact_reliability_kpi", "sum(unplanned_outage_count)"),
    "Average Health Score": ("fact_asset_health", "avg(health_score)"),
    "Critical Asset Count": ("fact_asset_health", "count(DISTINCT CASE WHEN health_band = 'CRITICAL' THEN asset_key END)"),
    "High Outage Risk Count": ("fact_outage_risk", "count_if(risk_band IN ('HIGH', 'CRITICAL'))"),
    "System SAIFI": ("fact_reliability_kpi", _of(_CUT, _PEOPLE)),
    "System SAIDI": ("fact_reliability_kpi", _of(_MINUTES, _PEOPLE)),
    "System CAIDI": ("fact_reliability_kpi", _of(_MINUTES, _CUT)),
    "System ASAI": ("fact_reliability_kpi", "1 - avg(asui)"),
    "Active Warning Alerts": ("fact_monitoring_alert", _live("WARNING")),
    "Active Critical Alerts": ("fact_monitoring_alert", _live("CRITICAL")),
    "Forecast MAE": ("fact_demand_forecast", f"avg(abs({_ERROR}))"),
    "Forecast Bias": ("fact_demand_forecast", f"avg({_ERROR})"),
    "Grounded Response Rate": ("fact_assistant_response", "avg(CAST(response_status = 'GROUNDED' AS INT))"),
    "Citation Coverage": ("fact_assistant_response", "avg(citation_coverage)"),
}
#: KPI id to (name, table, aggregation method, unit, direction, audience, its aggregate).
KPIS: dict[str, tuple[str, ...]] = {
    "KPI_FORECAST_DEMAND": ("Forecast Demand", "fact_demand_forecast", "semi-additive", "kWh/MW", "contextual", "grid_operations", "sum(predicted_value)"),
    "KPI_FORECAST_MAE": ("Forecast MAE", "fact_demand_forecast", "non-additive", "target unit", "lower_is_better", "grid_operations", MEASURES["Forecast MAE"][1]),
    "KPI_FORECAST_WAPE": ("Forecast WAPE", "fact_demand_forecast", "non-additive", "percent", "lower_is_better", "data_and_model_governance", _of(f"abs({_ERROR})", "actual_value")),
    "KPI_HIGH_RISK_FEEDERS": ("High-Risk Feeders", "fact_outage_risk", "additive", "count", "lower_is_better", "grid_operations", MEASURES["High Outage Risk Count"][1]),
    "KPI_CRITICAL_ASSETS": ("Critical Asset Count", "fact_asset_health", "semi-additive", "count", "lower_is_better", "asset_management", MEASURES["Critical Asset Count"][1]),
    "KPI_P1_MAINT": ("P1 Maintenance Review Count", "fact_maintenance_priority", "additive", "count", "lower_is_better", "asset_management", "count_if(priority = 'P1_IMMEDIATE_REVIEW')"),
    "KPI_P2_MAINT": ("P2 Maintenance Review Count", "fact_maintenance_priority", "additive", "count", "lower_is_better", "asset_management", "count_if(priority = 'P2_HIGH')"),
    "KPI_SAIFI": ("SAIFI", "fact_reliability_kpi", "non-additive", "interruptions/customer", "lower_is_better", "reliability_engineering", MEASURES["System SAIFI"][1]),
    "KPI_SAIDI": ("SAIDI", "fact_reliability_kpi", "non-additive", "minutes/customer", "lower_is_better", "reliability_engineering", MEASURES["System SAIDI"][1]),
    "KPI_CAIDI": ("CAIDI", "fact_reliability_kpi", "non-additive", "minutes/interruption", "lower_is_better", "reliability_engineering", MEASURES["System CAIDI"][1]),
    "KPI_ASAI": ("ASAI", "fact_reliability_kpi", "non-additive", "ratio", "higher_is_better", "executive_leadership", MEASURES["System ASAI"][1]),
    "KPI_UNPLANNED_OUTAGES": ("Unplanned Outage Count", "fact_reliability_kpi", "additive", "count", "lower_is_better", "reliability_engineering", MEASURES["Total Unplanned Outages"][1]),
    "KPI_MEAN_RESTORATION": ("Mean Restoration Duration", "fact_reliability_kpi", "non-additive", "minutes", "lower_is_better", "reliability_engineering", _of(_MINUTES, "outage_count")),
    "KPI_RELIABILITY_SCORE": ("Reliability Score", "fact_reliability_kpi", "non-additive", "score", "higher_is_better", "executive_leadership", "avg(reliability_score)"),
    "KPI_ACTIVE_WARNING": ("Active Warning Alerts", "fact_monitoring_alert", "additive", "count", "lower_is_better", "data_and_model_governance", _live("WARNING")),
    "KPI_ACTIVE_HIGH": ("Active High Alerts", "fact_monitoring_alert", "additive", "count", "lower_is_better", "data_and_model_governance", _live("HIGH")),
    "KPI_ACTIVE_CRITICAL": ("Active Critical Alerts", "fact_monitoring_alert", "additive", "count", "lower_is_better", "executive_leadership", _live("CRITICAL")),
    "KPI_STALE_DATASETS": ("Stale Dataset Count", "fact_monitoring_check", "additive", "count", "lower_is_better", "data_and_model_governance", "count_if(monitor_type = 'data_freshness' AND status <> 'HEALTHY')"),
    "KPI_SCHEMA_DRIFT": ("Schema Drift Count", "fact_monitoring_check", "additive", "count", "lower_is_better", "data_and_model_governance", "count_if(monitor_type = 'schema_drift' AND status <> 'HEALTHY')"),
    "KPI_GROUNDED_RATE": ("Grounded Assistant Response Rate", "fact_assistant_response", "non-additive", "percent", "higher_is_better", "grid_operations", MEASURES["Grounded Response Rate"][1]),
    "KPI_CITATION_COVERAGE": ("Citation Coverage", "fact_assistant_response", "non-additive", "percent", "higher_is_better", "data_and_model_governance", MEASURES["Citation Coverage"][1]),
}


def values(tables: dict[str, DataFrame], what: dict[str, tuple[str, str]]) -> DataFrame:
    """(name, value) of aggregates {name: (table, expression)}; one pass over each table."""
    out = []
    for name in sorted({t for t, _ in what.values()}):
        mine = {n: e for n, (t, e) in what.items() if t == name}
        one = tables[name].agg(*[F.expr(e).cast("double").alias(f"_{i}") for i, e in enumerate(mine.values())])
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{i}").alias("value")) for i, n in enumerate(mine)])
        out.append(one.select(F.inline(pairs)))
    return reduce(DataFrame.unionByName, out)


def measures(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, value) of MEASURES."""
    return values(tables, MEASURES)


def kpis(tables: dict[str, DataFrame]) -> DataFrame:
    """KPIS with their values."""
    spark = next(iter(tables.values())).sparkSession
    about = spark.createDataFrame([(k, *v[:-1]) for k, v in KPIS.items()], "kpi_id string, kpi_name string, source_table string, aggregation_method string, unit string, direction string, audience string")
    found = values(tables, {k: (v[1], v[-1]) for k, v in KPIS.items()}).withColumnRenamed("name", "kpi_id")
    # Both sides have one row per KPI.
    return found.join(F.broadcast(about), "kpi_id")
