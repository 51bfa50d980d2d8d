"""The star schema's sources as views of the tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DAY = "substring(CAST({0} AS STRING), 1, 10)"


def _at(day: str, hour: str) -> str:
    return f"concat({_DAY.format(day)}, 'T', lpad(CAST({hour} AS STRING), 2, '0'), ':00:00Z')"


#: Ids of suppliers that aren't in the part table's feeders, keys that are null or blank, and repeated grains are there on purpose.
VIEWS: dict[str, str] = {
    "assets": """SELECT concat('A', p_partkey) AS asset_id, p_name AS asset_name, p_type AS asset_type, concat('GRID-', p_partkey % 4) AS grid_region, concat('S', p_partkey % 25) AS substation_id, CASE WHEN p_partkey % 10 <> 0 THEN concat('F', p_partkey % 100) END AS feeder_id,
  p_brand AS manufacturer, p_type AS model, '2001-01-01' AS commissioned_date, p_size AS expected_life_years, p_size * 2 AS rated_capacity, concat('tier_', p_partkey % 3 + 1) AS criticality_tier, CASE WHEN p_partkey % 40 = 0 THEN '' ELSE 'active' END AS operational_status FROM {part}""",
    "forecasts": f"""SELECT 'fc-1' AS forecast_run_id, CASE WHEN l_linenumber % 2 = 0 THEN 'substation' ELSE 'feeder' END AS entity_type, concat(CASE WHEN l_linenumber % 2 = 0 THEN 'S' ELSE 'F' END, l_suppkey) AS entity_id, concat('GRID-', l_suppkey % 5) AS grid_region, CASE WHEN l_returnflag = 'R' THEN 'ridge' ELSE 'persistence' END AS model_name,
  'load_mw' AS target_name, 'MW' AS target_unit, {_at("l_shipdate", "l_orderkey % 24")} AS forecast_timestamp, l_linenumber AS forecast_horizon_intervals, l_quantity AS predicted_value, l_quantity + l_linenumber - 3 AS actual_value, CASE WHEN l_linestatus = 'F' THEN 'test' ELSE 'train' END AS data_split FROM {{lineitem}}""",
    "health": """SELECT 'ah-1' AS asset_health_run_id, concat('A', p_partkey + CASE WHEN p_partkey % 50 = 0 THEN 10000000 ELSE 0 END) AS asset_id, concat('GRID-', p_partkey % 4) AS grid_region, '2024-03-01T06:00:00Z' AS assessment_timestamp, CAST(p_size * 2 AS DOUBLE) AS health_score, CASE WHEN p_size < 15 THEN 'CRITICAL' ELSE 'HEALTHY' END AS health_band,
  CASE WHEN p_partkey % 3 = 0 THEN 'AGE_BEYOND_EXPECTED_LIFE||INSUFFICIENT_TELEMETRY' WHEN p_partkey % 3 = 1 THEN 'RECENT_DIRECT_UNPLANNED_OUTAGE' END AS reason_codes, CASE WHEN p_partkey % 3 = 0 THEN 'AGE_BEYOND_EXPECTED_LIFE' WHEN p_partkey % 3 = 1 THEN 'RECENT_DIRECT_UNPLANNED_OUTAGE' END AS primary_reason_code FROM {part}""",
    "priorities": "SELECT 'ah-1' AS asset_health_run_id, concat('A', p_partkey) AS asset_id, CASE p_partkey % 4 WHEN 0 THEN 'P1_IMMEDIATE_REVIEW' WHEN 1 THEN 'P2_HIGH' WHEN 2 THEN 'P3_MEDIUM' ELSE 'P4_ROUTINE' END AS priority, CASE WHEN p_size < 15 THEN 'CRITICAL' ELSE 'HEALTHY' END AS health_band, concat('tier_', p_partkey % 3 + 1) AS criticality_tier FROM {part}",
    "outage_risk": f"""SELECT 'op-1' AS outage_prediction_run_id, 'feeder' AS entity_type, concat('F', user_id) AS entity_id, concat('GRID-', user_id % 6) AS grid_region, concat('S', user_id % 25) AS substation_id, concat('F', user_id) AS feeder_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'logistic' END AS model_name, {_at("ts", "event_id % 24")} AS observation_timestamp,
  CAST(event_id % 100 AS DOUBLE) / 100 AS risk_score, CASE event_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_band, CASE WHEN event_id % 7 = 0 THEN 'SEVERE_WEATHER_QUALITY' END AS primary_reason_code FROM {{events}}""",
    "reliability": f"""SELECT 'rl-1' AS reliability_run_id, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE 'feeder' END AS entity_type, CASE WHEN o_custkey % 11 = 0 THEN '' ELSE concat('F', o_custkey) END AS entity_id, concat('GRID-', o_custkey % 4) AS grid_region, concat('S', o_custkey % 25) AS substation_id, concat('F', o_custkey) AS feeder_id, {_DAY.format("o_orderdate")} AS period_start,
  o_custkey % 50 + 1 AS population_denominator, o_orderkey % 5 AS outage_count, o_orderkey % 2 AS unplanned_outage_count, o_orderkey % 7 AS customer_interruptions, o_orderkey % 7 * 30 AS customer_interruption_minutes, CAST(o_orderkey % 8 AS DOUBLE) / 8 AS asui, CAST(o_orderkey % 64 AS DOUBLE) AS reliability_score, 'HIGH_OUTAGE_FREQUENCY' AS primary_reason_code FROM {{orders}}""",
    "reliability_reasons": f"SELECT 'rl-1' AS reliability_run_id, 'feeder' AS entity_type, concat('F', o_custkey) AS entity_id, {_DAY.format('o_orderdate')} AS period_start, o_orderpriority AS reason_code, o_orderkey % 3 + 1 AS reason_rank FROM {{orders}}",
    "checks": """SELECT 'mo-1' AS monitoring_run_id, c_mktsegment AS component_name, 'dataset' AS scope_type, concat('D', c_custkey) AS scope_id, CASE c_custkey % 3 WHEN 0 THEN 'data_freshness' WHEN 1 THEN 'schema_drift' ELSE 'volume' END AS monitor_type, CASE c_custkey % 4 WHEN 0 THEN 'drift_share' WHEN 1 THEN 'error_rate' WHEN 2 THEN 'run_status' ELSE 'age' END AS metric_name,
  c_custkey % 10 AS metric_value, CASE WHEN c_custkey % 5 = 0 THEN 'FAILED' ELSE 'HEALTHY' END AS status, 'INFO' AS severity FROM {customer}""",
    "alerts": """SELECT CASE WHEN c_custkey % 100 = 0 THEN NULL ELSE concat('AL', c_custkey) END AS alert_id, CASE WHEN c_custkey % 30 = 0 THEN 'mo-0' ELSE 'mo-1' END AS monitoring_run_id, c_mktsegment AS component_name, 'age' AS metric_name, CASE c_custkey % 4 WHEN 0 THEN 'WARNING' WHEN 1 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  CASE WHEN c_custkey % 6 = 0 THEN 'TRIGGERED' ELSE 'DUPLICATE_ALERT_SUPPRESSED' END AS alert_status, CASE WHEN c_custkey % 6 = 0 THEN 'False' ELSE 'True' END AS suppressed, CASE c_custkey % 3 WHEN 0 THEN 'DATA_STALE' WHEN 1 THEN 'ALERT_STORM' ELSE '' END AS reason_code FROM {customer}""",
    "responses": "SELECT 'ga-1' AS assistant_run_id, concat(conv_id, '-', turn) AS query_id, role AS query_category, CASE WHEN conv_id % 3 = 0 THEN 'GROUNDED' ELSE 'REFUSED' END AS response_status, CAST(turn % 4 AS DOUBLE) / 4 AS citation_coverage, CASE WHEN turn % 3 = 0 THEN '' ELSE concat('C', conv_id, '|C', turn) END AS citation_ids FROM {conversations}",
    "runs": "SELECT * FROM (VALUES ('forecasting', 'fc-1', 'PASSED'), ('asset_health', 'ah-1', 'PASSED'), ('outage_prediction', 'op-1', 'PASSED'), ('reliability', 'rl-1', 'PASSED'), ('monitoring', 'mo-1', 'PASSED')) v(component_name, source_run_id, run_status)",
}
TABLES = ("part", "lineitem", "events", "orders", "customer", "conversations")


def views(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in TABLES}
    return {name: spark.sql(sql, **{t: df for t, df in tables.items() if f"{{{t}}}" in sql}) for name, sql in VIEWS.items()}


def sql(name: str) -> str:
    return VIEWS[name].format(**{t: t for t in TABLES})
