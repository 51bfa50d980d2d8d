"""Seeded synthetic datasets of a power network. Every value is a hash of its key and the seed, so parts can be made anywhere in
any order; distributions, not bytes, follow the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import short_id

REGIONS = ("GRID-NORTH", "GRID-SOUTH", "GRID-EAST", "GRID-WEST", "GRID-CENTRAL")


def uniform(seed: int, salt: str, *key: str) -> Column:
    """In [0, 1), from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def pick(u: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def timestamps(spark: SparkSession, start: str, end: str, step_minutes: int) -> DataFrame:
    """start, start + step, ... before end."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    step = F.expr(f"interval {step_minutes} minutes")
    return spark.range(1).select(F.explode(F.sequence(a, b - step, step)).alias("event_timestamp"))


def network(spark: SparkSession, regions: int = 5, substations: int = 2, feeders: int = 2, meters: int = 8) -> DataFrame:
    """(grid_region, substation_id, feeder_id, meter_id), one row per meter."""
    n = regions * substations * feeders * meters
    i = F.col("id")
    feeder = F.floor(i / meters)
    station = F.floor(feeder / feeders)
    region = pick((F.floor(station / substations) + 0.5) / regions, list(REGIONS[:regions]))
    return spark.range(n).select(region.alias("grid_region"), F.format_string("SUB-%04d", station).alias("substation_id"), F.format_string("FDR-%04d", feeder).alias("feeder_id"), F.format_string("MTR-%06d", i).alias("meter_id"))


def smart_meter_events(spark: SparkSession, net: DataFrame, start: str, end: str, step_minutes: int = 60, seed: int = 42, drop: float = 0.01) -> DataFrame:
    """Readings per meter and tick; a share is dropped, and arrival is up to 30 minutes late."""
    u = lambda salt: uniform(seed, salt, "meter_id", "event_timestamp")
    rows = net.withColumn("event_timestamp", F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") - F.expr(f"interval {step_minutes} minutes"), F.expr(f"interval {step_minutes} minutes"))))
    rows = rows.filter(u("drop") >= drop)
    energy = F.round(0.2 + 1.8 * u("kwh") + 0.5 * F.sin(F.hour("event_timestamp") * 0.2618), 4)
    return rows.select(short_id("EVT", "meter_id", F.col("event_timestamp").cast("string")).alias("event_id"), "event_timestamp", F.timestamp_seconds(F.unix_timestamp("event_timestamp") + F.floor(u("late") * 1800)).alias("ingested_at"), "meter_id", "feeder_id", "substation_id", "grid_region",
                       pick(u("segment"), ["residential", "commercial", "industrial", "public-service"]).alias("customer_segment"), F.lit(step_minutes).cast("long").alias("reading_interval_minutes"), F.greatest(energy, F.lit(0.0)).alias("active_energy_kwh"), F.round(0.3 * u("kvarh"), 4).alias("reactive_energy_kvarh"),
                       F.round(225 + 15 * u("v"), 2).alias("voltage_v"), F.round(2 + 20 * u("a"), 2).alias("current_a"), F.round(0.9 + 0.1 * u("pf"), 3).alias("power_factor"), F.round(49.95 + 0.1 * u("hz"), 3).alias("frequency_hz"),
                       F.when(u("status") < 0.01, "suspect").otherwise("active").alias("meter_status"), F.when(u("quality") < 0.02, "ESTIMATED").otherwise("GOOD").alias("quality_code"), F.lit("2.0.0").alias("schema_version"))


def substation_events(spark: SparkSession, net: DataFrame, start: str, end: str, step_minutes: int = 60, seed: int = 42) -> DataFrame:
    feeders = net.select("grid_region", "substation_id", "feeder_id").distinct()
    step = F.expr(f"interval {step_minutes} minutes")
    rows = feeders.withColumn("event_timestamp", F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") - step, step)))
    u = lambda salt: uniform(seed, salt, "feeder_id", "event_timestamp")
    rows = rows.withColumns({"capacity_mva": F.round(20 + 20 * uniform(seed, "mva", "feeder_id"), 2)}).withColumn("load_mw", F.round(F.col("capacity_mva") * (0.4 + 0.55 * u("load")), 3))
    rows = rows.withColumn("utilisation_pct", F.round(F.col("load_mw") / F.col("capacity_mva") * 100, 2)).withColumn("transformer_temperature_c", F.round(40 + 0.4 * F.col("utilisation_pct") + 5 * u("temp"), 2))
    alarm = F.when(F.col("transformer_temperature_c") >= 78, "TEMP_WARN").when(F.col("utilisation_pct") >= 92, "HIGH_LOAD").otherwise("")
    return rows.select(short_id("SEV", "feeder_id", F.col("event_timestamp").cast("string")).alias("event_id"), "event_timestamp", F.timestamp_seconds(F.unix_timestamp("event_timestamp") + F.floor(u("late") * 600)).alias("ingested_at"), "substation_id", "feeder_id", "grid_region", "load_mw", "capacity_mva", "utilisation_pct",
                       F.round(32.5 + u("kv"), 2).alias("voltage_kv"), F.round(49.95 + 0.1 * u("hz"), 3).alias("frequency_hz"), "transformer_temperature_c", F.round(F.col("transformer_temperature_c") - 4, 2).alias("oil_temperature_c"), F.round(5 + 15 * u("ambient"), 2).alias("ambient_temperature_c"), F.lit("closed").alias("breaker_status"),
                       alarm.alias("alarm_code"), F.when(u("status") < 0.01, "offline").when(F.col("utilisation_pct") >= 92, "constrained").when(alarm != "", "warning").otherwise("normal").alias("operational_status"), F.lit("GOOD").alias("quality_code"), F.lit("2.0.0").alias("schema_version"))


def weather(spark: SparkSession, start: str, end: str, regions: int = 5, step_minutes: int = 60, seed: int = 42) -> DataFrame:
    step = F.expr(f"interval {step_minutes} minutes")
    rows = spark.range(regions).select(pick((F.col("id") + 0.5) / regions, list(REGIONS[:regions])).alias("grid_region"), F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") - step, step)).alias("weather_timestamp"))
    u = lambda salt: uniform(seed, salt, "grid_region", "weather_timestamp")
    gust = F.round(4 + 22 * u("gust"), 2)
    return rows.select("weather_timestamp", "grid_region", F.round(4 + 14 * u("t"), 2).alias("temperature_c"), F.round(2 + 14 * u("t"), 2).alias("feels_like_c"), F.round(50 + 45 * u("h"), 2).alias("humidity_pct"), F.round(gust * 0.6, 2).alias("wind_speed_mps"), gust.alias("wind_gust_mps"), F.round(6 * u("rain") * u("rain2"), 2).alias("precipitation_mm"),
                       F.round(990 + 40 * u("p"), 2).alias("pressure_hpa"), F.when(gust > 22, "storm").when(gust > 16, "wind").otherwise(pick(u("sky"), ["clear", "cloud", "rain"])).alias("weather_condition"), (gust > 22).alias("severe_weather_flag"), F.lit("synthetic").alias("data_source"), F.lit("2.0.0").alias("schema_version"))


def assets(net: DataFrame, today: str, seed: int = 42) -> DataFrame:
    """A primary substation per substation, and a transformer, breaker, switchgear and relay per feeder."""
    stations = net.select("grid_region", "substation_id", F.lit(None).cast("string").alias("feeder_id"), F.lit("primary_substation").alias("asset_type")).distinct()
    kinds = F.explode(F.array(*[F.lit(k) for k in ("transformer", "circuit_breaker", "feeder", "switchgear", "protection_relay")])).alias("asset_type")
    rows = stations.unionByName(net.select("grid_region", "substation_id", "feeder_id").distinct().select("*", kinds))
    u = lambda salt: uniform(seed, salt, "substation_id", "feeder_id", "asset_type")
    day = F.lit(today).cast("date")
    return rows.select(short_id("AST", "substation_id", F.coalesce("feeder_id", F.lit("")), "asset_type").alias("asset_id"), "asset_type", F.concat_ws(" ", "asset_type", "substation_id").alias("asset_name"), "grid_region", "substation_id", "feeder_id", pick(u("maker"), ["Northwind", "Volta", "Amperia"]).alias("manufacturer"), F.format_string("M%02d", F.floor(u("model") * 20)).alias("model"),
                       F.date_sub(day, (F.floor(u("age") * 16000) + 365).cast("int")).alias("commissioned_date"), (F.floor(u("life") * 20) + 25).cast("long").alias("expected_life_years"), F.round(5 + 45 * u("cap"), 2).alias("rated_capacity"), F.lit("MVA").alias("capacity_unit"), pick(u("tier"), ["tier_1", "tier_2", "tier_3"]).alias("criticality_tier"),
                       F.when(u("status") < 0.05, "maintenance").otherwise("active").alias("operational_status"), F.date_sub(day, F.floor(u("insp") * 300).cast("int")).alias("last_inspection_date"), F.greatest(F.date_add(day, (F.floor(u("due") * 400) - 60).cast("int")), F.date_sub(day, F.floor(u("insp") * 300).cast("int"))).alias("next_inspection_due"), F.format_string("LOC-%04d", F.floor(u("loc") * 10000)).alias("synthetic_location_code"), F.lit("2.0.0").alias("schema_version"))


def maintenance(asset_rows: DataFrame, start: str, seed: int = 42, most: int = 3) -> DataFrame:
    """Up to `most` log entries per asset in the 90 days before the start."""
    rows = asset_rows.select("asset_id", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")).filter(uniform(seed, "have", "asset_id", "k") < 0.6)
    u = lambda salt: uniform(seed, salt, "asset_id", "k")
    begin = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) - F.floor(u("back") * 90 * 86400))
    status = F.when(u("status") < 0.7, "completed").when(u("status") < 0.8, "scheduled").when(u("status") < 0.9, "deferred").otherwise("cancelled")
    down = F.floor(u("down") * 480).cast("long")
    rows = rows.withColumns({"maintenance_status": status, "scheduled_start": begin}).withColumns({"actual_start": F.when(F.col("maintenance_status") == "completed", begin + F.expr("interval 30 minutes")), "downtime_minutes": F.when(F.col("maintenance_status") == "completed", down).otherwise(0).cast("long")})
    return rows.select(short_id("MNT", "asset_id", F.col("k").cast("string")).alias("maintenance_id"), "asset_id", pick(u("type"), ["preventive", "corrective", "inspection", "emergency", "condition-based"]).alias("maintenance_type"), "scheduled_start", "actual_start", F.when(F.col("actual_start").isNotNull(), F.timestamp_seconds(F.unix_timestamp("actual_start") + 60 * F.col("downtime_minutes"))).alias("completed_at"),
                       "maintenance_status", pick(u("prio"), ["low", "medium", "high", "urgent"]).alias("priority"), pick(u("cat"), ["inspection", "repair", "replacement", "testing"]).alias("work_category"), F.lit(None).cast("string").alias("fault_code"), pick(u("team"), ["TEAM-A", "TEAM-B"]).alias("technician_team"), "downtime_minutes", F.lit("none").alias("parts_replaced"),
                       F.round(100 + 5000 * u("cost"), 2).alias("maintenance_cost_gbp"), (u("follow") < 0.2).alias("follow_up_required"), F.lit("N1").alias("notes_code"), F.lit("2.0.0").alias("schema_version"))


def outages(net: DataFrame, asset_rows: DataFrame, start: str, hours: int, seed: int = 42, chance: float = 0.3) -> DataFrame:
    """At most one outage per feeder in the period."""
    per = net.groupBy("grid_region", "substation_id", "feeder_id").agg(F.count("*").alias("meters"))
    primary = asset_rows.filter("asset_type = 'transformer'").select("feeder_id", F.col("asset_id").alias("primary_asset_id"))
    u = lambda salt: uniform(seed, salt, "feeder_id")
    rows = per.join(primary, "feeder_id").filter(u("have") < chance)
    planned = u("planned") < 0.2
    minutes = (F.floor(u("dur") * 300) + 3).cast("long")
    rows = rows.withColumns({"outage_start": F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + 60 * F.floor(u("at") * hours * 60)), "duration_minutes": minutes, "planned_flag": planned})
    return rows.select(short_id("OUT", "feeder_id").alias("outage_id"), "outage_start", F.timestamp_seconds(F.unix_timestamp("outage_start") + 60 * F.col("duration_minutes")).alias("restoration_time"), "duration_minutes", "grid_region", "substation_id", "feeder_id", "primary_asset_id", F.when(F.col("planned_flag"), "planned").otherwise("unplanned").alias("outage_type"),
                       F.when(F.col("planned_flag"), "planned_maintenance").otherwise(pick(u("cause"), ["equipment_failure", "severe_weather", "vegetation", "overload", "unknown"])).alias("cause_category"), (F.col("meters") * 20).cast("long").alias("customers_interrupted"), F.round(5 * u("mw"), 3).alias("estimated_load_lost_mw"), "planned_flag",
                       (u("severe") < 0.2).alias("severe_weather_related"), (u("prot") < 0.5).alias("protection_operated"), pick(u("method"), ["remote_switching", "field_repair", "auto_reclose"]).alias("restoration_method"), F.when(F.col("duration_minutes") > 180, "high").when(F.col("duration_minutes") > 60, "medium").otherwise("low").alias("incident_severity"), F.lit("GOOD").alias("data_quality_flag"), F.lit("2.0.0").alias("schema_version"))
