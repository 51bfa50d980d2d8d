"""Outage-risk panels: entity x time spine, leakage-safe labels, lookback and as-of features, bands and reasons.

Times are minutes since 1970 (long). A lookback of L intervals of f minutes reaches from obs - (L - 1) * f to obs, both inclusive.
Lookback joins are equi-joins: each event is dealt to the time buckets, as long as the lookback, in which an observation can see
it (two at most), so a busy entity's events meet only the observations of their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import codes, ladder, share
from . import ordered

BANDS = [(0.75, "CRITICAL"), (0.5, "HIGH"), (0.25, "MODERATE")]
#: Steps of a chunk of ticks.
TICKS = 1024
#: Fixed value: days when something never happened.
NEVER = 999.0


def panel(entities: DataFrame, telemetry: DataFrame, step: int, lookback: int, horizon: int, least_history: int = 1) -> DataFrame:
    """(entity_id, obs, available_history, missing_intervals, completeness): every entity at every tick of the telemetry up to
    the last minus the horizon, where the entity had at least `least_history` ticks in its lookback.

    Entities times ticks are what is asked for. Ticks are kept in chunks of TICKS steps; every entity is dealt to the chunks between the
    first tick and the last, and meets the ticks of a chunk by an equi-join.
    """
    chunk = F.floor(F.col("obs") / (step * TICKS))
    ticks = telemetry.select(F.col("ts_min").alias("obs")).distinct()
    reach = telemetry.agg(F.min("ts_min").alias("first"), F.max("ts_min").alias("last")).first()  # one row
    ends = F.lit(reach.last)
    present = telemetry.select("entity_id", F.col("ts_min").alias("obs")).distinct().withColumn("_p", F.lit(1))
    chunks = ticks.groupBy(chunk.alias("_c")).agg(F.collect_list("obs").alias("_t"))
    if reach.first is None:
        spine = entities.select("entity_id", F.lit(0).cast("long").alias("obs")).limit(0)
    else:
        numbers = F.sequence(F.lit(reach.first // (step * TICKS)), F.lit(reach.last // (step * TICKS)))
        dealt = entities.select("entity_id").distinct().select("entity_id", F.explode(numbers).alias("_c"))
        spine = dealt.join(chunks, "_c").select("entity_id", F.explode("_t").alias("obs"))
    back = Window.partitionBy("entity_id").orderBy("obs").rangeBetween(-step * (lookback - 1), 0)
    full = spine.join(present, ["entity_id", "obs"], "left").withColumn("available_history", F.sum(F.coalesce("_p", F.lit(0))).over(back))
    return full.filter((F.col("obs") <= ends - horizon * step) & (F.col("available_history") >= least_history)).select(
        "entity_id", "obs", "available_history", F.greatest(F.lit(0), F.lit(lookback) - F.col("available_history")).alias("missing_intervals"), F.least(F.lit(1.0), F.col("available_history") / F.lit(float(lookback))).alias("completeness"))


def dealt_back(events: DataFrame, at: str, reach: int) -> DataFrame:
    """Each event once per bucket of `reach` minutes in which an observation up to `reach` later may lie."""
    first = F.floor(F.col(at) / reach)
    return events.withColumn("_b", F.explode(F.sequence(first, F.floor((F.col(at) + reach) / reach))))


def looked_back(rows: DataFrame, events: DataFrame, reach: int, aggregates: list[Column], at: str = "ts_min", key: str = "entity_id", strict: bool = False, also: Column | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """rows with aggregates of the events of their entity in [obs - reach, obs] (or before obs, if strict).

    `also` is a further condition on both. Rows without events keep the defaults. Aggregates are on the event's columns.
    """
    keyed = rows.select(key, "obs").distinct().withColumn("_b", F.floor(F.col("obs") / reach))
    clash = [c for c in events.columns if c in ("obs", "_b")]
    dealt = dealt_back(events.drop(*clash), at, reach)
    cond = (F.col(at) >= F.col("obs") - reach) & ((F.col(at) < F.col("obs")) if strict else (F.col(at) <= F.col("obs")))
    joined = keyed.join(dealt, [key, "_b"]).filter(cond if also is None else cond & also)
    out = rows.join(joined.groupBy(key, "obs").agg(*aggregates), [key, "obs"], "left")
    return out.fillna({k: v for k, v in (defaults or {}).items() if v is not None})


def swept(
    rows: DataFrame, events: DataFrame, enter: Column, leave: Column, sums: dict[str, Column], latest: dict[str, Column], reach: int, key: str = "entity_id"
) -> DataFrame:
    """rows with sums over the events of their entity that have entered by obs and not left, and the latest of times of those entered.

    `enter` is the first minute at which an event is seen, `leave` the first at which it no longer is. A sweep: events and observations are
    sorted by entity and time once, an event adds to running sums when it enters and takes off when it leaves. So the cost is that of
    events and observations, however far a look back reaches. `latest` are times that are null before obs - reach. Sums are exact for whole numbers.
    """
    seen = events.withColumns({"_e": enter, "_l": leave} | {f"_x_{n}": F.coalesce(v.cast("double"), F.lit(0.0)) for n, v in sums.items()} | {f"_t_{n}": v for n, v in latest.items()}).filter("_e < _l")
    out = seen.select(key, F.explode(F.array(F.struct(F.col("_e").alias("at"), F.lit(1.0).alias("sign")), F.struct(F.col("_l").alias("at"), F.lit(-1.0).alias("sign")))).alias("_p"), *[f"_x_{n}" for n in sums], *[f"_t_{n}" for n in latest])
    steps = out.groupBy(key, F.col("_p.at").alias("_when")).agg(
        *[F.sum(F.col(f"_x_{n}") * F.col("_p.sign")).alias(f"_x_{n}") for n in sums], *[F.max(F.when(F.col("_p.sign") > 0, F.col(f"_t_{n}"))).alias(f"_t_{n}") for n in latest])
    ticks = rows.select(key, F.col("obs").alias("_when")).distinct().withColumn("_tick", F.lit(1))
    line = steps.withColumn("_tick", F.lit(0)).unionByName(ticks, allowMissingColumns=True)
    swept_line = ordered.running(line, [key], ["_when", "_tick"], {n: f"_x_{n}" for n in sums}, maxes={n: f"_t_{n}" for n in latest})
    late = {n: F.when(F.col(n) >= F.col("obs") - reach, F.col(n)) for n in latest}
    told = swept_line.filter("_tick = 1").withColumnRenamed("_when", "obs").withColumns(late).select(key, "obs", *sums, *latest)
    return rows.join(told, [key, "obs"], "left")


def label(rows: DataFrame, outages: DataFrame, horizon_minutes: int) -> DataFrame:
    """Adds label, outage_id and label_end: an unplanned outage with obs < start <= obs + horizon, the earliest by (start, id)."""
    unplanned = outages.filter(~F.col("planned")).select("entity_id", "start_min", "outage_id")
    first = F.floor((F.col("start_min") - horizon_minutes) / horizon_minutes)
    dealt = unplanned.withColumn("_b", F.explode(F.sequence(first, F.floor(F.col("start_min") / horizon_minutes))))
    keyed = rows.select("entity_id", "obs").distinct().withColumn("_b", F.floor(F.col("obs") / horizon_minutes))
    hit = keyed.join(dealt, ["entity_id", "_b"]).filter((F.col("start_min") > F.col("obs")) & (F.col("start_min") <= F.col("obs") + horizon_minutes))
    best = hit.groupBy("entity_id", "obs").agg(F.min(F.struct("start_min", "outage_id")).alias("_o"))
    return rows.join(best, ["entity_id", "obs"], "left").select(*rows.columns, F.col("_o").isNotNull().cast("int").alias("label"), F.col("_o.outage_id").alias("outage_id"), (F.col("obs") + horizon_minutes).alias("label_end"))


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1.0).otherwise(0.0))


def telemetry_features(rows: DataFrame, telemetry: DataFrame, reach: int) -> DataFrame:
    """17 measures of substation telemetry; 0 where there is none."""
    c = F.col
    aggs = {
        "telemetry_observation_count": F.count("*").cast("double"), "mean_load_mw": F.avg("load_mw"), "maximum_load_mw": F.max("load_mw"), "load_standard_deviation": F.stddev_pop("load_mw"),
        "mean_utilisation_pct": F.avg("utilisation_pct"), "maximum_utilisation_pct": F.max("utilisation_pct"), "high_utilisation_count": _n(c("utilisation_pct") >= 80), "high_utilisation_share": share(_n(c("utilisation_pct") >= 80), F.count("*")),
        "mean_transformer_temperature_c": F.avg("transformer_temperature_c"), "maximum_transformer_temperature_c": F.max("transformer_temperature_c"), "temperature_warning_count": _n(c("transformer_temperature_c") >= 75),
        "alarm_count": _n(F.coalesce(c("alarm_code"), F.lit("")) != ""), "offline_count": _n(c("operational_status") == "offline"), "constrained_count": _n(c("operational_status") == "constrained"),
        "frequency_deviation_count": _n(F.abs(c("frequency_hz") - 50) >= 0.05), "voltage_deviation_count": _n((c("voltage_kv") < 32) | (c("voltage_kv") > 34))}
    out = looked_back(rows, telemetry, reach, [v.alias(k) for k, v in aggs.items()], defaults=dict.fromkeys(aggs, 0.0))
    return out.withColumn("breaker_open_count", F.lit(0.0))


WEATHER = ("temperature_c", "humidity_pct", "wind_speed_mps", "wind_gust_mps", "precipitation_mm", "pressure_hpa")


def weather_features(rows: DataFrame, weather: DataFrame, reach: int, key: str = "grid_region") -> DataFrame:
    """The latest weather in reach (as-of with a tolerance), and its severe count, rain total and largest gust."""
    late = F.max_by(F.struct(*[F.coalesce(F.col(w).cast("double"), F.lit(0.0)).alias(w) for w in WEATHER], F.coalesce(F.col("severe_weather_flag").cast("double"), F.lit(0.0)).alias("severe_weather_flag")), "ts_min")
    names = [*WEATHER, "severe_weather_flag", "recent_severe_weather_count", "recent_precipitation_total", "recent_maximum_wind_gust"]
    out = looked_back(rows, weather, reach, [late.alias("_late"), _n(F.col("severe_weather_flag")).alias("recent_severe_weather_count"), F.sum("precipitation_mm").alias("recent_precipitation_total"), F.max("wind_gust_mps").alias("recent_maximum_wind_gust")], key=key)
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_late.{n}") if n in (*WEATHER, "severe_weather_flag") else F.col(n), F.lit(0.0)).alias(n) for n in names])


def meter_features(rows: DataFrame, meters: DataFrame, reach: int) -> DataFrame:
    """Seven measures of meter readings; the change is last minus first by time, then id; coverage expects two readings a meter.

    Readings are added up by entity and minute before they meet observations. A meter counts by its latest reading, which is seen until its
    next one, so the number of meters is a sum that a sweep gives, and no reading is repeated for each observation that sees it.
    """
    c = F.col
    energy, nth = c("active_energy_kwh"), c("event_id")
    # Readings without an id come first in their minute.
    first = F.when(F.count(nth) < F.count("*"), F.min(F.when(nth.isNull(), energy))).otherwise(F.min_by(energy, nth))
    last = F.when(F.count(nth) == 0, F.max(energy)).otherwise(F.max_by(energy, nth))
    minutes = meters.groupBy("entity_id", "ts_min").agg(
        F.count("*").alias("_n"), F.sum(energy).alias("_sum"), first.alias("_first"), last.alias("_last"), _n(c("quality_code") == "ESTIMATED").alias("_estimated"), _n((c("voltage_v") < 216) | (c("voltage_v") > 253)).alias("_voltage"))
    n = F.sum("_n")
    aggs = {
        "_readings": n.cast("double"), "aggregate_energy_kwh": F.sum("_sum"), "energy_change_rate": F.max_by("_last", "ts_min") - F.min_by("_first", "ts_min"),
        "estimated_reading_share": share(F.sum("_estimated"), n), "missing_reading_share": F.lit(0.0) * n, "voltage_quality_issue_count": F.sum("_voltage")}
    told = looked_back(rows, minutes, reach, [v.alias(k) for k, v in aggs.items()], defaults=dict.fromkeys(aggs, 0.0) | {"missing_reading_share": 1.0})
    known = meters.select("entity_id", "meter_id", "ts_min").filter("meter_id IS NOT NULL AND ts_min IS NOT NULL")
    known = known.withColumn("_next", F.lead("ts_min").over(Window.partitionBy("entity_id", "meter_id").orderBy("ts_min")))
    told = swept(told, known, c("ts_min"), F.least(c("ts_min") + reach + 1, c("_next")), {"meter_count": F.lit(1)}, {}, reach).fillna({"meter_count": 0.0})
    cover = F.when(c("_readings") > 0, F.least(F.lit(1.0), c("_readings") / F.greatest(F.lit(1.0), c("meter_count") * 2))).otherwise(0.0)
    return told.withColumn("meter_coverage_ratio", cover).select(
        *rows.columns, "aggregate_energy_kwh", "energy_change_rate", "meter_count", "meter_coverage_ratio", "estimated_reading_share", "missing_reading_share", "voltage_quality_issue_count")


def maintenance_features(rows: DataFrame, bridge: DataFrame, logs: DataFrame, reach: int) -> DataFrame:
    """Six measures of the maintenance of an entity's assets; bridge is (entity_id, asset_id). Times are the logs' ts_min."""
    c = F.col
    linked = bridge.select("entity_id", "asset_id").distinct().join(logs, "asset_id").filter("ts_min IS NOT NULL")
    one = lambda x: F.when(x, 1).otherwise(0)
    sums = {"recent_corrective_maintenance_count": one(c("maintenance_type") == "corrective"), "recent_emergency_maintenance_count": one(c("maintenance_type") == "emergency"),
            "deferred_maintenance_count": one(c("maintenance_status") == "deferred"), "follow_up_required_count": one(c("follow_up_required")), "recent_downtime_minutes": c("downtime_minutes")}
    out = swept(rows, linked, c("ts_min"), c("ts_min") + reach + 1, sums, {"_done": F.when(c("maintenance_status") == "completed", c("ts_min"))}, reach)
    days = (F.floor(F.col("obs") / 1440) - F.floor(F.col("_done") / 1440)).cast("double")
    return out.withColumn("days_since_last_completed_maintenance", F.coalesce(days, F.lit(NEVER))).drop("_done")


def prior_outage_features(rows: DataFrame, outages: DataFrame, reach: int) -> DataFrame:
    """Five measures of unplanned outages that began in reach before obs and were over by then."""
    c = F.col
    one = lambda x: F.when(x, 1).otherwise(0)
    sums = {"prior_unplanned_outage_count": F.lit(1), "prior_equipment_failure_outage_count": one(c("cause") == "equipment_failure"), "prior_severe_weather_outage_count": one(c("severe")),
            "historical_outage_duration_minutes": c("duration_minutes")}
    over = F.greatest("end_min", c("start_min") + 1)  # began before obs, and ended by then
    seen = outages.filter(~c("planned") & c("start_min").isNotNull() & c("end_min").isNotNull())
    out = swept(rows, seen, over, c("start_min") + reach + 1, sums, {"_last": c("start_min")}, reach)
    days = (F.floor(F.col("obs") / 1440) - F.floor(F.col("_last") / 1440)).cast("double")
    return out.withColumn("days_since_previous_unplanned_outage", F.coalesce(days, F.lit(NEVER))).drop("_last")


def asset_features(rows: DataFrame, bridge: DataFrame, assets: DataFrame) -> DataFrame:
    """Five measures of an entity's assets at the observation's date; assets have commissioned_day and due_day (days since 1970)."""
    tier = F.create_map(*[F.lit(x) for kv in {"tier_1": 3.0, "tier_2": 2.0, "tier_3": 1.0}.items() for x in kv])
    status = F.create_map(*[F.lit(x) for kv in {"active": 0.0, "standby": 1.0, "maintenance": 2.0, "retired": 3.0}.items() for x in kv])
    day = F.floor(F.col("obs") / 1440)
    age = F.greatest(F.lit(0.0), (day - F.col("commissioned_day")) / 365.25)
    aggs = {"asset_age_years": F.avg(age), "age_to_expected_life_ratio": F.avg(age / F.greatest(F.lit(1.0), F.col("expected_life_years"))), "criticality_tier_score": F.max(F.coalesce(F.try_element_at(tier, F.col("criticality_tier")), F.lit(0.0))),
            "operational_status_score": F.max(F.coalesce(F.try_element_at(status, F.col("operational_status")), F.lit(0.0))), "inspection_overdue_flag": F.max(F.when(F.col("due_day") < day, 1.0).otherwise(0.0))}
    joined = rows.select("entity_id", "obs").distinct().join(bridge.join(assets, "asset_id"), "entity_id").groupBy("entity_id", "obs").agg(*[v.alias(k) for k, v in aggs.items()])
    return rows.join(joined, ["entity_id", "obs"], "left").fillna(dict.fromkeys(aggs, 0.0))


def band(score: str = "score", completeness: str | None = None, least: float = 0.0) -> Column:
    out = ladder(F.col(score), BANDS, "LOW", descending=True)
    return out if completeness is None else F.when(F.col(completeness) < least, "INSUFFICIENT_DATA").otherwise(out)


def reasons(rows: DataFrame, keep: int = 5) -> DataFrame:
    """Reason codes by falling priority; features that a row lacks count as 0 (completeness: 1)."""
    def v(name, default=0.0):
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in rows.columns else F.lit(default)

    ratio = v("age_to_expected_life_ratio")
    rules = [
        (v("prior_unplanned_outage_count") > 0, "RECENT_UNPLANNED_OUTAGE"), (v("alarm_count") >= 2, "REPEATED_OPERATIONAL_ALARMS"), (v("high_utilisation_share") >= 0.5, "SUSTAINED_HIGH_UTILISATION"),
        (v("temperature_warning_count") > 0, "PEAK_TEMPERATURE_STRESS"), (v("offline_count") > 0, "RECENT_OFFLINE_STATE"), (v("constrained_count") > 0, "RECENT_CONSTRAINED_STATE"),
        ((v("severe_weather_flag") > 0) | (v("recent_severe_weather_count") > 0), "SEVERE_WEATHER_EXPOSURE"), (v("recent_maximum_wind_gust") >= 15, "HIGH_WIND_EXPOSURE"), (v("recent_precipitation_total") >= 8, "HEAVY_PRECIPITATION_EXPOSURE"),
        (v("inspection_overdue_flag") > 0, "INSPECTION_OVERDUE"), (v("recent_corrective_maintenance_count") > 0, "RECENT_CORRECTIVE_MAINTENANCE"), (v("recent_emergency_maintenance_count") > 0, "RECENT_EMERGENCY_MAINTENANCE"),
        (v("deferred_maintenance_count") > 0, "DEFERRED_MAINTENANCE"), (v("follow_up_required_count") > 0, "FOLLOW_UP_WORK_OUTSTANDING"), (ratio >= 1, "AGE_BEYOND_EXPECTED_LIFE"), ((ratio >= 0.85) & (ratio < 1), "AGE_NEAR_EXPECTED_LIFE"),
        (v("completeness", 1.0) < 0.75, "POOR_DATA_COMPLETENESS")]
    return rows.withColumn("reason_codes", codes(rules, keep, "LOW_RECENT_STRESS"))
