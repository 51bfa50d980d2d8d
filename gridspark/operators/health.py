"""Asset health: evidence per asset, component scores, composite, reasons and maintenance priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, codes, ladder, share
from . import ordered

#: Weights and bands of the composite, and scores where evidence is missing.
WEIGHTS = {"age": 0.18, "inspection": 0.17, "maintenance": 0.20, "telemetry": 0.20, "alarm": 0.10, "outage": 0.15}
BANDS = [(35.0, "CRITICAL"), (55.0, "DEGRADED"), (75.0, "WATCH")]
MISSING = {"neutral": 50.0, "penalize": 40.0}


def population(assets: DataFrame, types: list[str] | None = None, now_day: int | None = None) -> DataFrame:
    """Assets of the given types; raises ValueError for repeated ids, lives that aren't positive and commissioning after now_day."""
    kept = assets.filter(F.col("asset_type").isin(types)) if types else assets
    count = lambda x: F.coalesce(F.sum(x.cast("int")), F.lit(0))
    early = F.col("commissioned_day") > now_day if now_day is not None else F.lit(False)
    n, ids, bad, ahead = kept.agg(F.count("*"), F.count_distinct("asset_id"), count(F.col("expected_life_years") <= 0), count(early)).collect()[0]
    if n != ids or bad or ahead:
        raise ValueError(f"{n - ids} repeated ids, {bad} lives that aren't positive, {ahead} commissioned in the future")
    return kept


def maintenance_evidence(assets: DataFrame, logs: DataFrame, now_day: int, lookback_days: int = 365) -> DataFrame:
    """Eleven measures per asset from logs (asset_id, day, maintenance_type, maintenance_status, downtime_minutes, cost, follow_up)."""
    c = F.col
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    recent = logs.filter((c("day") <= now_day) & (c("day") >= now_day - lookback_days))
    aggs = recent.groupBy("asset_id").agg(
        F.count("*").alias("maintenance_count"), n(c("maintenance_type") == "corrective").alias("corrective_count"), n(c("maintenance_type") == "preventive").alias("preventive_count"), n(c("maintenance_type") == "emergency").alias("emergency_count"),
        n(c("maintenance_status") == "deferred").alias("deferred_count"), n(c("follow_up")).alias("follow_up_count"), F.sum("downtime_minutes").cast("long").alias("downtime_minutes"), F.sum("cost").alias("maintenance_cost"),
        F.avg("cost").alias("mean_cost"), F.max(F.when(c("maintenance_status") == "completed", c("day"))).alias("last_completed_day"))
    zero = [x for x in aggs.columns if x.endswith("_count")] + ["downtime_minutes"]
    out = assets.join(aggs, "asset_id", "left").withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in zero} | {"maintenance_cost": F.coalesce("maintenance_cost", F.lit(0.0))})
    return out.withColumns({"corrective_share": share(c("corrective_count"), c("maintenance_count")), "maintenance_overdue": (c("last_completed_day").isNull() | (F.lit(now_day) - c("last_completed_day") > 365))})


def telemetry_evidence(assets: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Telemetry by the asset's link: its substation for primary substations, else its feeder, else its substation.

    Events are dealt to both kinds of link, so this is one equi-join; measures are null without rows.
    """
    c = F.col
    kind = F.when((c("asset_type") == "primary_substation") | c("feeder_id").isNull(), "substation").otherwise("feeder")
    linked = assets.select("asset_id", kind.alias("link"), F.when(kind == "substation", c("substation_id")).otherwise(c("feeder_id")).alias("link_id"))
    dealt = telemetry.withColumn("_l", F.explode(F.array(F.struct(F.lit("substation").alias("link"), c("substation_id").alias("link_id")), F.struct(F.lit("feeder").alias("link"), c("feeder_id").alias("link_id"))))).select("*", "_l.link", "_l.link_id")
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    # Aggregated per link before assets multiply the rows.
    per = dealt.groupBy("link", "link_id").agg(
        F.count("*").alias("telemetry_count"), F.avg("utilisation_pct").alias("mean_utilisation"), F.max("utilisation_pct").alias("max_utilisation"), share(n(c("utilisation_pct") >= 90), F.count("*")).alias("high_utilisation_share"),
        F.avg("transformer_temperature_c").alias("mean_temperature"), F.max("transformer_temperature_c").alias("max_temperature"), share(n(c("transformer_temperature_c") >= 75), F.count("*")).alias("high_temperature_share"),
        n(F.coalesce(c("alarm_code"), F.lit("")) != "").alias("alarm_count"), n(c("operational_status") == "offline").alias("offline_count"), n(c("operational_status") == "constrained").alias("constrained_count"), F.max("ts_min").alias("last_telemetry_min"))
    return assets.join(linked.join(per, ["link", "link_id"]).drop("link", "link_id"), "asset_id", "left").withColumn("telemetry_count", F.coalesce("telemetry_count", F.lit(0).cast("long")))


def linked_outages(assets: DataFrame, outages: DataFrame) -> DataFrame:
    """(asset_id, outage_id, direct, outage columns): an outage whose primary asset, feeder or substation is the asset's.

    A union of three equi-joins, then one row per pair; direct means the primary asset.
    """
    o = outages.select([F.col(x).alias(f"o_{x}" if x in assets.columns else x) for x in outages.columns])
    name = lambda x: f"o_{x}" if x in assets.columns else x
    ids = assets.select("asset_id", "feeder_id", "substation_id")
    parts = []
    for mine, theirs, direct in (("asset_id", "primary_asset_id", True), ("feeder_id", "feeder_id", False), ("substation_id", "substation_id", False)):
        right = o.withColumn("_k", F.col(name(theirs)))
        parts.append(ids.select(F.col("asset_id").alias("_a"), F.col(mine).alias("_k")).filter("_k is not null").join(right, "_k").drop("_k").withColumn("direct", F.lit(direct)))
    both = reduce(DataFrame.unionByName, parts)
    rest = [x for x in both.columns if x not in ("_a", "outage_id", "direct")]
    one = both.groupBy("_a", "outage_id").agg(F.max("direct").alias("direct"), F.first(F.struct(*rest)).alias("_r"))
    keep = [x for x in rest if not x.startswith("o_")]
    return one.select(F.col("_a").alias("asset_id"), "outage_id", "direct", *[F.col(f"_r.{x}").alias(x) for x in keep])


def outage_evidence(assets: DataFrame, outages: DataFrame) -> DataFrame:
    """Nine measures: direct ones of the asset itself, contextual ones of its feeder or substation.

    Contextual outages are those of the feeder, plus those of the substation, less those of both, less the asset's own among them.
    So outages are summed per asset, feeder, substation and pair of these, and no row stands for a pair of asset and outage;
    `linked_outages` lists the pairs for those who need them. Needs unique outage ids.
    """
    c = F.col
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    ids = assets.select("asset_id", c("feeder_id").alias("_f"), c("substation_id").alias("_s"))
    near = F.coalesce(c("feeder_id") == c("_f"), F.lit(False)) | F.coalesce(c("substation_id") == c("_s"), F.lit(False))
    own = outages.drop("asset_id").withColumnRenamed("primary_asset_id", "asset_id").join(ids, "asset_id").withColumn("_near", near).groupBy("asset_id").agg(
        F.count("*").alias("direct_outage_count"), n(~c("planned")).alias("direct_unplanned_count"), n(c("planned")).alias("direct_planned_count"), n(c("cause") == "equipment_failure").alias("equipment_failure_count"),
        F.sum("duration_minutes").cast("long").alias("direct_minutes"), F.sum("customers").cast("long").alias("direct_customers"), F.max("start_min").alias("last_direct_start"), n(c("_near")).alias("_own"), n(c("_near") & c("severe")).alias("_own_severe"))
    both = outages.groupBy("feeder_id", "substation_id").agg(F.count("*").alias("k"), n(c("severe")).alias("v"))
    per = lambda by: both.filter(reduce(lambda x, y: x & y, [c(b).isNotNull() for b in by])).groupBy(*by).agg(F.sum("k").alias("_".join(["_k", *by])), F.sum("v").alias("_".join(["_v", *by])))
    out = assets.join(own, "asset_id", "left")
    for by in (["feeder_id"], ["substation_id"], ["feeder_id", "substation_id"]):
        out = out.join(per(by), by, "left")
    known = lambda x: F.coalesce(c(x), F.lit(0).cast("long"))
    around = lambda x, mine: known(f"_{x}_feeder_id") + known(f"_{x}_substation_id") - known(f"_{x}_feeder_id_substation_id") - known(mine)
    zero = [x for x in own.columns if x not in ("asset_id", "last_direct_start", "_own", "_own_severe")]
    return out.withColumns({x: known(x) for x in zero} | {"contextual_count": around("k", "_own"), "contextual_severe_count": around("v", "_own_severe")}).select(*assets.columns, *zero, "contextual_count", "contextual_severe_count", "last_direct_start")


def component_scores(f: DataFrame, now_day: int, missing: str = "neutral") -> DataFrame:
    """Six scores in [0, 100], their weighted sum, completeness and band.

    Needs commissioned_day, expected_life_years, next_due_day, last_inspection_day, criticality and the evidence columns.
    """
    c = F.col
    none = F.lit(MISSING[missing])
    age = (F.lit(now_day) - c("commissioned_day")) / 365.25
    r = age / c("expected_life_years")
    overdue = F.greatest(F.lit(now_day) - c("next_due_day"), F.lit(0))
    ahead = F.greatest(c("next_due_day") - now_day, F.lit(0))
    scores = {
        "age": F.when(r <= 0.5, clamp(100 - 20 * r)).when(r <= 1, clamp(90 - 60 * (r - 0.5) / 0.5)).otherwise(clamp(30 - 30 * F.least(F.lit(1.0), r - 1))),
        "inspection": F.when(overdue > 0, clamp(70 - 70 * F.least(F.lit(365), overdue) / 365)).when(ahead >= 180, 100.0).otherwise(clamp(80 + 20 * ahead / 180)),
        "maintenance": F.when(c("maintenance_count") == 0, none).otherwise(clamp(100 - (25 * share(c("corrective_count"), c("maintenance_count")) + 30 * share(c("emergency_count"), c("maintenance_count")) + 12 * F.least(F.lit(3), c("deferred_count")) + 8 * F.least(F.lit(3), c("follow_up_count")) + 20 * F.least(F.lit(1.0), c("downtime_minutes") / 720)))),
        "telemetry": F.when(c("telemetry_count") == 0, none).otherwise(clamp(100 - (0.8 * F.greatest(F.lit(0.0), c("mean_utilisation") - 75) + 0.6 * F.greatest(F.lit(0.0), c("max_utilisation") - 95) + 25 * c("high_utilisation_share") + 25 * c("high_temperature_share") + 8 * F.least(F.lit(5), c("offline_count") + c("constrained_count"))))),
        "alarm": F.when(c("telemetry_count") == 0, none).otherwise(clamp(100 - 12.0 * F.least(F.lit(8), c("alarm_count")))),
        "outage": clamp(100 - (25.0 * c("direct_unplanned_count") + 15 * c("equipment_failure_count") + 20 * F.least(F.lit(1.0), c("direct_minutes") / 720) + 4 * F.least(F.lit(4), c("contextual_count"))))}
    out = f.withColumns({"age_ratio": r, "inspection_overdue_days": overdue} | {f"{n}_score": s for n, s in scores.items()})
    total = reduce(lambda a, b: a + b, [c(f"{n}_score") * w for n, w in WEIGHTS.items()])
    has = lambda x: F.when(c(x) > 0, 1).otherwise(0)
    done = (F.lit(2) + has("maintenance_count") + has("telemetry_count") + F.when(c("direct_outage_count") + c("contextual_count") > 0, 1).otherwise(0)) / 5.0
    return out.withColumns({"health_score": total, "completeness": done}).withColumn("health_band", health_band())


def health_band(score: str = "health_score", completeness: str = "completeness", least: float = 0.4) -> Column:
    return F.when(F.col(completeness) < least, "INSUFFICIENT_DATA").otherwise(ladder(F.col(score), BANDS, "HEALTHY"))


def reasons(f: DataFrame, now_day: int, keep: int = 5) -> DataFrame:
    """Reason codes (fixed values, in their fixed order), cut to `keep`."""
    c = F.col
    told, r, share_high = c("telemetry_count") > 0, c("age_ratio"), c("high_utilisation_share")
    rules = [
        (r > 1, "AGE_BEYOND_EXPECTED_LIFE"), ((r >= 0.85) & (r <= 1), "AGE_NEAR_EXPECTED_LIFE"), (c("inspection_overdue_days") > 0, "INSPECTION_OVERDUE"),
        ((c("inspection_overdue_days") <= 0) & (F.lit(now_day) - c("last_inspection_day") <= 180), "GOOD_RECENT_INSPECTION"), (c("deferred_count") > 0, "MAINTENANCE_DEFERRED"), (c("corrective_share") >= 0.5, "HIGH_CORRECTIVE_MAINTENANCE_SHARE"),
        (c("emergency_count") > 0, "RECENT_EMERGENCY_MAINTENANCE"), (c("follow_up_count") > 0, "FOLLOW_UP_WORK_OUTSTANDING"), (~told, "INSUFFICIENT_TELEMETRY"), (told & (share_high >= 0.25), "SUSTAINED_HIGH_UTILISATION"),
        (told & (share_high < 0.25), "LOW_OPERATIONAL_STRESS"), (told & (c("max_temperature") >= 75), "PEAK_TEMPERATURE_STRESS"), (c("alarm_count") >= 2, "REPEATED_OPERATIONAL_ALARMS"), (c("direct_unplanned_count") > 0, "RECENT_DIRECT_UNPLANNED_OUTAGE"),
        (c("equipment_failure_count") > 0, "EQUIPMENT_FAILURE_OUTAGE_HISTORY"), (c("maintenance_count") == 0, "INSUFFICIENT_MAINTENANCE_HISTORY"), (c("operational_status") == "maintenance", "STATUS_MAINTENANCE"), (c("operational_status") == "retired", "STATUS_RETIRED")]
    return f.withColumn("reason_codes", codes(rules, keep))


#: Maintenance priorities, the most urgent first.
PRIORITIES = ("P1_IMMEDIATE_REVIEW", "P2_HIGH", "P3_MEDIUM", "P4_ROUTINE")
DATA_REVIEW = "DATA_REVIEW_REQUIRED"


def priority(f: DataFrame) -> DataFrame:
    """Adds maintenance_priority, by band, criticality (3 is highest) and what presses, and priority_reasons, what it is for."""
    c = F.col
    b, high = c("health_band"), c("criticality") >= 3
    first, second, third, last = map(F.lit, PRIORITIES)
    presses = [(c("inspection_overdue_days") > 0, "INSPECTION_OVERDUE"), (c("deferred_count") > 0, "MAINTENANCE_DEFERRED"), (c("direct_unplanned_count") > 0, "RECENT_DIRECT_UNPLANNED_OUTAGE"),
               (c("operational_status") == "maintenance", "STATUS_MAINTENANCE"), (c("operational_status") == "retired", "STATUS_RETIRED")]
    told = F.array_compact(F.array(*[F.when(x, F.lit(r)) for x, r in presses]))
    some, weak = F.size(told) > 0, b.isin("DEGRADED", "WATCH")
    rule = (F.when(b == "INSUFFICIENT_DATA", DATA_REVIEW).when((b == "CRITICAL") & high, first).when(b == "CRITICAL", second).when((b == "DEGRADED") & high, second)
            .when(some & ((b == "WATCH") | (c("criticality") >= 2)), second).when(weak | some, third).otherwise(last))
    why = (F.when(b == "INSUFFICIENT_DATA", F.array(F.lit("INSUFFICIENT_DATA"))).when((b == "CRITICAL") & high, F.array(F.lit("CRITICAL_HEALTH_HIGH_CRITICALITY"))).when(b == "CRITICAL", F.array(F.lit("CRITICAL_HEALTH")))
           .when((b == "DEGRADED") & high, F.array(F.lit("DEGRADED_HEALTH_HIGH_CRITICALITY"))).when(some, told).when(weak, F.array(b)).otherwise(F.array(F.lit("ROUTINE_REVIEW"))))
    return f.withColumns({"maintenance_priority": rule, "priority_reasons": why})


def fleet(f: DataFrame, by: list[str]) -> DataFrame:
    """Scores and completeness by group, with exact medians of groups of any size."""
    whole = f.groupBy(*by).agg(
        F.count("*").alias("assets"), F.avg("health_score").alias("mean_score"), F.min("health_score").alias("min_score"), F.max("health_score").alias("max_score"), F.avg("completeness").alias("mean_completeness"))
    middle = ordered.median(ordered.value_ranks(f, by, "health_score"), by, "health_score", "median_score")
    return whole.join(middle, by, "left").select(*by, "assets", "mean_score", "median_score", "min_score", "max_score", "mean_completeness")


def reason_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., reason, n): how many rows carry each reason code."""
    return rows.select(*(by or []), F.explode("reason_codes").alias("reason")).groupBy(*(by or []), "reason").agg(F.count("*").alias("n"))
