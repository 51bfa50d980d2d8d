"""Registered queries over the star-schema tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import star_queries
from .functions.scalar import calendar
from .operators import health, mart, metrics, models, monitoring, reliability, retrieval, risk, series, splits, validation
from .plans import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The reporting period of the interruption queries, in minutes since 1970: 1995-01-01 to 2002-01-01.
START, END = 13147200, 16829280
LEVELS = {"region": "region", "substation": "substation_id", "feeder": "feeder_id"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else "WITH " + sql
        return f

    return add


def _outages(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return reliability.shared_rows(a.outages(s, d), [*LEVELS.values(), *columns])


LEVELLED = a.OUTAGES + """, lv AS (SELECT *, 'region' AS level, region AS entity_id FROM outages UNION ALL SELECT *, 'substation', CAST(substation_id AS VARCHAR) FROM outages UNION ALL SELECT *, 'feeder', CAST(feeder_id AS VARCHAR) FROM outages),
spine AS (SELECT DISTINCT 'region' AS level, region AS entity_id FROM hier UNION SELECT 'substation', CAST(substation_id AS VARCHAR) FROM hier UNION SELECT 'feeder', CAST(feeder_id AS VARCHAR) FROM hier),
pop AS (SELECT s.level, s.entity_id, count(DISTINCT member) AS population FROM spine s LEFT JOIN lv ON lv.level = s.level AND lv.entity_id = s.entity_id GROUP BY ALL)"""
MERGED = """, ms AS (SELECT level, entity_id, start_min, end_min, max(end_min) OVER (PARTITION BY level, entity_id ORDER BY start_min, end_min ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM lv WHERE duration_minutes >= 5),
mi AS (SELECT *, sum(CASE WHEN r IS NULL OR start_min >= r THEN 1 ELSE 0 END) OVER (PARTITION BY level, entity_id ORDER BY start_min, end_min ROWS UNBOUNDED PRECEDING) AS i FROM ms),
mm AS (SELECT level, entity_id, i, max(end_min) - min(start_min) AS m, count(*) AS n FROM mi GROUP BY ALL),
merged AS (SELECT level, entity_id, sum(m) AS merged_minutes, sum(n) - count(*) AS overlap_count FROM mm GROUP BY ALL)"""
KPI = LEVELLED + MERGED + f""", agg AS (SELECT level, entity_id, count(*) AS outage_count, count(*) FILTER (duration_minutes >= 5) AS sustained_count, count(*) FILTER (NOT planned) AS unplanned_count, count(*) FILTER (planned) AS planned_count, count(*) FILTER (severe) AS severe_count, count(*) FILTER (cause = 'equipment_failure') AS equipment_count,
  count(*) FILTER (duration_minutes >= 180) AS prolonged_count, count(*) FILTER (duration_minutes BETWEEN 5 AND 180) AS restored, sum(customers) FILTER (duration_minutes >= 5) AS ci, sum(customers * duration_minutes) FILTER (duration_minutes >= 5) AS cmi, avg(duration_minutes) FILTER (duration_minutes >= 5) AS mean_duration,
  median(duration_minutes) FILTER (duration_minutes >= 5) AS median_duration, max(duration_minutes) FILTER (duration_minutes >= 5) AS max_duration, sum(load_mw) AS load_lost FROM lv GROUP BY ALL),
k0 AS (SELECT pop.level, pop.entity_id, population, coalesce(outage_count, 0) AS outage_count, coalesce(sustained_count, 0) AS sustained_count, coalesce(unplanned_count, 0) AS unplanned_count, coalesce(planned_count, 0) AS planned_count, coalesce(severe_count, 0) AS severe_count, coalesce(equipment_count, 0) AS equipment_count, coalesce(prolonged_count, 0) AS prolonged_count, coalesce(restored, 0) AS restored,
  CAST(coalesce(ci, 0) AS BIGINT) AS customer_interruptions, CAST(coalesce(cmi, 0) AS BIGINT) AS customer_minutes, mean_duration, median_duration, max_duration, coalesce(load_lost, 0) AS load_lost, CAST(coalesce(merged_minutes, 0) AS BIGINT) AS merged_minutes, CAST(coalesce(overlap_count, 0) AS BIGINT) AS overlap_count
  FROM pop LEFT JOIN agg ON agg.level = pop.level AND agg.entity_id = pop.entity_id LEFT JOIN merged ON merged.level = pop.level AND merged.entity_id = pop.entity_id),
k AS (SELECT *, customer_interruptions::DOUBLE / nullif(population, 0) AS saifi, customer_minutes::DOUBLE / nullif(population, 0) AS saidi_minutes, customer_minutes::DOUBLE / nullif(customer_interruptions, 0) AS caidi_minutes, CASE WHEN population > 0 THEN least(1, greatest(0, 1 - least(customer_minutes, population * merged_minutes)::DOUBLE / (population * {END - START}::BIGINT))) END AS asai, restored::DOUBLE / nullif(sustained_count, 0) AS restoration_rate FROM k0)"""
SCORE = KPI + """, sc AS (SELECT *, CASE WHEN population >= 1 THEN 0.25 * coalesce(least(100, greatest(0, 100 * (1 - saifi / 5))), 100) + 0.25 * coalesce(least(100, greatest(0, 100 * (1 - saidi_minutes / 720))), 100) + 0.15 * coalesce(least(100, greatest(0, 100 * (1 - mean_duration / 240))), 100)
  + 0.20 * coalesce(100 * asai, 0) + 0.05 * least(100, greatest(0, 100 * (1 - severe_count / 3.0::DOUBLE))) + 0.05 * least(100, greatest(0, 100 * (1 - equipment_count / 3.0::DOUBLE))) + 0.05 * 100 END AS reliability_score FROM k)"""


def _kpis(s: SparkSession, d: str) -> DataFrame:
    return reliability.kpis_by_level(a.outages(s, d), LEVELS, a.hierarchy(s, d), "member", END - START)


@query("rel_kpi", KPI + " SELECT level, entity_id, population, outage_count, sustained_count, customer_interruptions, customer_minutes, mean_duration, median_duration, max_duration, load_lost, saifi, saidi_minutes, caidi_minutes, asai, 1 - asai AS asui, restoration_rate FROM k")
def rel_kpi(s, d):
    return _kpis(s, d).select("level", "entity_id", "population", "outage_count", "sustained_count", "customer_interruptions", "customer_minutes", "mean_duration", "median_duration", "max_duration", "load_lost", "saifi", "saidi_minutes", "caidi_minutes", "asai", "asui", "restoration_rate")


@query("rel_merge_intervals", LEVELLED + MERGED + " SELECT level, entity_id, CAST(merged_minutes AS BIGINT) AS merged_minutes, CAST(overlap_count AS BIGINT) AS overlap_count FROM merged")
def rel_merge_intervals(s, d):
    rows = _outages(s, d, "start_min", "end_min", "duration_minutes").filter("duration_minutes >= 5")
    return reliability.per_level(LEVELS, lambda c: reliability.merged_minutes(rows, [c]))


@query("rel_population_levels", LEVELLED + " SELECT * FROM pop")
def rel_population_levels(s, d):
    rows, spine = _outages(s, d, "member"), a.hierarchy(s, d)
    return reliability.per_level(LEVELS, lambda c: reliability.population(rows, spine, "member", [c]))


@query("rel_score_reasons", SCORE + """ SELECT level, entity_id, reliability_score, CASE WHEN reliability_score IS NULL THEN 'INSUFFICIENT_DATA' WHEN reliability_score <= 50 THEN 'WEAK' WHEN reliability_score <= 70 THEN 'WATCH' WHEN reliability_score <= 85 THEN 'STABLE' ELSE 'STRONG' END AS reliability_band,
  array_to_string(list_filter([CASE WHEN population < 1 THEN 'LOW_DATA_COMPLETENESS' END, CASE WHEN population < 1 THEN 'INSUFFICIENT_POPULATION_DATA' END, CASE WHEN saifi >= 1 THEN 'HIGH_INTERRUPTION_FREQUENCY' END, CASE WHEN saidi_minutes >= 120 THEN 'HIGH_INTERRUPTION_DURATION' END, CASE WHEN mean_duration > 180 THEN 'LONG_RESTORATION_TIME' END, CASE WHEN asai < 0.99 THEN 'LOW_SERVICE_AVAILABILITY' END, CASE WHEN unplanned_count > 1 THEN 'REPEATED_UNPLANNED_OUTAGES' END, CASE WHEN severe_count > 0 THEN 'SEVERE_WEATHER_OUTAGE_EXPOSURE' END, CASE WHEN equipment_count > 0 THEN 'EQUIPMENT_FAILURE_OUTAGE_CONCENTRATION' END, CASE WHEN customer_interruptions > population THEN 'HIGH_CUSTOMER_INTERRUPTION_VOLUME' END, CASE WHEN prolonged_count > 0 THEN 'PROLONGED_OUTAGE_EVENT' END, CASE WHEN planned_count > 0 THEN 'PLANNED_OUTAGE_CONCENTRATION' END, CASE WHEN outage_count = 0 THEN 'INSUFFICIENT_OUTAGE_HISTORY' END, CASE WHEN unplanned_count = 0 THEN 'NO_UNPLANNED_OUTAGES' END, CASE WHEN asai >= 0.999 THEN 'STRONG_SERVICE_AVAILABILITY' END], lambda x: x IS NOT NULL)[1:5], '|') AS reason_codes FROM sc""")
def rel_score_reasons(s, d):
    return reliability.reasons(reliability.score(_kpis(s, d))).select("level", "entity_id", "reliability_score", "reliability_band", F.array_join("reason_codes", "|").alias("reason_codes"))


@query("rel_trend", a.OUTAGES + f""", p AS (SELECT region AS entity_id, (start_min - {START}) // (31 * 1440) AS period, duration_minutes, customers FROM outages WHERE start_min >= {START} AND start_min < {END}),
pop AS (SELECT region AS entity_id, count(DISTINCT member) AS population FROM outages GROUP BY ALL),
v AS (SELECT p.entity_id, period, any_value(population) AS pop, CAST(sum(customers) FILTER (duration_minutes >= 5) AS DOUBLE) AS ci, CAST(sum(customers * duration_minutes) FILTER (duration_minutes >= 5) AS DOUBLE) AS cmi FROM p JOIN pop ON pop.entity_id = p.entity_id GROUP BY ALL),
m AS (SELECT entity_id, period, 'saifi' AS metric, ci / pop AS current FROM v UNION ALL SELECT entity_id, period, 'saidi_minutes', cmi / pop FROM v UNION ALL SELECT entity_id, period, 'caidi_minutes', cmi / nullif(ci, 0) FROM v),
w AS (SELECT *, lag(current) OVER (PARTITION BY entity_id, metric ORDER BY period) AS previous FROM m)
SELECT entity_id, CAST(period AS BIGINT) AS period, metric, current, previous, current - previous AS change, 100 * (current - previous) / nullif(abs(previous), 0) AS pct_change, CASE WHEN current - previous IS NULL THEN 'NO_PRIOR_PERIOD' WHEN current - previous = 0 THEN 'UNCHANGED' WHEN current < previous THEN 'IMPROVED' ELSE 'DETERIORATED' END AS direction FROM w""")
def rel_trend(s, d):
    o = reliability.with_period(a.outages(s, d).withColumn("entity_id", F.col("region")), START, END, "monthly")
    pop = a.outages(s, d).groupBy(F.col("region").alias("entity_id")).agg(F.count_distinct("member").alias("population"))
    k = reliability.kpis(o, ["entity_id", "period"], pop, "period_minutes", overlap=False).withColumn("asai", F.lit(None).cast("double"))
    return reliability.trends(k, ["entity_id"]).filter("metric <> 'asai'").select("entity_id", "period", "metric", "current", "previous", "change", "pct_change", "direction")


@query("rel_benchmark", SCORE + """, u AS (SELECT level, entity_id, 'saifi' AS metric, saifi AS value FROM sc UNION ALL SELECT level, entity_id, 'saidi_minutes', saidi_minutes FROM sc UNION ALL SELECT level, entity_id, 'asai', asai FROM sc UNION ALL SELECT level, entity_id, 'reliability_score', reliability_score FROM sc)
SELECT level, entity_id, metric, value, median(value) OVER w AS benchmark, value - median(value) OVER w AS gap, CASE WHEN count(*) OVER w >= 2 THEN cume_dist() OVER (PARTITION BY level, metric ORDER BY value) END AS percentile FROM u WHERE value IS NOT NULL WINDOW w AS (PARTITION BY level, metric)""")
def rel_benchmark(s, d):
    return reliability.benchmarks(reliability.score(_kpis(s, d)), ["level"], ["level", "entity_id"])


@query("rel_system", KPI + " SELECT sum(population)::BIGINT AS population, sum(outage_count)::BIGINT AS outage_count, sum(customer_interruptions)::DOUBLE / sum(population) AS saifi, sum(customer_minutes)::DOUBLE / sum(population) AS saidi_minutes, sum(customer_minutes)::DOUBLE / sum(customer_interruptions) AS caidi_minutes FROM k WHERE level = 'region'")
def rel_system(s, d):
    return reliability.system_summary(_kpis(s, d))


@query("rel_lowest", SCORE + " SELECT level, entity_id, reliability_score FROM sc WHERE level = 'substation' ORDER BY reliability_score NULLS LAST, entity_id LIMIT 5")
def rel_lowest(s, d):
    return reliability.extremes(reliability.score(_kpis(s, d)).filter("level = 'substation'")).select("level", "entity_id", "reliability_score")


@query("rel_duration_bands", a.OUTAGES + " SELECT region, CASE WHEN duration_minutes < 5 THEN 'MOMENTARY' WHEN duration_minutes >= 180 THEN 'PROLONGED' ELSE 'SUSTAINED' END AS duration_band, planned, count(*) AS n FROM outages GROUP BY ALL")
def rel_duration_bands(s, d):
    return reliability.classified(a.outages(s, d)).groupBy("region", "duration_band", "planned").agg(F.count("*").alias("n"))


@query("rel_periods", a.OUTAGES + f" SELECT region, CAST((start_min - {START}) // 10080 AS BIGINT) AS period, CAST({START} + (start_min - {START}) // 10080 * 10080 AS BIGINT) AS period_start, CAST(least({END}, {START} + ((start_min - {START}) // 10080 + 1) * 10080) - ({START} + (start_min - {START}) // 10080 * 10080) AS BIGINT) AS period_minutes, count(*) AS n FROM outages WHERE start_min >= {START} AND start_min < {END} GROUP BY ALL")
def rel_periods(s, d):
    return reliability.with_period(a.outages(s, d), START, END, "weekly").groupBy("region", "period", "period_start", "period_minutes").agg(F.count("*").alias("n"))


@query("series_hourly", "WITH h AS (SELECT event_type AS entity_id, date_trunc('hour', ts) AS ts, sum(value) AS target, count(DISTINCT user_id) AS members, arg_min(user_id, event_id) AS first_meter FROM events GROUP BY ALL) SELECT *, members / max(members) OVER (PARTITION BY entity_id)::DOUBLE AS coverage FROM h")
def series_hourly(s, d):
    return series.coverage(series.hourly(a.readings(s, d), "entity", "value", "meter_id", first={"first_meter": "meter_id"}, order="event_id"))


SPINE = a.HOURLY_USER + ", e AS (SELECT entity_id, min(ts) AS lo, max(ts) AS hi FROM hu GROUP BY ALL), sp AS (SELECT entity_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM e), f AS (SELECT sp.entity_id, sp.ts, target, target IS NULL AS imputed FROM sp LEFT JOIN hu ON hu.entity_id = sp.entity_id AND hu.ts = sp.ts)"


@query("series_gapfill", "WITH " + SPINE + " SELECT entity_id, ts, target, imputed FROM f")
def series_gapfill(s, d):
    return series.filled(a.hourly_by_user(s, d), "mark").select("entity_id", "ts", "target", "imputed")


@query("series_ffill_limit", "WITH " + SPINE + """, l AS (SELECT entity_id, ts, imputed, last_value(target IGNORE NULLS) OVER w AS target, last_value(CASE WHEN NOT imputed THEN ts END IGNORE NULLS) OVER w AS seen FROM f WINDOW w AS (PARTITION BY entity_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT entity_id, ts, target, imputed FROM l WHERE date_diff('hour', seen, ts) <= 2""")
def series_ffill_limit(s, d):
    return series.filled(a.hourly_by_user(s, d), "forward_fill", 2).select("entity_id", "ts", "target", "imputed")


@query("series_weather", """WITH """ + a.HOURLY_TYPE + """, w AS (SELECT date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS temperature FROM events WHERE event_type = 'error' GROUP BY ALL) SELECT ht.entity_id, ht.ts, target, temperature FROM ht LEFT JOIN w ON w.ts = ht.ts""")
def series_weather(s, d):
    w = a.readings(s, d).filter("entity = 'error'").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("temperature"), "event_id")
    return series.with_weather(a.hourly_by_type(s, d), w, ["ts"], "event_id").select("entity_id", "ts", "target", "temperature")


FEATURES = a.HOURLY_TYPE + """, fx AS (SELECT entity_id, ts, target, target AS lag_1, lag(target, 2) OVER o AS lag_3, avg(target) OVER f AS rolling_mean_4, stddev_pop(target) OVER f AS rolling_std_4, min(target) OVER f AS rolling_min_4, max(target) OVER f AS rolling_max_4, row_number() OVER o AS n FROM ht WINDOW o AS (PARTITION BY entity_id ORDER BY ts), f AS (PARTITION BY entity_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
ft AS (SELECT * EXCLUDE (n) FROM fx WHERE n >= 4), hz AS (SELECT ft.*, h AS horizon, ft.ts + to_hours(h) AS forecast_ts, x.target AS actual FROM ft, (VALUES (1), (24)) v(h) JOIN ht x ON x.entity_id = ft.entity_id AND x.ts = ft.ts + to_hours(h))"""


def _features(s: SparkSession, d: str) -> DataFrame:
    return series.lag_rolling(a.hourly_by_type(s, d), (1, 3), (4,))


def _horizons(s: SparkSession, d: str) -> DataFrame:
    return series.with_horizons(_features(s, d), a.hourly_by_type(s, d), (1, 24))


@query("feat_lag_rolling", "WITH " + FEATURES + " SELECT * FROM ft")
def feat_lag_rolling(s, d):
    return _features(s, d)


@query("feat_horizon_join", "WITH " + FEATURES + " SELECT entity_id, ts, horizon, forecast_ts, lag_1, actual FROM hz")
def feat_horizon_join(s, d):
    return _horizons(s, d).select("entity_id", "ts", "horizon", "forecast_ts", "lag_1", "actual")


@query("feat_calendar", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, CAST(month(ts) AS INTEGER) AS month, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, sin(hour(ts) * 6.283185307179586 / 24) AS hour_sin, cos(hour(ts) * 6.283185307179586 / 24) AS hour_cos, sin((isodow(ts) - 1) * 6.283185307179586 / 7) AS weekday_sin, cos((isodow(ts) - 1) * 6.283185307179586 / 7) AS weekday_cos FROM events")
def feat_calendar(s, d):
    return a.readings(s, d).select("event_id", *[c.alias(n) for n, c in calendar("ts").items()])


SPLIT = FEATURES + ", tk AS (SELECT ts, dense_rank() OVER (ORDER BY ts DESC) AS k FROM (SELECT DISTINCT ts FROM ft)), spl AS (SELECT ft.*, CASE WHEN k <= 48 THEN 'test' WHEN k <= 96 THEN 'validation' ELSE 'train' END AS split, k FROM ft JOIN tk ON tk.ts = ft.ts)"


@query("split_chrono", "WITH " + SPLIT + " SELECT entity_id, ts, split FROM spl")
def split_chrono(s, d):
    return splits.chronological(_features(s, d), 48, 48).select("entity_id", "ts", "split")


@query("split_purged", "WITH " + SPLIT + """, b AS (SELECT max(ts) FILTER (k = 48) AS t0, max(ts) FILTER (k = 96) AS v0 FROM tk), q AS (SELECT entity_id, ts, CASE WHEN ts >= t0 THEN 'test' WHEN ts >= v0 AND ts + INTERVAL 3 HOUR <= t0 THEN 'validation' WHEN ts < v0 - INTERVAL 2 HOUR AND ts + INTERVAL 3 HOUR <= v0 THEN 'train' END AS split FROM ft, b) SELECT * FROM q WHERE split IS NOT NULL""")
def split_purged(s, d):
    rows = _features(s, d).withColumn("label_end", F.col("ts") + F.expr("interval 3 hours"))
    return splits.purged(rows, 48, 48, 2, 60).select("entity_id", "ts", "split")


@query("split_rolling", "WITH " + FEATURES + """, c AS (SELECT ts AS cutoff, 4 - row_number() OVER (ORDER BY ts DESC) AS fold FROM (SELECT DISTINCT ts FROM hz) QUALIFY row_number() OVER (ORDER BY ts DESC) <= 3)
SELECT CAST(fold AS INTEGER) AS fold, cutoff, 'train' AS part, count(*) AS n FROM hz JOIN c ON forecast_ts <= cutoff GROUP BY ALL UNION ALL SELECT CAST(fold AS INTEGER), cutoff, 'evaluate', count(*) FROM hz JOIN c ON ts = cutoff GROUP BY ALL""")
def split_rolling(s, d):
    return splits.rolling_origins(_horizons(s, d), 3).groupBy("fold", "cutoff", "part").agg(F.count("*").alias("n"))


def _predictions(s: SparkSession, d: str) -> DataFrame:
    rows = splits.chronological(_horizons(s, d), 48, 48)
    return models.scored(rows, {"persistence": models.persistence, "moving_average": models.moving_average(4)})


PREDICTED = SPLIT + ", pz AS (SELECT hz.*, CASE WHEN tk2.k <= 48 THEN 'test' WHEN tk2.k <= 96 THEN 'validation' ELSE 'train' END AS split FROM hz JOIN (SELECT ts, dense_rank() OVER (ORDER BY ts DESC) AS k FROM (SELECT DISTINCT ts FROM hz)) tk2 ON tk2.ts = hz.ts), pr AS (SELECT *, 'persistence' AS model, greatest(lag_1, 0) AS predicted FROM pz UNION ALL SELECT *, 'moving_average', greatest(rolling_mean_4, 0) FROM pz)"
METRICS = """count(*) AS n, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse, 100 * avg(CASE WHEN actual <> 0 THEN abs(predicted - actual) / abs(actual) END) AS mape, 100 * avg(CASE WHEN abs(actual) + abs(predicted) <> 0 THEN abs(predicted - actual) / ((abs(actual) + abs(predicted)) / 2) END) AS smape, 100 * sum(abs(predicted - actual)) / nullif(sum(abs(actual)), 0) AS wape, avg(predicted - actual) AS bias"""


@query("fc_metrics", "WITH " + PREDICTED + f" SELECT model, entity_id, horizon, split, {METRICS} FROM pr GROUP BY ALL")
def fc_metrics(s, d):
    return metrics.forecast(_predictions(s, d), ["model", "entity_id", "horizon", "split"])


@query("fc_overall", "WITH " + PREDICTED + f", m AS (SELECT model, entity_id, horizon, split, {METRICS} FROM pr GROUP BY ALL) SELECT model, split, sum(n)::BIGINT AS n, " + ", ".join(f"CASE WHEN count({m}) = count(*) THEN sum({m} * n) / sum(n) END AS {m}" for m in metrics.FORECAST_METRICS) + " FROM m GROUP BY ALL")
def fc_overall(s, d):
    return metrics.overall(metrics.forecast(_predictions(s, d), ["model", "entity_id", "horizon", "split"]), ["model", "split"])


@query("fc_residual_quantile", "WITH " + PREDICTED + ", r AS (SELECT model, horizon, list_sort(list(actual - predicted)) AS e FROM pr WHERE split = 'train' GROUP BY ALL) SELECT model, horizon, e[CAST(floor(0.1 * (len(e) - 1)) AS BIGINT) + 1] AS q_lo, e[CAST(floor(0.9 * (len(e) - 1)) AS BIGINT) + 1] AS q_hi FROM r")
def fc_residual_quantile(s, d):
    r = _predictions(s, d).filter("split = 'train'").withColumn("residual", F.col("actual") - F.col("predicted"))
    return metrics.nearest_rank(r, ["model", "horizon"], "residual", {"q_lo": 0.1, "q_hi": 0.9})


@query("fc_intervals", "WITH " + PREDICTED + """, r AS (SELECT model, horizon, list_sort(list(actual - predicted)) AS e FROM pr WHERE split = 'train' GROUP BY ALL), q AS (SELECT model, horizon, e[CAST(floor(0.1 * (len(e) - 1)) AS BIGINT) + 1] AS q_lo, e[CAST(floor(0.9 * (len(e) - 1)) AS BIGINT) + 1] AS q_hi FROM r),
b AS (SELECT pr.model, split, actual, greatest(0, least(predicted, predicted + q_lo)) AS lower, greatest(predicted, predicted + q_hi, greatest(0, least(predicted, predicted + q_lo))) AS upper FROM pr JOIN q ON q.model = pr.model AND q.horizon = pr.horizon)
SELECT model, split, count(*) AS n, avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0 END) AS coverage, avg(upper - lower) AS width FROM b GROUP BY ALL""")
def fc_intervals(s, d):
    p = _predictions(s, d)
    q = metrics.nearest_rank(p.filter("split = 'train'").withColumn("residual", F.col("actual") - F.col("predicted")), ["model", "horizon"], "residual", {"q_lo": 0.1, "q_hi": 0.9})
    i = metrics.intervals(p, q, ["model", "horizon"])
    return i.groupBy("model", "split").agg(F.count("*").alias("n"), F.avg((F.col("actual").between(F.col("lower"), F.col("upper"))).cast("double")).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("width"))


@query("fc_select", "WITH " + PREDICTED + f", m AS (SELECT model, entity_id, horizon, split, {METRICS} FROM pr GROUP BY ALL) SELECT entity_id, horizon, model, mae AS value FROM m WHERE split = 'validation' QUALIFY row_number() OVER (PARTITION BY entity_id, horizon ORDER BY mae, model) = 1")
def fc_select(s, d):
    m = metrics.forecast(_predictions(s, d), ["model", "entity_id", "horizon", "split"]).filter("split = 'validation'")
    return metrics.select_model(m, ["entity_id", "horizon"])


@query("fc_ridge")
def fc_ridge(s, d):
    """Coefficients have no plain SQL; tested against NumPy."""
    rows = splits.chronological(_horizons(s, d), 48, 48)
    fit = models.fit_ridge(rows.filter("split = 'train' AND horizon = 1"), ["lag_1", "lag_3", "rolling_mean_4"])
    return metrics.forecast(fit.forecast(rows.filter("horizon = 1")), ["split"])


@query("fc_backtest")
def fc_backtest(s, d):
    """Refits per fold; tested against a driver-side refit."""
    folds = splits.rolling_origins(_horizons(s, d).filter("horizon = 1"), 3)
    return metrics.forecast(models.backtest(folds, "ridge", lambda t: models.fit_ridge(t, ["lag_1", "rolling_mean_4"]).forecast), ["model", "split"])


STEP, BACK, AHEAD = 60, 24, 6  # minutes, intervals of lookback, intervals of horizon
PANEL = a.READINGS + f""", rd AS (SELECT *, ts_min // 60 * 60 AS tick FROM readings), tk AS (SELECT DISTINCT tick AS obs FROM rd), en AS (SELECT DISTINCT entity AS entity_id FROM rd), pres AS (SELECT DISTINCT entity AS entity_id, tick FROM rd),
pn AS (SELECT entity_id, obs, (SELECT count(*) FROM pres WHERE pres.entity_id = en.entity_id AND tick BETWEEN obs - {STEP * (BACK - 1)} AND obs) AS available_history FROM en, tk WHERE obs <= (SELECT max(tick) FROM rd) - {AHEAD * STEP}),
panel AS (SELECT entity_id, obs, available_history, greatest(0, {BACK} - available_history) AS missing_intervals, least(1, available_history / {BACK}.0::DOUBLE) AS completeness FROM pn WHERE available_history >= 12),
ev AS (SELECT CASE WHEN meter_id % 2 = 0 THEN 'click' ELSE 'view' END AS entity_id, ts_min AS start_min, event_id AS outage_id, ts_min + 90 AS end_min, meter_id % 5 = 0 AS planned, CASE WHEN meter_id % 3 = 0 THEN 'equipment_failure' ELSE 'unknown' END AS cause, meter_id % 7 = 0 AS severe, 90 AS duration_minutes FROM readings WHERE entity = 'error')"""


def _ticks(s: SparkSession, d: str) -> DataFrame:
    return a.readings(s, d).withColumn("ts_min", F.floor(F.col("ts_min") / 60) * 60).withColumnRenamed("entity", "entity_id")


def _panel(s: SparkSession, d: str) -> DataFrame:
    t = _ticks(s, d)
    return risk.panel(t, t, STEP, BACK, AHEAD, 12)


def _incidents(s: SparkSession, d: str) -> DataFrame:
    """Error events as interruptions of two entities."""
    m = F.col("meter_id")
    return a.readings(s, d).filter("entity = 'error'").select(F.when(m % 2 == 0, "click").otherwise("view").alias("entity_id"), F.col("ts_min").alias("start_min"), F.col("event_id").alias("outage_id"), (F.col("ts_min") + 90).alias("end_min"), (m % 5 == 0).alias("planned"),
                                                                F.when(m % 3 == 0, "equipment_failure").otherwise("unknown").alias("cause"), (m % 7 == 0).alias("severe"), F.lit(90).alias("duration_minutes"))


@query("risk_panel", PANEL + " SELECT entity_id, obs, available_history, CAST(missing_intervals AS BIGINT) AS missing_intervals, completeness FROM panel")
def risk_panel(s, d):
    return _panel(s, d).select("entity_id", "obs", "available_history", F.col("missing_intervals").cast("long").alias("missing_intervals"), "completeness")


LABELS = PANEL + f""", lb AS (SELECT p.entity_id, p.obs, arg_min(outage_id, start_min * 100000000 + outage_id) AS outage_id FROM panel p JOIN ev ON ev.entity_id = p.entity_id AND NOT planned AND start_min > obs AND start_min <= obs + {AHEAD * STEP} GROUP BY ALL)"""


@query("risk_labels", LABELS + " SELECT p.entity_id, p.obs, CAST(outage_id IS NOT NULL AS INTEGER) AS label, outage_id FROM panel p LEFT JOIN lb ON lb.entity_id = p.entity_id AND lb.obs = p.obs")
def risk_labels(s, d):
    return risk.label(_panel(s, d), _incidents(s, d), AHEAD * STEP).select("entity_id", "obs", "label", "outage_id")


REACH = STEP * (BACK - 1)


@query("risk_lookback", PANEL + f""" SELECT p.entity_id, p.obs, count(event_id)::DOUBLE AS telemetry_observation_count, coalesce(avg(value), 0) AS mean_load_mw, coalesce(max(value), 0) AS maximum_load_mw, coalesce(stddev_pop(value), 0) AS load_standard_deviation, count(*) FILTER (value >= 80)::DOUBLE AS high_utilisation_count,
coalesce(count(*) FILTER (value >= 80) / nullif(count(event_id), 0)::DOUBLE, 0) AS high_utilisation_share FROM panel p LEFT JOIN readings r ON r.entity = p.entity_id AND ts_min BETWEEN obs - {REACH} AND obs GROUP BY ALL""")
def risk_lookback(s, d):
    t = a.readings(s, d).withColumnRenamed("entity", "entity_id").withColumns({"load_mw": F.col("value"), "utilisation_pct": F.col("value"), "transformer_temperature_c": F.col("value"), "alarm_code": F.lit(""), "operational_status": F.lit("normal"), "frequency_hz": F.lit(50.0), "voltage_kv": F.lit(33.0)})
    return risk.telemetry_features(_panel(s, d), t, REACH).select("entity_id", "obs", "telemetry_observation_count", "mean_load_mw", "maximum_load_mw", "load_standard_deviation", "high_utilisation_count", "high_utilisation_share")


@query("risk_meters", PANEL + f""" SELECT p.entity_id, p.obs, coalesce(sum(value), 0) AS aggregate_energy_kwh, coalesce(arg_max(value, ts_min * 100000000 + event_id) - arg_min(value, ts_min * 100000000 + event_id), 0) AS energy_change_rate, count(DISTINCT meter_id)::DOUBLE AS meter_count,
CASE WHEN count(event_id) = 0 THEN 0 ELSE least(1, count(event_id)::DOUBLE / greatest(1, 2 * count(DISTINCT meter_id))) END AS meter_coverage_ratio, CASE WHEN count(event_id) = 0 THEN 1.0::DOUBLE ELSE 0 END AS missing_reading_share FROM panel p LEFT JOIN readings r ON r.entity = p.entity_id AND ts_min BETWEEN obs - {REACH} AND obs GROUP BY ALL""")
def risk_meters(s, d):
    t = a.readings(s, d).withColumnRenamed("entity", "entity_id").withColumns({"active_energy_kwh": F.col("value"), "quality_code": F.lit("GOOD"), "voltage_v": F.lit(230.0)})
    return risk.meter_features(_panel(s, d), t, REACH).select("entity_id", "obs", "aggregate_energy_kwh", "energy_change_rate", "meter_count", "meter_coverage_ratio", "missing_reading_share")


@query("risk_weather_asof", PANEL + f""", w AS (SELECT ts_min, max(value) AS gust, arg_max(value, event_id) AS temp FROM readings WHERE entity = 'error' GROUP BY ts_min)
SELECT p.entity_id, p.obs, coalesce(arg_max(temp, ts_min), 0) AS temperature_c, coalesce(sum(gust), 0) AS recent_precipitation_total, coalesce(max(gust), 0) AS recent_maximum_wind_gust, coalesce(sum(CASE WHEN gust > 90 THEN 1.0::DOUBLE ELSE 0 END), 0) AS recent_severe_weather_count FROM panel p LEFT JOIN w ON ts_min BETWEEN obs - {REACH} AND obs GROUP BY ALL""")
def risk_weather_asof(s, d):
    w = a.readings(s, d).filter("entity = 'error'").groupBy("ts_min").agg(F.max("value").alias("gust"), F.max_by("value", "event_id").alias("temperature_c"))
    w = w.select("ts_min", F.lit("all").alias("grid_region"), "temperature_c", F.lit(0.0).alias("humidity_pct"), F.lit(0.0).alias("wind_speed_mps"), F.col("gust").alias("wind_gust_mps"), F.col("gust").alias("precipitation_mm"), F.lit(0.0).alias("pressure_hpa"), (F.col("gust") > 90).alias("severe_weather_flag"))
    return risk.weather_features(_panel(s, d).withColumn("grid_region", F.lit("all")), w, REACH).select("entity_id", "obs", "temperature_c", "recent_precipitation_total", "recent_maximum_wind_gust", "recent_severe_weather_count")


PRIOR = PANEL + f""", po AS (SELECT p.entity_id, p.obs, count(outage_id)::DOUBLE AS prior_unplanned_outage_count, coalesce(p.obs // 1440 - max(start_min) // 1440, 999)::DOUBLE AS days_since_previous_unplanned_outage, count(*) FILTER (cause = 'equipment_failure')::DOUBLE AS prior_equipment_failure_outage_count, count(*) FILTER (severe)::DOUBLE AS prior_severe_weather_outage_count, coalesce(sum(duration_minutes), 0)::DOUBLE AS historical_outage_duration_minutes
FROM panel p LEFT JOIN ev ON ev.entity_id = p.entity_id AND NOT planned AND start_min >= obs - {REACH} AND start_min < p.obs AND end_min <= p.obs GROUP BY p.entity_id, p.obs)"""


def _prior(s: SparkSession, d: str) -> DataFrame:
    return risk.prior_outage_features(_panel(s, d), _incidents(s, d), REACH)


@query("risk_prior_outages", PRIOR + " SELECT * FROM po")
def risk_prior_outages(s, d):
    return _prior(s, d).select("entity_id", "obs", "prior_unplanned_outage_count", "days_since_previous_unplanned_outage", "prior_equipment_failure_outage_count", "prior_severe_weather_outage_count", "historical_outage_duration_minutes")


@query("risk_heuristics", PRIOR + """ SELECT po.entity_id, po.obs, CASE WHEN prior_unplanned_outage_count > 0 AND days_since_previous_unplanned_outage <= 7 THEN 0.75::DOUBLE ELSE 0.15::DOUBLE END AS score, CASE WHEN prior_unplanned_outage_count > 0 AND days_since_previous_unplanned_outage <= 7 THEN 'CRITICAL' ELSE 'LOW' END AS risk_band,
CASE WHEN prior_unplanned_outage_count > 0 AND completeness < 0.75 THEN 'RECENT_UNPLANNED_OUTAGE|POOR_DATA_COMPLETENESS' WHEN prior_unplanned_outage_count > 0 THEN 'RECENT_UNPLANNED_OUTAGE' WHEN completeness < 0.75 THEN 'POOR_DATA_COMPLETENESS' ELSE 'LOW_RECENT_STRESS' END AS reason_codes FROM po JOIN panel p ON p.entity_id = po.entity_id AND p.obs = po.obs""")
def risk_heuristics(s, d):
    return risk.reasons(models.recent_outage(_prior(s, d))).select("entity_id", "obs", "score", risk.band().alias("risk_band"), F.array_join("reason_codes", "|").alias("reason_codes"))


@query("risk_maintenance", a.MAINTENANCE + """, p AS (SELECT p_partkey % 50 AS entity_id, 13149 * 1440 + 1000 AS obs FROM part GROUP BY ALL), b AS (SELECT DISTINCT p_partkey % 50 AS entity_id, p_partkey AS asset_id FROM part)
SELECT p.entity_id, p.obs, coalesce(13149 - max(day) FILTER (maintenance_status = 'completed'), 999)::DOUBLE AS days_since_last_completed_maintenance, count(*) FILTER (maintenance_type = 'corrective')::DOUBLE AS recent_corrective_maintenance_count, count(*) FILTER (maintenance_status = 'deferred')::DOUBLE AS deferred_maintenance_count, coalesce(sum(downtime_minutes), 0)::DOUBLE AS recent_downtime_minutes
FROM p LEFT JOIN (SELECT entity_id, maint.* FROM b JOIN maint ON maint.asset_id = b.asset_id) m ON m.entity_id = p.entity_id AND day * 1440 BETWEEN obs - 43200 AND obs GROUP BY ALL""")
def risk_maintenance(s, d):
    part = a.table(s, d, "part").select((F.col("p_partkey") % 50).alias("entity_id"), F.col("p_partkey").alias("asset_id"))
    rows = part.select("entity_id").distinct().withColumn("obs", F.lit(13149 * 1440 + 1000).cast("long"))
    logs = a.maintenance(s, d).withColumn("ts_min", F.col("day") * 1440).withColumn("follow_up_required", F.col("follow_up"))
    return risk.maintenance_features(rows, part, logs, 43200).select("entity_id", F.col("obs").cast("int").alias("obs"), "days_since_last_completed_maintenance", "recent_corrective_maintenance_count", "deferred_maintenance_count", "recent_downtime_minutes")


@query("clf_confusion", "WITH " + a.SCORED + ", c AS (SELECT source, count(*) AS n, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM scored GROUP BY ALL) SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, tn::DOUBLE / nullif(tn + fp, 0) AS specificity, (tp + tn)::DOUBLE / n AS accuracy, (2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1, (tp + fn)::DOUBLE / n AS prevalence FROM c")
def clf_confusion(s, d):
    return metrics.confusion(a.scored_documents(s, d), ["source"])


@query("clf_roc_auc", "WITH " + a.SCORED + " SELECT p.source, sum(CASE WHEN p.score > q.score THEN 1 WHEN p.score = q.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS roc_auc FROM scored p JOIN scored q ON p.source = q.source AND p.label = 1 AND q.label = 0 GROUP BY ALL UNION ALL SELECT source, NULL FROM scored GROUP BY source HAVING min(label) = max(label)")
def clf_roc_auc(s, d):
    return metrics.roc_auc(a.scored_documents(s, d), ["source"])


@query("clf_pr_auc", "WITH " + a.SCORED + """, o AS (SELECT source, label, row_number() OVER w AS k, sum(label) OVER (PARTITION BY source ORDER BY score DESC, label DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp FROM scored WINDOW w AS (PARTITION BY source ORDER BY score DESC, label DESC, doc_id)), p AS (SELECT source, label, k, tp / k::DOUBLE AS pr, lag(tp / k::DOUBLE, 1, 1.0::DOUBLE) OVER (PARTITION BY source ORDER BY k) AS before FROM o)
SELECT source, sum(CASE WHEN label = 1 THEN (pr + before) / 2 ELSE 0 END) / nullif(sum(label), 0) AS pr_auc FROM p GROUP BY source""")
def clf_pr_auc(s, d):
    return metrics.pr_auc(a.scored_documents(s, d), ["source"])


@query("clf_logloss", "WITH " + a.SCORED + " SELECT source, avg((score - label) ** 2) AS brier, -avg(label * ln(least(greatest(score, 1e-6), 1 - 1e-6)) + (1 - label) * ln(1 - least(greatest(score, 1e-6), 1 - 1e-6))) AS log_loss FROM scored GROUP BY source")
def clf_logloss(s, d):
    return metrics.probabilistic(a.scored_documents(s, d), ["source"])


@query("clf_thresholds", "WITH " + a.SCORED + " SELECT source, count(*) AS n, t::DOUBLE AS threshold, count(*) FILTER (score >= t::DOUBLE) AS predicted_positive FROM scored, (VALUES (0.25), (0.5), (0.75)) v(t) GROUP BY ALL")
def clf_thresholds(s, d):
    return metrics.thresholds(a.scored_documents(s, d), ["source"], (0.25, 0.5, 0.75))


@query("clf_balance", "WITH " + a.SCORED + " SELECT source, count(*) AS n, sum(label)::BIGINT AS positives, avg(label) AS prevalence FROM scored GROUP BY source")
def clf_balance(s, d):
    return metrics.class_balance(a.scored_documents(s, d), ["source"])


@query("clf_logistic")
def clf_logistic(s, d):
    """Gradient-descent iterates have no plain SQL; tested against NumPy."""
    rows = a.scored_documents(s, d)
    fit = models.fit_logistic(rows, ["score", "quality"])
    return metrics.probabilistic(fit.probability(rows), ["source"])


NOW = 11688  # 2002-01-01 in days since 1970


def _health(s: SparkSession, d: str) -> DataFrame:
    assets = a.assets(s, d)
    o = a.outages(s, d).withColumnsRenamed({"asset_id": "primary_asset_id"}).filter(F.col("start_min") >= (NOW - 365) * 1440)
    e = health.maintenance_evidence(assets, a.maintenance(s, d), NOW)
    t = a.readings(s, d).select((F.col("meter_id") % 100 + 1).alias("feeder_id"), (F.col("meter_id") % 25).cast("int").alias("substation_id"), F.col("value").alias("utilisation_pct"), F.col("value").alias("transformer_temperature_c"), F.when(F.col("value") > 60, "HIGH_LOAD").alias("alarm_code"), F.lit("normal").alias("operational_status"), "ts_min")
    e = health.telemetry_evidence(e, t)
    return health.component_scores(health.outage_evidence(e, o), NOW)


LINKED = a.OUTAGES + ", " + a.ASSETS + f""", lo AS (SELECT asset_id, outage_id, max(direct) AS direct FROM (SELECT x.asset_id, outage_id, true AS direct FROM assets x JOIN outages o ON o.asset_id = x.asset_id AND start_min >= {(NOW - 365) * 1440} UNION ALL SELECT x.asset_id, outage_id, false FROM assets x JOIN outages o ON o.feeder_id = x.feeder_id AND start_min >= {(NOW - 365) * 1440} UNION ALL SELECT x.asset_id, outage_id, false FROM assets x JOIN outages o ON o.substation_id = x.substation_id AND start_min >= {(NOW - 365) * 1440}) GROUP BY ALL),
oe AS (SELECT lo.asset_id, count(*) FILTER (direct) AS direct_outage_count, count(*) FILTER (direct AND NOT planned) AS direct_unplanned_count, count(*) FILTER (direct AND cause = 'equipment_failure') AS equipment_failure_count, count(*) FILTER (direct AND planned) AS direct_planned_count, coalesce(sum(customers) FILTER (direct), 0)::BIGINT AS direct_customers, max(start_min) FILTER (direct) AS lds, coalesce(sum(duration_minutes) FILTER (direct), 0)::BIGINT AS direct_minutes, count(*) FILTER (NOT direct) AS contextual_count, count(*) FILTER (NOT direct AND severe) AS contextual_severe_count FROM lo JOIN outages USING (outage_id) GROUP BY ALL)"""


@query("health_or_join", LINKED + " SELECT asset_id, count(*) AS linked, count(*) FILTER (direct) AS direct FROM lo GROUP BY ALL")
def health_or_join(s, d):
    o = a.outages(s, d).withColumnsRenamed({"asset_id": "primary_asset_id"}).filter(F.col("start_min") >= (NOW - 365) * 1440)
    found = health.outage_evidence(a.assets(s, d), o).select("asset_id", (F.col("direct_outage_count") + F.col("contextual_count")).alias("linked"), F.col("direct_outage_count").alias("direct"))
    return found.filter("linked > 0")


HEALTH = LINKED + ", " + a.MAINTENANCE + ", " + a.READINGS + f""", me AS (SELECT asset_id, count(*) AS mc, count(*) FILTER (maintenance_type = 'corrective') AS cc, count(*) FILTER (maintenance_type = 'preventive') AS pc, sum(cost) AS cost, avg(cost) AS mcost, max(day) FILTER (maintenance_status = 'completed') AS lcd, count(*) FILTER (maintenance_type = 'emergency') AS ec, count(*) FILTER (maintenance_status = 'deferred') AS dc, count(*) FILTER (follow_up) AS fc, sum(downtime_minutes) AS dm FROM maint WHERE day <= {NOW} AND day >= {NOW} - 365 GROUP BY ALL),
tf AS (SELECT link, k, count(*) AS tc, avg(value) AS mu, max(value) AS xu, count(*) FILTER (value >= 90) / count(*)::DOUBLE AS hs, count(*) FILTER (value >= 75) / count(*)::DOUBLE AS ts, count(*) FILTER (value > 60) AS ac, max(ts_min) AS lt FROM (SELECT 'f' AS link, meter_id % 100 + 1 AS k, value, ts_min FROM readings UNION ALL SELECT 's', meter_id % 25, value, ts_min FROM readings) GROUP BY ALL),
h0 AS (SELECT x.*, coalesce(mc, 0) AS mc, coalesce(cc, 0) AS cc, coalesce(ec, 0) AS ec, coalesce(dc, 0) AS dc, coalesce(fc, 0) AS fc, coalesce(dm, 0) AS dm, coalesce(pc, 0) AS pc, coalesce(cost, 0) AS cost, mcost, lcd, coalesce(tc, 0) AS tc, mu, xu, hs, tf.ts AS tsh, ac, lt, coalesce(direct_planned_count, 0) AS dpc, coalesce(direct_customers, 0) AS dcu, lds, coalesce(direct_outage_count, 0) AS doc, coalesce(direct_unplanned_count, 0) AS duc, coalesce(equipment_failure_count, 0) AS efc, coalesce(direct_minutes, 0) AS dmin, coalesce(contextual_count, 0) AS ctx, coalesce(contextual_severe_count, 0) AS ctxs, ({NOW} - commissioned_day) / 365.25::DOUBLE / expected_life_years AS r, greatest({NOW} - next_due_day, 0) AS od, greatest(next_due_day - {NOW}, 0) AS ah
  FROM assets x LEFT JOIN me ON me.asset_id = x.asset_id LEFT JOIN tf ON (CASE WHEN x.asset_type = 'primary_substation' OR x.feeder_id IS NULL THEN link = 's' AND tf.k = x.substation_id ELSE link = 'f' AND tf.k = x.feeder_id END) LEFT JOIN oe ON oe.asset_id = x.asset_id),
h1 AS (SELECT *, CASE WHEN r <= 0.5 THEN least(100, greatest(0, 100 - 20 * r)) WHEN r <= 1 THEN least(100, greatest(0, 90 - 60 * (r - 0.5) / 0.5)) ELSE least(100, greatest(0, 30 - 30 * least(1, r - 1))) END AS s1, CASE WHEN od > 0 THEN 70 - 70 * least(365, od) / 365.0::DOUBLE WHEN ah >= 180 THEN 100 ELSE least(100, 80 + 20 * ah / 180.0::DOUBLE) END AS s2,
  CASE WHEN mc = 0 THEN 50 ELSE least(100, greatest(0, 100 - (25 * cc / mc::DOUBLE + 30 * ec / mc::DOUBLE + 12 * least(3, dc) + 8 * least(3, fc) + 20 * least(1, dm / 720.0::DOUBLE)))) END AS s3, CASE WHEN tc = 0 THEN 50 ELSE least(100, greatest(0, 100 - (0.8 * greatest(0, mu - 75) + 0.6 * greatest(0, xu - 95) + 25 * hs + 25 * tsh))) END AS s4, CASE WHEN tc = 0 THEN 50 ELSE least(100, greatest(0, 100 - 12 * least(8, ac))) END AS s5, least(100, greatest(0, 100 - (25 * duc + 15 * efc + 20 * least(1, dmin / 720.0::DOUBLE) + 4 * least(4, ctx)))) AS s6 FROM h0),
h2 AS (SELECT *, 0.18 * s1 + 0.17 * s2 + 0.20 * s3 + 0.20 * s4 + 0.10 * s5 + 0.15 * s6 AS score FROM h1), h3 AS (SELECT *, CASE WHEN score <= 35 THEN 'CRITICAL' WHEN score <= 55 THEN 'DEGRADED' WHEN score <= 75 THEN 'WATCH' ELSE 'HEALTHY' END AS band, od > 0 OR dc > 0 OR duc > 0 OR operational_status IN ('maintenance', 'retired') AS pressing FROM h2)"""


@query("health_features", HEALTH + " SELECT asset_id, mc AS maintenance_count, cc AS corrective_count, ec AS emergency_count, dc AS deferred_count, CAST(dm AS BIGINT) AS downtime_minutes, tc AS telemetry_count, mu AS mean_utilisation, hs AS high_utilisation_share, doc AS direct_outage_count, duc AS direct_unplanned_count, ctx AS contextual_count, ctxs AS contextual_severe_count, r AS age_ratio, pc AS preventive_count, fc AS follow_up_count, cost AS maintenance_cost, mcost AS mean_cost, lcd AS last_completed_day, xu AS max_utilisation, tsh AS high_temperature_share, ac AS alarm_count, lt AS last_telemetry_min, efc AS equipment_failure_count, dmin AS direct_minutes, dpc AS direct_planned_count, dcu AS direct_customers, lds AS last_direct_start, od AS inspection_overdue_days FROM h0")
def health_features(s, d):
    return _health(s, d).select("asset_id", "maintenance_count", "corrective_count", "emergency_count", "deferred_count", "downtime_minutes", "telemetry_count", "mean_utilisation", "high_utilisation_share", "direct_outage_count", "direct_unplanned_count", "contextual_count", "contextual_severe_count", "age_ratio", "preventive_count", "follow_up_count", "maintenance_cost", "mean_cost", "last_completed_day", "max_utilisation", "high_temperature_share", "alarm_count", "last_telemetry_min", "equipment_failure_count", "direct_minutes", "direct_planned_count", "direct_customers", "last_direct_start", "inspection_overdue_days")


@query("health_scores", HEALTH + " SELECT asset_id, s1::DOUBLE AS age_score, s2::DOUBLE AS inspection_score, s3::DOUBLE AS maintenance_score, s4::DOUBLE AS telemetry_score, s5::DOUBLE AS alarm_score, s6::DOUBLE AS outage_score, score AS health_score, band AS health_band FROM h3")
def health_scores(s, d):
    return _health(s, d).select("asset_id", *[f"{n}_score" for n in health.WEIGHTS], "health_score", "health_band")


@query("health_priority", HEALTH + """ SELECT asset_id,
  CASE WHEN band = 'CRITICAL' AND criticality >= 3 THEN 'P1_IMMEDIATE_REVIEW' WHEN band = 'CRITICAL' THEN 'P2_HIGH' WHEN band = 'DEGRADED' AND criticality >= 3 THEN 'P2_HIGH'
    WHEN pressing AND (band = 'WATCH' OR criticality >= 2) THEN 'P2_HIGH' WHEN band IN ('DEGRADED', 'WATCH') OR pressing THEN 'P3_MEDIUM' ELSE 'P4_ROUTINE' END AS maintenance_priority,
  CASE WHEN band = 'CRITICAL' AND criticality >= 3 THEN 'CRITICAL_HEALTH_HIGH_CRITICALITY' WHEN band = 'CRITICAL' THEN 'CRITICAL_HEALTH' WHEN band = 'DEGRADED' AND criticality >= 3 THEN 'DEGRADED_HEALTH_HIGH_CRITICALITY'
    WHEN pressing THEN concat_ws('|', CASE WHEN od > 0 THEN 'INSPECTION_OVERDUE' END, CASE WHEN dc > 0 THEN 'MAINTENANCE_DEFERRED' END, CASE WHEN duc > 0 THEN 'RECENT_DIRECT_UNPLANNED_OUTAGE' END,
      CASE operational_status WHEN 'maintenance' THEN 'STATUS_MAINTENANCE' WHEN 'retired' THEN 'STATUS_RETIRED' END)
    WHEN band IN ('DEGRADED', 'WATCH') THEN band ELSE 'ROUTINE_REVIEW' END AS priority_reasons FROM h3""")
def health_priority(s, d):
    return health.priority(_health(s, d)).select("asset_id", "maintenance_priority", F.concat_ws("|", "priority_reasons").alias("priority_reasons"))


@query("health_fleet", HEALTH + " SELECT asset_type, count(*) AS assets, avg(score) AS mean_score, median(score) AS median_score, min(score) AS min_score, max(score) AS max_score FROM h3 GROUP BY ALL")
def health_fleet(s, d):
    return health.fleet(_health(s, d), ["asset_type"]).drop("mean_completeness")


@query("health_reasons", HEALTH + f""" SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN r > 1 THEN 'AGE_BEYOND_EXPECTED_LIFE' END, CASE WHEN r >= 0.85 AND r <= 1 THEN 'AGE_NEAR_EXPECTED_LIFE' END, CASE WHEN od > 0 THEN 'INSPECTION_OVERDUE' END, CASE WHEN od <= 0 AND {NOW} - last_inspection_day <= 180 THEN 'GOOD_RECENT_INSPECTION' END, CASE WHEN dc > 0 THEN 'MAINTENANCE_DEFERRED' END, CASE WHEN mc > 0 AND cc / mc::DOUBLE >= 0.5 THEN 'HIGH_CORRECTIVE_MAINTENANCE_SHARE' END, CASE WHEN ec > 0 THEN 'RECENT_EMERGENCY_MAINTENANCE' END, CASE WHEN fc > 0 THEN 'FOLLOW_UP_WORK_OUTSTANDING' END, CASE WHEN tc = 0 THEN 'INSUFFICIENT_TELEMETRY' END, CASE WHEN hs >= 0.25 THEN 'SUSTAINED_HIGH_UTILISATION' END, CASE WHEN hs < 0.25 THEN 'LOW_OPERATIONAL_STRESS' END, CASE WHEN xu >= 75 THEN 'PEAK_TEMPERATURE_STRESS' END, CASE WHEN ac >= 2 THEN 'REPEATED_OPERATIONAL_ALARMS' END, CASE WHEN duc > 0 THEN 'RECENT_DIRECT_UNPLANNED_OUTAGE' END, CASE WHEN efc > 0 THEN 'EQUIPMENT_FAILURE_OUTAGE_HISTORY' END, CASE WHEN mc = 0 THEN 'INSUFFICIENT_MAINTENANCE_HISTORY' END, CASE WHEN operational_status = 'maintenance' THEN 'STATUS_MAINTENANCE' END], lambda x: x IS NOT NULL)[1:5]) AS reason FROM h3) GROUP BY ALL""")
def health_reasons(s, d):
    return health.reason_counts(health.reasons(_health(s, d), NOW))


@query("val_duplicates", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS k, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN n = 1 THEN 0 WHEN k = 1 THEN n - 1 ELSE 1 END AS n_duplicate_issues FROM x")
def val_duplicates(s, d):
    rows = a.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return validation.duplicate_issues(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate"])


@query("val_fk_anti", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_suppkey % 10 <> 0)")
def val_fk_anti(s, d):
    return validation.missing_keys(a.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", a.table(s, d, "supplier").filter("s_suppkey % 10 <> 0"), "s_suppkey")


@query("val_hierarchy", "SELECT s_suppkey, s_nationkey, array_to_string(list_filter([CASE WHEN s_nationkey % 5 IS DISTINCT FROM n_regionkey THEN 'claimed_region' END, CASE WHEN 'NATION_' || (s_nationkey % 7) IS DISTINCT FROM n_name THEN 'claimed_name' END], lambda x: x IS NOT NULL), '|') AS mismatched FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey % 5 IS DISTINCT FROM n_regionkey OR 'NATION_' || (s_nationkey % 7) IS DISTINCT FROM n_name")
def val_hierarchy(s, d):
    rows = a.table(s, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_nationkey") % 5).alias("claimed_region"), F.concat(F.lit("NATION_"), F.col("s_nationkey") % 7).alias("claimed_name"))
    return validation.hierarchy_mismatches(rows, "s_nationkey", a.table(s, d, "nation"), "n_nationkey", {"claimed_region": "n_regionkey", "claimed_name": "n_name"}).select("s_suppkey", "s_nationkey", F.array_join("mismatched", "|").alias("mismatched"))


@query("val_ranges", "SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter([CASE WHEN NOT l_quantity BETWEEN 2 AND 45 THEN 'l_quantity' END, CASE WHEN NOT l_discount BETWEEN 0 AND 0.08 THEN 'l_discount' END], lambda x: x IS NOT NULL), '|') AS fields FROM lineitem")
def val_ranges(s, d):
    rows = validation.range_issues(a.table(s, d, "lineitem"), {"l_quantity": (2, 45), "l_discount": (0, 0.08)})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.transform("issues", lambda i: i["field"]), "|").alias("fields"))


@query("val_chronology", "SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def val_chronology(s, d):
    o = a.table(s, d, "orders").select("o_orderkey", "o_orderdate")
    return a.table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")


@query("val_ingestion", "WITH x AS (SELECT o_orderpriority AS dataset, o_totalprice < 20000 AS bad, o_orderstatus = 'P' AS warn FROM orders) SELECT coalesce(dataset, 'ALL') AS dataset, count(*) AS discovered, count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS invalid, count(*) FILTER (warn) AS with_warnings, count(*) FILTER (bad) / count(*)::DOUBLE AS error_rate, CASE WHEN count(*) FILTER (bad) / count(*)::DOUBLE > 0.1 THEN 'FAILED_QUALITY_THRESHOLD' ELSE 'PASSED' END AS status FROM x GROUP BY ROLLUP (dataset)")
def val_ingestion(s, d):
    o = a.table(s, d, "orders")
    found = validation.issues(validation.issue(F.col("o_totalprice") < 20000, "VALUE_OUT_OF_RANGE", "o_totalprice"), validation.issue(F.col("o_orderstatus") == "P", "CHRONOLOGY_INVALID", "o_orderstatus", severity="WARNING"))
    return validation.ingestion_metrics(o.select(F.col("o_orderpriority").alias("dataset"), found.alias("issues")))


@query("mon_freshness", """WITH e AS (SELECT event_type, CASE WHEN event_type <> 'signup' OR user_id % 50 <> 0 THEN ts END AS ts FROM events), f AS (SELECT event_type, count(*) AS n, max(ts) AS latest, count(*) - count(ts) AS without_time, date_diff('minute', max(ts), TIMESTAMP '2024-01-31 00:00:00') AS age FROM e GROUP BY ALL UNION ALL SELECT 'nobody', 0, NULL, NULL, NULL)
SELECT event_type, n, latest, CASE WHEN n = 0 THEN 'DATASET_EMPTY' WHEN without_time > 0 THEN 'EVENT_TIMESTAMP_MISSING' WHEN age <= 20 THEN 'DATA_FRESH' WHEN age <= 40 THEN 'DATA_STALE' ELSE 'DATA_VERY_STALE' END AS reason, CASE WHEN n = 0 THEN 'NOT_AVAILABLE' WHEN without_time > 0 THEN 'DEGRADED' WHEN age <= 20 THEN 'HEALTHY' WHEN age <= 40 THEN 'DEGRADED' ELSE 'FAILED' END AS status FROM f""")
def mon_freshness(s, d):
    e = a.table(s, d, "events").withColumn("ts", F.when((F.col("event_type") != "signup") | (F.col("user_id") % 50 != 0), F.col("ts")))
    found = monitoring.freshness(e, "event_type", "ts", "2024-01-31 00:00:00", 20)
    return monitoring.expected_datasets(found, ["nobody"], "event_type").select("event_type", "n", "latest", "reason", "status")


@query("mon_volume", "WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS baseline FROM c) SELECT event_type, day, n, (n - baseline) / baseline::DOUBLE AS pct_change, CASE WHEN n < 10 THEN 'VOLUME_BELOW_MINIMUM' WHEN n > 1000000 THEN 'VOLUME_ABOVE_MAXIMUM' WHEN baseline IS NULL THEN 'NO_VOLUME_BASELINE' WHEN (n - baseline) / baseline::DOUBLE <= -0.1 THEN 'VOLUME_DROP' WHEN (n - baseline) / baseline::DOUBLE >= 0.1 THEN 'VOLUME_SPIKE' ELSE 'VOLUME_IN_RANGE' END AS reason FROM b")
def mon_volume(s, d):
    from pyspark.sql.window import Window

    c = a.table(s, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return monitoring.volume(c.withColumn("baseline", F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))), 10, 1_000_000, change=0.1).select("event_type", "day", "n", "pct_change", "reason")


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = a.table(s, d, "events")
    return e.filter("ts < timestamp_ntz'2024-01-16 00:00:00'"), e.filter("ts >= timestamp_ntz'2024-01-16 00:00:00'")


@query("mon_drift_numeric", "WITH m AS (SELECT avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS a, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS b FROM events) SELECT 'value' AS field, a AS old_mean, b AS new_mean, abs(b - a) AS drift, abs(b - a) > 0.5 AS drifted, CASE WHEN abs(b - a) > 0.5 THEN 'NUMERIC_DISTRIBUTION_DRIFT' ELSE 'NO_DISTRIBUTION_DRIFT' END AS reason FROM m")
def mon_drift_numeric(s, d):
    return monitoring.numeric_drift(*_halves(s, d), ["value"], 0.5)


@query("mon_drift_tvd", "WITH c AS (SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY ALL) SELECT 'event_type' AS field, 0.5 * sum(abs(a / (SELECT sum(a) FROM c)::DOUBLE - b / (SELECT sum(b) FROM c)::DOUBLE)) AS drift, CASE WHEN drift > 0.001 THEN 'CATEGORICAL_DISTRIBUTION_DRIFT' ELSE 'NO_DISTRIBUTION_DRIFT' END AS reason FROM c")
def mon_drift_tvd(s, d):
    return monitoring.categorical_drift(*_halves(s, d), "event_type", 0.001)


@query("mon_schema_diff", "WITH o AS (SELECT DISTINCT 'f' || (user_id % 40) AS field, CASE WHEN user_id % 40 % 3 = 0 THEN 'string' ELSE 'number' END AS type, user_id % 40 % 2 = 0 AS required FROM events WHERE user_id % 40 < 25), n AS (SELECT DISTINCT 'f' || (user_id % 40) AS field, CASE WHEN user_id % 40 % 5 = 0 THEN 'string' ELSE 'number' END AS type, user_id % 40 % 4 = 0 AS required FROM events WHERE user_id % 40 >= 10), b AS (SELECT coalesce(o.field, n.field) AS field, CASE WHEN o.type IS NULL AND n.required THEN 'ADDED_REQUIRED' WHEN o.type IS NULL THEN 'ADDED_OPTIONAL' WHEN n.type IS NULL THEN 'REMOVED' WHEN o.type <> n.type THEN 'TYPE_CHANGED' WHEN o.required <> n.required THEN 'REQUIREMENT_CHANGED' END AS change FROM o FULL JOIN n ON o.field = n.field) SELECT field, change, change <> 'ADDED_OPTIONAL' AS breaking, CASE change WHEN 'ADDED_OPTIONAL' THEN 'INFO' WHEN 'ADDED_REQUIRED' THEN 'WARNING' ELSE 'HIGH' END AS severity FROM b WHERE change IS NOT NULL")
def mon_schema_diff(s, d):
    u = F.col("user_id") % 40
    e = a.table(s, d, "events")
    fields = lambda rows, m, r: rows.select(F.concat(F.lit("f"), u).alias("field"), F.when(u % m == 0, "string").otherwise("number").alias("type"), (u % r == 0).alias("required")).distinct()
    return monitoring.schema_diff(fields(e.filter(u < 25), 3, 2), fields(e.filter(u >= 10), 5, 4))


@query("mon_alerts", """WITH r AS (SELECT event_id, event_type AS component, user_id AS scope_id, user_id % 7 AS sample_size, CASE WHEN value > 100 THEN 'DATA_VERY_STALE' WHEN value > 50 THEN 'VOLUME_DROP' ELSE 'DATA_FRESH' END AS reason_code, CASE WHEN value > 100 THEN 'FAILED' WHEN value > 50 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status, CASE WHEN value > 20 THEN 'WARNING' ELSE 'INFO' END AS own FROM events),
i AS (SELECT *, CASE WHEN reason_code = 'DATA_VERY_STALE' THEN 'HIGH' ELSE own END AS severity, substr(sha256('run|' || component || '|||' || scope_id || '||value|' || reason_code), 1, 16) AS alert_id FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY event_id) AS k FROM i),
s AS (SELECT *, CASE WHEN k > 1 THEN 'DUPLICATE_ALERT_SUPPRESSED' WHEN sample_size < 2 THEN 'INSUFFICIENT_SAMPLE_SUPPRESSED' WHEN severity = 'INFO' THEN 'INFO_ALERT_SUPPRESSED' END AS suppression_reason FROM k)
SELECT event_id, alert_id, severity, suppression_reason, CASE WHEN suppression_reason IS NOT NULL THEN 'SUPPRESSED' WHEN status IN ('DEGRADED', 'FAILED') THEN 'TRIGGERED' ELSE 'NOT_TRIGGERED' END AS alert_status FROM s""")
def mon_alerts(s, d):
    v = F.col("value")
    r = a.table(s, d, "events").select("event_id", F.lit("run").alias("monitoring_run_id"), F.col("event_type").alias("component"), F.col("user_id").alias("scope_id"), F.lit("value").alias("metric"), (F.col("user_id") % 7).alias("sample_size"),
                                       F.when(v > 100, "DATA_VERY_STALE").when(v > 50, "VOLUME_DROP").otherwise("DATA_FRESH").alias("reason_code"), F.when(v > 100, "FAILED").when(v > 50, "DEGRADED").otherwise("HEALTHY").alias("status"), F.when(v > 20, "WARNING").otherwise("INFO").alias("severity"))
    return monitoring.alerts(r, ["event_id"]).select("event_id", "alert_id", "severity", "suppression_reason", "alert_status")


CHUNKS = "cz AS (SELECT doc_id, coalesce(text, '') AS t, greatest(1, CAST(ceil((length(coalesce(text, '')) - 100) / 700.0::DOUBLE) AS BIGINT)) AS n FROM documents), cy AS (SELECT doc_id, i, trim(substr(t, i * 700 + 1, 800), ' ') AS chunk FROM (SELECT *, unnest(range(0, n)) AS i FROM cz)), ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_index, chunk FROM cy WHERE chunk <> '')"


@query("ret_chunks", "WITH " + CHUNKS + " SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, 'CHK-' || upper(substr(sha256(CAST(doc_id AS VARCHAR) || '|' || chunk_index || '|' || chunk), 1, 12)) AS chunk_id FROM ch")
def ret_chunks(s, d):
    return retrieval.chunks(a.table(s, d, "documents"), "doc_id", "text", 800, 100).select("doc_id", "chunk_index", "chunk_id")


@query("ret_unique", "SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def ret_unique(s, d):
    return retrieval.unique_content(a.table(s, d, "documents"), "doc_id", "text")


POSTINGS = "po AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_][A-Za-z0-9_-]*'), lambda x: lower(x))) AS token FROM documents) GROUP BY ALL)"


@query("ret_tokens_df", "WITH " + POSTINGS + " SELECT token, count(*) AS df FROM po GROUP BY ALL")
def ret_tokens_df(s, d):
    return retrieval.document_frequency(retrieval.postings(a.table(s, d, "documents"), "doc_id", "text"))


SEARCH = POSTINGS + """, q AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_][A-Za-z0-9_-]*'), lambda x: lower(x))) AS token FROM benchmark) GROUP BY ALL), qn AS (SELECT item_id, sum(qtf) AS qn FROM q GROUP BY ALL), df AS (SELECT token, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM po GROUP BY ALL),
sr AS (SELECT q.item_id, po.doc_id, sum(least(qtf, tf) * idf) / any_value(qn) AS score FROM q JOIN po ON po.token = q.token JOIN df ON df.token = q.token JOIN qn ON qn.item_id = q.item_id GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sr)"""


def _search(s: SparkSession, d: str) -> DataFrame:
    docs = a.table(s, d, "documents")
    n = docs.agg(F.count("*").alias("n")).select("n").scalar()
    return retrieval.search(retrieval.postings(docs, "doc_id", "text"), n, a.table(s, d, "benchmark"), "doc_id", "item_id", "text", 5)


@query("ret_search_topk", "WITH " + SEARCH + " SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 5")
def ret_search_topk(s, d):
    return _search(s, d).select("item_id", "doc_id", "score", "rank")


@query("ret_context_budget", "WITH " + SEARCH + ", u AS (SELECT rk.item_id, rk.rank, score, sum(n_chars) OVER (PARTITION BY item_id ORDER BY rank) AS used FROM rk JOIN documents d ON d.doc_id = rk.doc_id WHERE rank <= 5) SELECT item_id, count(*) AS chunks FROM u WHERE rank = 1 OR used <= 6000 GROUP BY ALL")
def ret_context_budget(s, d):
    hits = _search(s, d).join(a.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return retrieval.context_budget(hits, "item_id", "n_chars", 6000).groupBy("item_id").agg(F.count("*").alias("chunks"))


@query("ret_grounding", "WITH " + SEARCH + " SELECT item_id, count(*) AS chunks, least(1, count(*) / 5.0::DOUBLE) AS coverage, least(1, (least(1, avg(score) / 3) + least(1, count(*) / 5.0::DOUBLE) + 2) / 4) AS confidence FROM rk WHERE rank <= 5 GROUP BY ALL")
def ret_grounding(s, d):
    return retrieval.grounding(_search(s, d), "item_id", 5).drop("grounded")


@query("doc_flatten", """WITH p AS (SELECT event_id, to_json({'event': {'kind': event_type, 'more': json(props), 'seen.at': {'user': user_id, 'odd': user_id % 2 = 1, 'none': NULL}}, 'list': range(0, user_id % 30), 'value': CAST(event_id % 97 AS BIGINT)}) AS j FROM events),
  t AS (SELECT event_id, key, value, type, fullkey, path, id, parent FROM p, json_tree(p.j) AS t),
  l AS (SELECT event_id, n.*, CASE WHEN type = 'NULL' THEN 'null' WHEN type = 'BOOLEAN' THEN CASE WHEN CAST(value AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END
      WHEN type = 'ARRAY' THEN replace(CAST(CAST(CAST(value AS BIGINT[])[1:20] AS JSON) AS VARCHAR), ' ', '') WHEN type = 'VARCHAR' THEN json_extract_string(value, '$') ELSE CAST(value AS VARCHAR) END AS shown
    FROM (SELECT event_id, t.type, t.value, t.id, t.parent, t.key FROM t WHERE type <> 'OBJECT') n),
  up AS (SELECT a.event_id, a.id, CASE WHEN c.key IS NULL AND b.key IS NULL THEN [a.key] WHEN c.key IS NULL THEN [b.key, a.key] ELSE [c.key, b.key, a.key] END AS keys, a.shown
    FROM l a JOIN t b ON b.event_id = a.event_id AND b.id = a.parent LEFT JOIN t c ON c.event_id = a.event_id AND c.id = b.parent WHERE b.type = 'OBJECT')
  SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY keys) AS INTEGER) AS line_no, array_to_string(keys, '.') || '=' || shown AS line FROM up""")
def doc_flatten(s, d):
    from .operators import documents

    e = a.table(s, d, "events")
    inner = F.struct(F.col("user_id").alias("user"), (F.col("user_id") % 2 == 1).alias("odd"), F.lit(None).cast("string").alias("none"))
    numbers = F.filter(F.sequence(F.lit(0), F.col("user_id") % 30), lambda x: x < F.col("user_id") % 30)
    kind, more, at = F.to_json(F.struct(F.col("event_type").alias("kind"))), F.col("props"), F.to_json(inner, {"ignoreNullFields": "false"})
    event = F.concat(F.rtrim(kind, F.lit("}")), F.lit(',"more":'), more, F.lit(',"seen.at":'), at, F.lit("}"))
    text = F.concat(F.lit('{"event":'), event, F.lit(',"list":'), F.to_json(numbers), F.lit(',"value":'), (F.col("event_id") % 97).cast("string"), F.lit("}"))
    return documents.flattened(e.select("event_id", text.alias("payload")), ["event_id"], "payload")


@query("ret_classify", """WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS x, upper(coalesce(text, '')) AS y FROM conversations) SELECT conv_id, turn, CASE WHEN x LIKE '%real%' AND (x LIKE '%current%' OR x LIKE '%live%') THEN 'unsupported' WHEN regexp_matches(x, 'forecast|demand|load') THEN 'forecast_summary' WHEN regexp_matches(x, 'maintenance priority|highest maintenance') THEN 'maintenance_priority' WHEN regexp_matches(x, 'asset') THEN 'asset_health' WHEN regexp_matches(x, 'health score') THEN 'asset_health' WHEN regexp_matches(x, 'outage risk|risk score|elevated outage') THEN 'outage_risk' WHEN regexp_matches(x, 'reliability|saifi|saidi|caidi|asai') THEN 'reliability_performance' WHEN regexp_matches(x, 'monitoring|alert') THEN 'monitoring_alerts' WHEN regexp_matches(x, 'incident|investigate|why') THEN 'incident_investigation' WHEN regexp_matches(x, 'executive|summary|status') THEN 'executive_summary' WHEN regexp_matches(x, 'methodology|calculated|how are|limitations') THEN 'methodology' ELSE 'unsupported' END AS query_category,
regexp_matches(x, 'open breaker|open this breaker|close breaker|switch feeder|switch this feeder|override protection|change protection|protection setting|dispatch crew|send crew automatically|guarantee|will definitely outage') OR regexp_matches(x, '\bsuppress\b.*\balerts?\b|\b(bypass|silence)\b.*\balarms?\b') AS restricted FROM t""")
def ret_classify(s, d):
    return retrieval.classify(a.table(s, d, "conversations"), "text").select("conv_id", "turn", "query_category", "restricted")


@query("ret_sections")
def ret_sections(s, d):
    """HTML sections; compared with a parser-based version in the tests."""
    return retrieval.sections(a.table(s, d, "pages"), "page_id", "html")


@query("mart_dims", "WITH m AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS supplier FROM supplier UNION SELECT DISTINCT CAST(l_suppkey AS VARCHAR) FROM lineitem) SELECT supplier, 'SUP_' || upper(substr(sha256(supplier), 1, 16)) AS supplier_key, s_name AS name FROM m LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = supplier UNION ALL SELECT 'UNKNOWN', 'SK_UNKNOWN', NULL")
def mart_dims(s, d):
    sup = a.table(s, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_name").alias("name"))
    used = a.table(s, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.lit(None).cast("string").alias("name")).distinct()
    return mart.dimension([sup, used], "SUP", ["supplier"], "supplier_key", {"name": F.col("name")})


def _fact(s: SparkSession, d: str) -> DataFrame:
    return mart.fact(a.outages(s, d), "OUT", ["outage_id"], "outage_key", {"feeder_key": ("FDR", ["feeder_id"]), "region_key": ("REG", ["region"])}, ["customers", "duration_minutes", "load_mw"])


@query("mart_facts", a.OUTAGES + " SELECT 'OUT_' || upper(substr(sha256(outage_id), 1, 16)) AS outage_key, 'FDR_' || upper(substr(sha256(CAST(feeder_id AS VARCHAR)), 1, 16)) AS feeder_key, 'REG_' || upper(substr(sha256(region), 1, 16)) AS region_key, customers, duration_minutes, load_mw FROM outages")
def mart_facts(s, d):
    return _fact(s, d)


@query("mart_bridge", "WITH b AS (SELECT doc_id, lang || '|' || source || '||' || lang AS joined FROM documents), p AS (SELECT doc_id, unnest(string_split(joined, '|')) AS value, unnest(range(1, len(string_split(joined, '|')) + 1)) AS position FROM b) SELECT doc_id, 'TAG_' || upper(substr(sha256(trim(value)), 1, 16)) AS tag_key, CAST(position AS INTEGER) AS position, trim(value) AS value FROM p WHERE trim(value) <> ''")
def mart_bridge(s, d):
    rows = a.table(s, d, "documents").select("doc_id", F.concat_ws("|", "lang", "source", F.lit(""), "lang").alias("joined"))
    return mart.bridge(rows, "doc_id", "joined", "TAG", "tag_key")


@query("mart_orphans", "SELECT 'lineitem_supplier' AS relationship, count(*) AS orphans FROM lineitem WHERE l_suppkey % 10 = 0 UNION ALL SELECT 'orders_customer', count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL")
def mart_orphans(s, d):
    li, su, o, c = (a.table(s, d, t) for t in ("lineitem", "supplier", "orders", "customer"))
    return mart.orphans(li.select("l_suppkey"), "l_suppkey", su.filter("s_suppkey % 10 <> 0"), "s_suppkey", "lineitem_supplier").unionByName(mart.orphans(o.select("o_custkey"), "o_custkey", c, "c_custkey", "orders_customer"))


@query("mart_integrity", "SELECT 'lineitem' AS \"table\", count(*) AS rows, count(*) - count(DISTINCT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber) AS duplicate_keys, 0::BIGINT AS unknown_members, 0::BIGINT AS null_critical FROM lineitem")
def mart_integrity(s, d):
    rows = a.table(s, d, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return mart.integrity(rows, "k", ["l_shipdate", "l_quantity"], "lineitem")


@query("mart_measures", KPI + " SELECT level, sum(outage_count)::BIGINT AS total_outages, count(*) AS entities, sum(customer_interruptions)::DOUBLE / sum(population) AS saifi, sum(customer_minutes)::DOUBLE / sum(population) AS saidi, sum(customer_minutes)::DOUBLE / sum(customer_interruptions) AS caidi FROM k GROUP BY level")
def mart_measures(s, d):
    return mart.measures(_kpis(s, d), ["level"])


@query("mart_dim_date", "SELECT strftime(d, '%Y%m%d') AS date_key, CAST(d AS DATE) AS date, CAST(day(d) AS INTEGER) AS day, dayname(d) AS day_name, CAST(isodow(d) AS INTEGER) AS day_of_week, CAST(weekofyear(d) AS INTEGER) AS week_number, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year, isodow(d) >= 6 AS is_weekend FROM generate_series(DATE '2023-12-25', DATE '2025-01-05', INTERVAL 1 DAY) t(d)")
def mart_dim_date(s, d):
    return mart.date_dimension(s, "2023-12-25", "2025-01-05")


@query("mart_dim_time", "SELECT printf('%02d00', h) AS time_key, printf('%02d:00', h) AS time, CAST(h AS INTEGER) AS hour, CAST(0 AS INTEGER) AS minute, printf('%02d:00-%02d:59', h, h) AS interval_label, CASE WHEN h < 6 THEN 'overnight' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END AS daypart FROM range(24) t(h)")
def mart_dim_time(s, d):
    return mart.time_dimension(s)


QUERIES |= star_queries.QUERIES
ORACLES |= star_queries.ORACLES
