"""Hourly series: aggregation, coverage, alignment with weather, gap filling, lag, rolling and horizon features.

Series are rows (entity_id, ts, ...) with ts a timestamp without time zone on a regular grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import calendar


def hourly(readings: DataFrame, entity: str, value: str, member: str, at: str = "ts", first: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    """(entity_id, ts, target, members, first-seen attributes): sums per hour; `first` maps output names to columns taken from
    the earliest row by `order`."""
    hour = F.date_trunc("hour", F.col(at)).cast("timestamp_ntz")
    extra = [F.min_by(c, order or at).alias(name) for name, c in (first or {}).items()]
    return readings.groupBy(F.col(entity).alias("entity_id"), hour.alias("ts")).agg(F.sum(value).alias("target"), F.count_distinct(member).alias("members"), *extra)


def coverage(series: DataFrame) -> DataFrame:
    """Members at a time over the most the entity ever has."""
    return series.withColumn("coverage", F.col("members") / F.max("members").over(Window.partitionBy("entity_id")))


def deduplicated(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Partial aggregation keeps one row per key and task before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*key).agg(pick).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def with_weather(series: DataFrame, weather: DataFrame, on: list[str], order: str) -> DataFrame:
    """Left join on region and time; of several weather rows the last by `order` counts."""
    values = [c for c in weather.columns if c not in (*on, order)]
    last = weather.groupBy(*on).agg(F.max_by(F.struct(*values), order).alias("_w")).select(*on, "_w.*")
    return series.join(last, on, "left")


def filled(series: DataFrame, policy: str = "drop", limit: int = 1, step_minutes: int = 60, value: str = "target") -> DataFrame:
    """Every grid point between an entity's first and last, under a policy for those without a value.

    `drop` leaves missing points out, `forward_fill` repeats the last observation at most `limit` steps back (the rest is left
    out), `mark` keeps all with nulls, `fail` raises if any is missing. Adds `imputed`; other columns are filled like the value.
    """
    if policy not in ("drop", "forward_fill", "mark", "fail"):
        raise ValueError(f"policy {policy} is unknown")
    step = F.expr(f"interval {step_minutes} minutes")
    ends = series.groupBy("entity_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spine = ends.select("entity_id", F.explode(F.sequence("a", "b", step)).alias("ts"))
    others = [c for c in series.columns if c not in ("entity_id", "ts")]
    full = spine.join(series.withColumn("_seen", F.lit(True)), ["entity_id", "ts"], "left").withColumn("imputed", F.col("_seen").isNull())
    if policy == "fail":
        if not full.filter("imputed").isEmpty():
            raise ValueError("the series has gaps")
        return full.drop("_seen")
    if policy == "drop":
        return full.filter(~F.col("imputed")).drop("_seen")
    if policy == "mark":
        return full.drop("_seen")
    past = Window.partitionBy("entity_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_seen"), F.struct(F.col("ts").alias("_at"), *others)), ignorenulls=True).over(past)
    carried = full.select("entity_id", "ts", "imputed", last.alias("_l"))
    age = F.timestamp_diff("MINUTE", F.col("_l._at"), F.col("ts")) / step_minutes
    return carried.filter(age <= limit).select("entity_id", "ts", "imputed", *[F.col(f"_l.{c}").alias(c) for c in others])


def lag_rolling(series: DataFrame, lags: tuple[int, ...] = (1, 2), windows: tuple[int, ...] = (2,), value: str = "target") -> DataFrame:
    """Positional lags (lag_1 is the row's own value) and rolling mean, population deviation, min and max over w rows, where
    there are w; rows without the full history are left out."""
    order = Window.partitionBy("entity_id").orderBy("ts")
    need = max(max(lags, default=1), max(windows, default=1))
    out = series.withColumn("_n", F.row_number().over(order))
    cols = {f"lag_{k}": F.lag(value, k - 1).over(order) for k in lags}
    for w in windows:
        frame = order.rowsBetween(-(w - 1), 0)
        cols |= {f"rolling_mean_{w}": F.avg(value).over(frame), f"rolling_std_{w}": F.stddev_pop(value).over(frame), f"rolling_min_{w}": F.min(value).over(frame), f"rolling_max_{w}": F.max(value).over(frame)}
    return out.withColumns(cols).filter(F.col("_n") >= need).drop("_n")


def with_horizons(features: DataFrame, series: DataFrame, horizons: tuple[int, ...] = (1,), step_minutes: int = 60, value: str = "target") -> DataFrame:
    """A row per horizon whose target time exists: (…, horizon, forecast_ts, actual), found by time and not by position."""
    hs = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    ahead = features.select("*", hs).withColumn("forecast_ts", F.col("ts") + F.make_dt_interval(mins=(F.col("horizon") * step_minutes).cast("int")))
    return ahead.join(series.select("entity_id", F.col("ts").alias("forecast_ts"), F.col(value).alias("actual")), ["entity_id", "forecast_ts"])


def with_calendar(rows: DataFrame, at: str = "forecast_ts") -> DataFrame:
    return rows.withColumns(calendar(at))


def history_gate(series: DataFrame, least: int) -> DataFrame:
    """The series, if every entity has at least `least` points; else ValueError."""
    short = series.groupBy("entity_id").count().filter(F.col("count") < least).limit(1).collect()
    if short:
        raise ValueError(f"{short[0][0]} has {short[0][1]} of {least} points")
    return series


def recent_values(series: DataFrame, n: int, value: str = "target") -> DataFrame:
    """(entity_id, values): the last n values in time order. Only n rows an entity are gathered."""
    back = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("ts").desc()))
    pairs = F.sort_array(F.collect_list(F.struct("ts", value)))
    return series.withColumn("_k", back).filter(F.col("_k") <= n).groupBy("entity_id").agg(pairs.alias("_p")).select("entity_id", F.transform("_p", lambda p: p[value]).alias("values"))
