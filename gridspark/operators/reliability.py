"""Interruption KPIs, overlap-merged downtime, trends, peer benchmarks, scores and reasons.

Outages are rows (level, entity_id, start_min, end_min, duration_minutes, customers, load_mw, planned, cause, severe) with
times in minutes since 1970. An outage belongs to the period in which it starts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import clamp, codes, ladder, ratio
from ..sources.shared import written
from . import ordered

SUSTAINED, TARGET = 5, 180
#: Weights of the reliability score, and the bounds of its inverse-linear parts.
WEIGHTS = {"saifi": 0.25, "saidi": 0.25, "restoration": 0.15, "availability": 0.20, "severe": 0.05, "equipment": 0.05, "completeness": 0.05}
WORST = {"saifi": 5.0, "saidi": 720.0, "restoration": 240.0, "severe": 3.0, "equipment": 3.0}
BANDS = [(50.0, "WEAK"), (70.0, "WATCH"), (85.0, "STABLE")]
#: Period lengths in minutes; a "monthly" period has 31 days.
PERIODS = {"daily": 1440, "weekly": 7 * 1440, "monthly": 31 * 1440}


def duration_band(minutes: str = "duration_minutes", sustained: int = SUSTAINED, target: int = TARGET):
    c = F.col(minutes)
    return F.when(c < sustained, "MOMENTARY").when(c >= target, "PROLONGED").otherwise("SUSTAINED")


def classified(outages: DataFrame, planned: bool = True, unplanned: bool = True, least: int = 0, most: int | None = None) -> DataFrame:
    """Outages inside the limits, with their duration band."""
    keep = (F.lit(planned) & F.col("planned")) | (F.lit(unplanned) & ~F.col("planned"))
    keep &= F.col("duration_minutes") >= least
    if most is not None:
        keep &= F.col("duration_minutes") <= most
    return outages.filter(keep).withColumn("duration_band", duration_band())


def by_level(rows: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Each row once per level of the hierarchy, as (level, entity_id); levels maps a level's name to its column."""
    pairs = F.array(*[F.struct(F.lit(level).alias("level"), F.col(c).cast("string").alias("entity_id")) for level, c in levels.items()])
    return rows.withColumn("_p", F.explode(pairs)).select("*", "_p.level", "_p.entity_id").drop("_p")


def per_level(levels: dict[str, str], of: Callable[[str], DataFrame]) -> DataFrame:
    """(level, entity_id, ...): what `of` makes of each level's column, grouped by that column alone, below each other. Rows aren't
    repeated per level before they are grouped, and coarse levels add up before anything is shuffled."""
    return reduce(DataFrame.unionByName, [of(c).withColumnRenamed(c, "_entity").select(F.lit(level).alias("level"), F.col("_entity").cast("string").alias("entity_id"), "*").drop("_entity") for level, c in levels.items()])


def shared_rows(outages: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, written once, so that all that reads them shares the joins behind them."""
    return written(outages.select(*columns))


def population(members: DataFrame, spine: DataFrame, member: str, keys: Sequence[str] = ("level", "entity_id")) -> DataFrame:
    """Distinct members per key; entities of the spine without members have 0."""
    counted = members.groupBy(*keys).agg(F.count_distinct(member).alias("population"))
    return spine.select(*keys).distinct().join(counted, [*keys], "left").withColumn("population", F.coalesce("population", F.lit(0).cast("long")))


def with_period(rows: DataFrame, start: int, end: int, frequency: str = "full", at: str = "start_min") -> DataFrame:
    """Rows inside [start, end) with period number, first minute and length; the last period is clipped."""
    step = end - start if frequency == "full" else PERIODS[frequency]
    number = F.floor((F.col(at) - start) / F.lit(step)).cast("long")
    first = F.lit(start).cast("long") + number * step
    return rows.filter((F.col(at) >= start) & (F.col(at) < end)).select("*", number.alias("period"), first.alias("period_start"), (F.least(first + step, F.lit(end)) - first).alias("period_minutes"))


def _islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_min, end_min, n): overlapping spans of one key as one, with their counts added up."""
    order = Window.partitionBy(*keys).orderBy("start_min", "end_min")
    reach = F.max("end_min").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(*keys, "start_min", "end_min", "n", reach.alias("_r")).withColumn("_new", (F.col("_r").isNull() | (F.col("start_min") >= F.col("_r"))).cast("long"))
    numbered = marked.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_i").agg(F.min("start_min").alias("start_min"), F.max("end_min").alias("end_min"), F.sum("n").alias("n")).drop("_i")


def merged_minutes(outages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, merged_minutes, overlap_count): the length of the union of intervals; touching intervals don't overlap.

    Intervals are merged by key and day of their start first, and then by key, so a key with most outages is many tasks' work and
    its last task sees islands only.
    """
    days = outages.select(*keys, "start_min", "end_min", F.lit(1).cast("long").alias("n"), F.floor(F.col("start_min") / 1440).alias("_day"))
    spans = _islands(_islands(days, [*keys, "_day"]), keys)
    return spans.groupBy(*keys).agg(F.sum(F.col("end_min") - F.col("start_min")).alias("merged_minutes"), (F.sum("n") - F.count("*")).alias("overlap_count"))


def kpis(outages: DataFrame, keys: list[str], pop: DataFrame, period_minutes: int | str, sustained: int = SUSTAINED, target: int = TARGET, overlap: bool = True) -> DataFrame:
    """KPIs per key, for every row of the population table: an entity, or an entity and period if it has that column. Keys without the
    period must be its columns; period_minutes is a number or a column, of the population table if that has it.

    Frequency and duration indices count sustained outages; outage_count and load count all.
    """
    s = F.col("duration_minutes") >= sustained
    of = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    one = F.lit(1).cast("long")
    held = [F.max(period_minutes).alias("_period")] if isinstance(period_minutes, str) and period_minutes not in pop.columns else []
    # A row per key and duration: medians, means and bands follow from these, in memory of fixed size.
    each = outages.groupBy(*keys, "duration_minutes").agg(
        F.count("*").alias("_n"), of(~F.col("planned"), one).alias("_unplanned"), of(F.col("planned"), one).alias("_planned"), of(F.col("severe"), one).alias("_severe"), of(F.col("cause") == "equipment_failure", one).alias("_equipment"),
        F.sum("customers").alias("_customers"), F.sum("load_mw").alias("_load"), *held)
    length = F.when(s, F.col("duration_minutes"))
    group = Window.partitionBy(*keys)
    upto = F.sum(F.when(s, F.col("_n")).otherwise(0)).over(group.orderBy("duration_minutes").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.withColumns({"_upto": upto, "_all": F.sum(F.when(s, F.col("_n")).otherwise(0)).over(group)})
    at = lambda place: F.max(F.when(s & (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto")), F.col("duration_minutes")))
    median = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.ceil((F.col("_all") - 1) / 2))) / 2
    agg = placed.groupBy(*keys).agg(
        F.sum("_n").alias("outage_count"), of(s, F.col("_n")).alias("sustained_count"), F.sum("_unplanned").alias("unplanned_count"), F.sum("_planned").alias("planned_count"),
        F.sum("_severe").alias("severe_count"), F.sum("_equipment").alias("equipment_count"),
        of(s & (F.col("duration_minutes") >= target), F.col("_n")).alias("prolonged_count"), of(s & (F.col("duration_minutes") <= target), F.col("_n")).alias("restored_in_target"),
        of(s, F.col("_customers")).alias("customer_interruptions"), of(s, F.col("_customers") * F.col("duration_minutes")).alias("customer_minutes"),
        ratio(F.sum(length * F.col("_n")), F.sum(F.when(s, F.col("_n")))).alias("mean_duration"), median.alias("median_duration"), F.max(length).alias("max_duration"),
        F.sum("_load").alias("load_lost"), *([F.max("_period").alias("_period")] if held else []))
    if overlap:
        agg = agg.join(merged_minutes(outages.filter(s), keys), keys, "left")
    pop_keys = [k for k in keys if k in pop.columns]
    out = pop.join(agg, pop_keys, "left")
    counts = ["outage_count", "sustained_count", "unplanned_count", "planned_count", "severe_count", "equipment_count", "prolonged_count", "restored_in_target", "customer_interruptions", "customer_minutes"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts} | {"load_lost": F.coalesce("load_lost", F.lit(0.0))})
    period = F.lit(period_minutes) if isinstance(period_minutes, int) else F.col(period_minutes if period_minutes in pop.columns else "_period")
    merged = F.coalesce("merged_minutes", F.lit(0)) if overlap else F.lit(0)
    if overlap:
        out = out.withColumns({"merged_minutes": F.coalesce("merged_minutes", F.lit(0).cast("long")), "overlap_count": F.coalesce("overlap_count", F.lit(0).cast("long"))})
    lost = F.least(F.col("customer_minutes"), F.col("population") * merged) if overlap else F.col("customer_minutes")
    asai = clamp(F.lit(1.0) - ratio(lost, F.col("population") * period), 0.0, 1.0)
    out = out.withColumns({
        "saifi": ratio("customer_interruptions", "population"), "saidi_minutes": ratio("customer_minutes", "population"), "caidi_minutes": ratio("customer_minutes", "customer_interruptions"),
        "asai": F.when(F.col("population") > 0, asai), "restoration_rate": ratio("restored_in_target", "sustained_count"), "ctaidi_minutes": F.lit(None).cast("double"), "caifi": F.lit(None).cast("double")})
    return out.withColumn("asui", 1 - F.col("asai")).drop("_period")


#: What kpis and population read of outages.
READ = ["start_min", "end_min", "duration_minutes", "customers", "load_mw", "planned", "cause", "severe"]


def kpis_by_level(outages: DataFrame, levels: dict[str, str], spine: DataFrame, member: str, period_minutes: int) -> DataFrame:
    """KPIs of every entity of every level. `levels` maps a level to its column, in the outages and in the spine."""
    rows = shared_rows(outages, [*levels.values(), *READ, member])
    return per_level(levels, lambda c: kpis(rows, [c], population(rows, spine, member, [c]), period_minutes))


def score(k: DataFrame, least_population: int = 1) -> DataFrame:
    """Weighted reliability score and its band; null and INSUFFICIENT_DATA under the least population."""
    inv = lambda x, name: F.coalesce(clamp(100 * (1 - x / F.lit(WORST[name]))), F.lit(100.0))
    parts = {"saifi": inv(F.col("saifi"), "saifi"), "saidi": inv(F.col("saidi_minutes"), "saidi"), "restoration": inv(F.col("mean_duration"), "restoration"),
             "availability": F.coalesce(100 * F.col("asai"), F.lit(0.0)), "severe": inv(F.col("severe_count"), "severe"), "equipment": inv(F.col("equipment_count"), "equipment"),
             "completeness": F.when(F.col("population") >= least_population, 100.0).otherwise(0.0)}
    total = reduce(lambda a, b: a + b, [parts[n] * WEIGHTS[n] for n in WEIGHTS])
    out = k.withColumn("reliability_score", F.when(F.col("population") >= least_population, total))
    return out.withColumn("reliability_band", F.when(F.col("reliability_score").isNull(), "INSUFFICIENT_DATA").otherwise(ladder(F.col("reliability_score"), BANDS, "STRONG")))


def reasons(k: DataFrame, least_population: int = 1, keep: int = 5, least_completeness: float = 0.5) -> DataFrame:
    """Reason codes (fixed values) by falling priority. A column `completeness` is the share of the population that is known; without
    it, the population is known where it has the least size."""
    c = F.col
    known = c("completeness") if "completeness" in k.columns else F.when(c("population") >= least_population, 1.0).otherwise(0.0)
    rules = [
        (known < least_completeness, "LOW_DATA_COMPLETENESS"), (c("population") < least_population, "INSUFFICIENT_POPULATION_DATA"), (c("saifi") >= 1, "HIGH_INTERRUPTION_FREQUENCY"),
        (c("saidi_minutes") >= 120, "HIGH_INTERRUPTION_DURATION"), (c("mean_duration") > 180, "LONG_RESTORATION_TIME"), (c("asai") < 0.99, "LOW_SERVICE_AVAILABILITY"), (c("unplanned_count") > 1, "REPEATED_UNPLANNED_OUTAGES"),
        (c("severe_count") > 0, "SEVERE_WEATHER_OUTAGE_EXPOSURE"), (c("equipment_count") > 0, "EQUIPMENT_FAILURE_OUTAGE_CONCENTRATION"), (c("customer_interruptions") > c("population"), "HIGH_CUSTOMER_INTERRUPTION_VOLUME"),
        (c("prolonged_count") > 0, "PROLONGED_OUTAGE_EVENT"), (c("planned_count") > 0, "PLANNED_OUTAGE_CONCENTRATION"), (c("outage_count") == 0, "INSUFFICIENT_OUTAGE_HISTORY"),
        (c("unplanned_count") == 0, "NO_UNPLANNED_OUTAGES"), (c("asai") >= 0.999, "STRONG_SERVICE_AVAILABILITY")]
    return k.withColumn("reason_codes", codes(rules, keep))


TREND_METRICS = ("saifi", "saidi_minutes", "caidi_minutes", "asai")


def trends(k: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """(keys, period, metric, current, previous, change, pct_change, direction); lower is better but for asai."""
    long = k.unpivot([*keys, period], list(TREND_METRICS), "metric", "current")
    before = F.lag("current").over(Window.partitionBy(*keys, "metric").orderBy(period))
    out = long.withColumn("previous", before).withColumn("change", F.col("current") - F.col("previous")).withColumn("pct_change", 100 * ratio(F.col("change"), F.abs("previous")))
    better = F.when(F.col("metric") == "asai", F.col("change") > 0).otherwise(F.col("change") < 0)
    return out.withColumn("direction", F.when(F.col("change").isNull(), "NO_PRIOR_PERIOD").when(F.col("change") == 0, "UNCHANGED").when(better, "IMPROVED").otherwise("DETERIORATED"))


BENCHMARK_METRICS = ("saifi", "saidi_minutes", "asai", "reliability_score")


def benchmarks(k: DataFrame, peers: list[str], keys: list[str], scope: str = "peer") -> DataFrame:
    """(keys, metric, value, benchmark, gap, percentile): against the median of the peers (or of all, for scope "system");
    the percentile is the share of values up to this one, null with fewer than two."""
    long = written(k.select(*keys, *[p for p in peers if p not in keys], *BENCHMARK_METRICS)).unpivot(keys, list(BENCHMARK_METRICS), "metric", "value").filter("value is not null")
    by = [*(peers if scope == "peer" else []), "metric"]
    ranks = written(ordered.value_ranks(long, by, "value"))
    middle = ordered.median(ranks, by, "value", "benchmark")
    # A row per distinct value of a peer group, so peers of one value are one row here, and a peer group is many keys.
    told = long.join(ranks.select(*by, "value", F.when(F.col("total") >= 2, F.col("upto") / F.col("total")).alias("percentile")), [*by, "value"])
    return told.join(middle, by).select(*keys, "metric", "value", "benchmark", "percentile", (F.col("value") - F.col("benchmark")).alias("gap"))


def system_summary(k: DataFrame, level: str = "region") -> DataFrame:
    """One row over all entities of a level: ratios of sums. Population counts once per entity, and period minutes once per period."""
    rows = k.filter(F.col("level") == level)
    pop = rows.groupBy("entity_id").agg(F.max("population").alias("p")).agg(F.sum("p").alias("population"))
    sums = rows.agg(F.sum("customer_interruptions").alias("ci"), F.sum("customer_minutes").alias("cmi"), F.sum("outage_count").alias("outage_count"))
    return sums.select("*", F.lit(1).alias("_1")).join(pop.select("*", F.lit(1).alias("_1")), "_1").select("population", "outage_count", ratio("ci", "population").alias("saifi"), ratio("cmi", "population").alias("saidi_minutes"), ratio("cmi", "ci").alias("caidi_minutes"))


def extremes(k: DataFrame, by: str = "reliability_score", n: int = 5, lowest: bool = True) -> DataFrame:
    """The n entities with the lowest (or highest) value; a top-k report."""
    order = F.col(by).asc_nulls_last() if lowest else F.col(by).desc_nulls_last()
    return k.orderBy(order, "entity_id").limit(n)
