"""Star schema: dimensions with surrogate keys, facts, bridges, integrity checks, and measures as ratios of sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import UNKNOWN, UNKNOWN_KEY, known, ladder, ratio, surrogate_key


def dimension(members: list[DataFrame], prefix: str, natural: list[str], key: str, attributes: dict[str, Column] | None = None) -> DataFrame:
    """Distinct members of all sources with a surrogate key, and the row of the unknown member. For repeated members the largest
    attributes are kept, so the pick doesn't depend on the order."""
    extra = list(attributes or {})
    rows = None
    for m in members:
        one = m.select(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in natural], *[c.alias(n) for n, c in (attributes or {}).items()])
        rows = one if rows is None else rows.unionByName(one)
    named = rows.filter(F.concat_ws("", *natural) != "")
    distinct = named.groupBy(*natural).agg(F.max(F.struct(*extra)).alias("_a")).select(*natural, *[F.col(f"_a.{n}").alias(n) for n in extra]) if extra else named.select(*natural).distinct()
    unknown = rows.sparkSession.range(1).select(*[F.lit(UNKNOWN).alias(n) for n in natural], *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in extra])
    keyed = distinct.withColumn(key, surrogate_key(prefix, *natural))
    return keyed.unionByName(unknown.withColumn(key, F.lit(UNKNOWN_KEY)))


def date_dimension(spark: SparkSession, start: str, end: str) -> DataFrame:
    """A row per day from start to end, both included."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return d.select(date_key("date").alias("date_key"), "date", F.dayofmonth("date").alias("day"), F.date_format("date", "EEEE").alias("day_name"), (F.weekday("date") + 1).alias("day_of_week"), F.weekofyear("date").alias("week_number"),
                    F.month("date").alias("month"), F.date_format("date", "MMMM").alias("month_name"), F.quarter("date").alias("quarter"), F.year("date").alias("year"), (F.weekday("date") >= 5).alias("is_weekend"))


#: The last hour of each part of the day.
DAYPARTS = [(5, "overnight"), (11, "morning"), (17, "afternoon"), (23, "evening")]


def time_dimension(spark: SparkSession) -> DataFrame:
    """24 rows, one per hour."""
    h = F.col("id").cast("int")
    return spark.range(24).select(F.format_string("%02d00", h).alias("time_key"), F.format_string("%02d:00", h).alias("time"), h.alias("hour"), F.lit(0).alias("minute"), F.format_string("%02d:00-%02d:59", h, h).alias("interval_label"), ladder(h, DAYPARTS, None).alias("daypart"))


def date_key(ts: str | Column) -> Column:
    """yyyyMMdd; without a time the unknown member's key."""
    return F.coalesce(F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyyMMdd"), F.lit(UNKNOWN_KEY))


def time_key(ts: str | Column) -> Column:
    """HH00, as facts join the hour; without a time the unknown member's key."""
    return F.coalesce(F.concat(F.date_format(F.col(ts) if isinstance(ts, str) else ts, "HH"), F.lit("00")), F.lit(UNKNOWN_KEY))


def fact(rows: DataFrame, prefix: str, grain: list[str], key: str, dims: dict[str, tuple[str, list[str]]], measures: list[str]) -> DataFrame:
    """A fact table: its own key from the grain, a foreign key per dimension {name: (prefix, natural columns)}, and measures."""
    return rows.select(surrogate_key(prefix, *grain).alias(key), *[surrogate_key(p, *cols).alias(n) for n, (p, cols) in dims.items()], *measures)


def bridge(rows: DataFrame, key: str, joined: str, prefix: str, out: str) -> DataFrame:
    """(key, out, position): the |-joined list exploded, with a key per element; blank elements are dropped, positions kept."""
    parts = rows.select(key, F.posexplode(F.split(F.coalesce(F.col(joined), F.lit("")), r"\|")).alias("position", "_v")).filter(F.trim("_v") != "")
    return parts.select(key, surrogate_key(prefix, F.trim("_v")).alias(out), (F.col("position") + 1).alias("position"), F.trim("_v").alias("value"))


def orphans(facts: DataFrame, key: str, dim: DataFrame, dim_key: str, name: str) -> DataFrame:
    """(relationship, orphans): facts whose key isn't in the dimension."""
    return facts.join(dim.select(F.col(dim_key).alias(key)).distinct(), key, "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(name).alias("relationship"), "orphans")


def integrity(table: DataFrame, key: str, critical: list[str], name: str) -> DataFrame:
    """(table, rows, duplicate_keys, unknown_members, null_critical)"""
    nulls = [F.col(c).isNull().cast("long") for c in critical] or [F.lit(0).cast("long")]
    total = nulls[0]
    for n in nulls[1:]:
        total = total + n
    return table.agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct(key)).alias("duplicate_keys"), F.sum((F.col(key).cast("string") == UNKNOWN_KEY).cast("long")).alias("unknown_members"), F.sum(total).alias("null_critical")).select(F.lit(name).alias("table"), "*")


def completeness(table: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(table, min, max, avg of the share of given values over the columns)"""
    given = F.aggregate(F.array(*[F.col(c).isNotNull().cast("double") for c in columns]), F.lit(0.0), lambda a, b: a + b) / len(columns)
    return table.agg(F.min(given).alias("min_completeness"), F.max(given).alias("max_completeness"), F.avg(given).alias("avg_completeness")).select(F.lit(name).alias("table"), "*")


def measures(k: DataFrame, by: list[str]) -> DataFrame:
    """Semantic measures of reliability facts: ratios of sums, never means of ratios."""
    s = k.groupBy(*by).agg(F.sum("customer_interruptions").alias("_ci"), F.sum("customer_minutes").alias("_cmi"), F.sum("population").alias("_p"), F.sum("outage_count").alias("total_outages"), F.count_distinct("entity_id").alias("entities"))
    return s.select(*by, "total_outages", "entities", ratio("_ci", "_p").alias("saifi"), ratio("_cmi", "_p").alias("saidi"), ratio("_cmi", "_ci").alias("caidi"))


def asset_facts(scores: DataFrame, components: DataFrame) -> DataFrame:
    """Scores with their components by asset; an asset without components keeps its row."""
    return scores.join(components, "asset_id", "left").withColumn("asset_key", surrogate_key("AST", known("asset_id")))
