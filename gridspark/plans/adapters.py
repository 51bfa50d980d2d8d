"""The domain's datasets as views of the star-schema tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import epoch_minutes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """(feeder_id, substation_id, region): suppliers in nations in regions."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").alias("feeder_id"), F.col("n_nationkey").alias("substation_id"), F.col("r_name").alias("region"))


HIERARCHY = "hier AS (SELECT s_suppkey AS feeder_id, n_nationkey AS substation_id, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def outages(spark: SparkSession, d: str) -> DataFrame:
    """An interruption per order line: from the ship date plus a pseudo-random time of day, for its quantity in hours."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    start = epoch_minutes("l_shipdate") + F.col("l_partkey") * 37 % 1440
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(hierarchy(spark, d), F.col("l_suppkey") == F.col("feeder_id")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("outage_id"), start.alias("start_min"), (F.col("l_quantity") * 60).cast("long").alias("duration_minutes"), (start + (F.col("l_quantity") * 60).cast("long")).alias("end_min"),
        "feeder_id", "substation_id", "region", F.col("l_partkey").alias("asset_id"), (F.col("l_linenumber") * 10).cast("long").alias("customers"), F.floor("l_extendedprice").cast("double").alias("load_mw"), (F.col("o_orderstatus") == "P").alias("planned"),
        F.when(F.col("l_returnflag") == "R", "equipment_failure").when(F.col("l_returnflag") == "A", "vegetation").otherwise("unknown").alias("cause"), (F.col("l_linestatus") == "F").alias("severe"), F.col("o_custkey").alias("member"))


OUTAGES = HIERARCHY + """, o0 AS (SELECT l.*, o_custkey, o_orderstatus, feeder_id, substation_id, region, CAST(epoch(l_shipdate) AS BIGINT) // 60 + (l_partkey * 37) % 1440 AS start_min, CAST(l_quantity * 60 AS BIGINT) AS duration_minutes
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN hier ON l_suppkey = feeder_id),
outages AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS outage_id, start_min, duration_minutes, start_min + duration_minutes AS end_min, feeder_id, substation_id, region, l_partkey AS asset_id, CAST(l_linenumber * 10 AS BIGINT) AS customers, floor(l_extendedprice) AS load_mw,
  o_orderstatus = 'P' AS planned, CASE l_returnflag WHEN 'R' THEN 'equipment_failure' WHEN 'A' THEN 'vegetation' ELSE 'unknown' END AS cause, l_linestatus = 'F' AS severe, o_custkey AS member FROM o0)"""


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry: events by type as entities, users as meters."""
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("meter_id"), F.col("event_type").alias("entity"), "value", epoch_minutes("ts").alias("ts_min"))


READINGS = "readings AS (SELECT event_id, ts, user_id AS meter_id, event_type AS entity, value, CAST(floor(epoch(ts) / 60) AS BIGINT) AS ts_min FROM events)"


def hourly_by_user(spark: SparkSession, d: str) -> DataFrame:
    """(entity_id, ts, target): sums per user and hour, a series with gaps at every scale."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("entity_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("target"))


HOURLY_USER = "hu AS (SELECT user_id AS entity_id, date_trunc('hour', ts) AS ts, sum(value) AS target FROM events GROUP BY ALL)"


def hourly_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("entity_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("target"))


HOURLY_TYPE = "ht AS (SELECT event_type AS entity_id, date_trunc('hour', ts) AS ts, sum(value) AS target FROM events GROUP BY ALL)"


def assets(spark: SparkSession, d: str) -> DataFrame:
    """Parts as assets: life from the size, dates from the key."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("asset_id"), F.when(k % 9 == 0, "primary_substation").otherwise(F.col("p_type")).alias("asset_type"), F.col("p_size").cast("double").alias("expected_life_years"), (F.lit(9131).cast("long") - k * 37 % 12000).alias("commissioned_day"), (F.lit(11680).cast("long") - k * 13 % 700).alias("last_inspection_day"),
                                          (F.lit(11500).cast("long") + k * 11 % 400).alias("next_due_day"), (k % 3 + 1).cast("int").alias("criticality"), F.when(k % 40 == 0, "maintenance").otherwise("active").alias("operational_status"), F.when(k % 10 != 0, k % 100 + 1).alias("feeder_id"), (k % 25).cast("int").alias("substation_id"))


ASSETS = "assets AS (SELECT p_partkey AS asset_id, CASE WHEN p_partkey % 9 = 0 THEN 'primary_substation' ELSE p_type END AS asset_type, CAST(p_size AS DOUBLE) AS expected_life_years, 9131 - p_partkey * 37 % 12000 AS commissioned_day, 11680 - p_partkey * 13 % 700 AS last_inspection_day, 11500 + p_partkey * 11 % 400 AS next_due_day, CAST(p_partkey % 3 + 1 AS INTEGER) AS criticality, CASE WHEN p_partkey % 40 = 0 THEN 'maintenance' ELSE 'active' END AS operational_status, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 100 + 1 END AS feeder_id, CAST(p_partkey % 25 AS INTEGER) AS substation_id FROM part)"


def maintenance(spark: SparkSession, d: str) -> DataFrame:
    """Order lines by part as maintenance logs."""
    kind = F.when(F.col("l_returnflag") == "R", "corrective").when(F.col("l_returnflag") == "A", "emergency").otherwise("preventive")
    status = F.when(F.col("l_linenumber") % 5 == 0, "deferred").otherwise("completed")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("asset_id"), F.floor(epoch_minutes("l_shipdate") / 1440).alias("day"), kind.alias("maintenance_type"), status.alias("maintenance_status"), (F.col("l_quantity") * 10).cast("long").alias("downtime_minutes"), F.col("l_extendedprice").alias("cost"), (F.col("l_linestatus") == "F").alias("follow_up"))


MAINTENANCE = "maint AS (SELECT l_partkey AS asset_id, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS day, CASE l_returnflag WHEN 'R' THEN 'corrective' WHEN 'A' THEN 'emergency' ELSE 'preventive' END AS maintenance_type, CASE WHEN l_linenumber % 5 = 0 THEN 'deferred' ELSE 'completed' END AS maintenance_status, CAST(l_quantity * 10 AS BIGINT) AS downtime_minutes, l_extendedprice AS cost, l_linestatus = 'F' AS follow_up FROM lineitem)"


def scored_documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, label, score): toxicity labels with a score from the length (with ties)."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "source", F.col("toxic").alias("label"), F.col("quality"), (F.col("n_chars") % 101 / 100).alias("score"))


SCORED = "scored AS (SELECT l.doc_id, source, toxic AS label, quality, (n_chars % 101) / 100.0::DOUBLE AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
