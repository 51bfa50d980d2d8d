"""Contract validation: typed projection with issue lists, dataset and relationship rules, severity split.

An issue is a struct (code, severity, field, observed, expected). Rows carry `_row` (their number in the source).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ISSUE = "struct<code:string,severity:string,field:string,observed:string,expected:string>"

#: Plausible ranges of numeric fields, both ends included.
RANGES: dict[str, dict[str, tuple[float, float]]] = {
    "smart_meter_events": {"reading_interval_minutes": (1, 1440), "active_energy_kwh": (0, 10000), "reactive_energy_kvarh": (0, 10000), "voltage_v": (100, 300), "current_a": (0, 10000), "power_factor": (0, 1), "frequency_hz": (45, 55)},
    "substation_events": {"load_mw": (0, 10000), "capacity_mva": (0.001, 10000), "utilisation_pct": (0, 150), "voltage_kv": (0.1, 1000), "frequency_hz": (45, 55), "transformer_temperature_c": (-50, 160), "oil_temperature_c": (-50, 160), "ambient_temperature_c": (-50, 60)},
    "weather_data": {"temperature_c": (-50, 60), "feels_like_c": (-70, 70), "humidity_pct": (0, 100), "wind_speed_mps": (0, 80), "wind_gust_mps": (0, 100), "precipitation_mm": (0, 500), "pressure_hpa": (850, 1100)},
    "asset_inventory": {"expected_life_years": (1, 100), "rated_capacity": (0, 100000)},
    "maintenance_logs": {"downtime_minutes": (0, 100000), "maintenance_cost_gbp": (0, 10000000)},
    "outage_history": {"duration_minutes": (0, 100000), "customers_interrupted": (0, 10000000), "estimated_load_lost_mw": (0, 10000)},
}


def issue(when: Column, code: str, field: str, observed: Column | None = None, expected: str | None = None, severity: str = "ERROR") -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field"), (observed.cast("string") if observed is not None else F.lit(None).cast("string")).alias("observed"), F.lit(expected).cast("string").alias("expected")))


def issues(*found: Column) -> Column:
    return F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{ISSUE}>")


def parsed(raw: Column, kind: str) -> Column:
    """A contract type from text; null where the text doesn't hold it. Stricter than a plain cast: no "1.0" as an integer, no
    t/f/y/n as booleans, no NaN or infinity as numbers."""
    t = F.trim(raw)
    if kind == "integer":
        return F.when(t.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.regexp_replace(t, "_", "").try_cast("long"))
    if kind == "number":
        v = t.try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")) & ~F.lower(t).rlike("[df]$"), v)
    if kind == "boolean":
        low = F.lower(t)
        return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)
    if kind == "timestamp":
        return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), t.try_cast("timestamp"))
    if kind == "date":
        return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t.try_cast("date"))
    return raw


#: The codes that an issue or a refused source can have; users match on them.
ISSUE_CODES = (
    "REQUIRED_FIELD_MISSING", "UNEXPECTED_FIELD", "INVALID_DATA_TYPE", "INVALID_TIMESTAMP", "INVALID_DATE", "VALUE_OUT_OF_RANGE", "INVALID_CATEGORY",
    "DUPLICATE_PRIMARY_KEY", "DUPLICATE_NATURAL_KEY", "FOREIGN_KEY_NOT_FOUND", "HIERARCHY_MISMATCH", "SCHEMA_VERSION_MISMATCH", "MALFORMED_RECORD",
    "EMPTY_FILE", "MANIFEST_MISSING", "MANIFEST_MALFORMED", "MANIFEST_CHECKSUM_MISMATCH", "MANIFEST_COUNT_MISMATCH", "MANIFEST_SIZE_MISMATCH",
    "MANIFEST_DATASET_MISSING", "MANIFEST_DATASET_UNEXPECTED", "MANIFEST_DUPLICATE_ENTRY", "FILE_MISSING", "FILE_UNEXPECTED", "UNSUPPORTED_FORMAT",
    "INCONSISTENT_CSV_ROW", "CHRONOLOGY_INVALID", "DERIVED_VALUE_MISMATCH")
_BAD_TYPE = {"timestamp": "INVALID_TIMESTAMP", "date": "INVALID_DATE"}


def typed(rows: DataFrame, contract: dict) -> DataFrame:
    """Typed columns and `issues` from text columns, by a contract {fields: [{name, type, required, allowed_values}],
    schema_version, dataset}. A blank is null. Columns that the contract doesn't know are warned of and dropped, but for those
    that begin with _."""
    ranges = RANGES.get(contract.get("dataset", ""), {})
    found, cols = [], []
    for f in contract["fields"]:
        name, kind = f["name"], f["type"]
        raw = F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")
        given = F.trim(F.coalesce(raw, F.lit(""))) != ""
        value = parsed(F.when(given, raw), kind)
        cols.append(value.alias(name))
        if f.get("required", True):
            found.append(issue(~given, "REQUIRED_FIELD_MISSING", name))
        found.append(issue(given & value.isNull(), _BAD_TYPE.get(kind, "INVALID_DATA_TYPE"), name, raw, kind))
        if f.get("allowed_values"):
            found.append(issue(given & ~raw.isin([str(v) for v in f["allowed_values"]]), "INVALID_CATEGORY", name, raw, "|".join(map(str, f["allowed_values"]))))
        if name == "schema_version":
            found.append(issue(given & (raw != contract["schema_version"]), "SCHEMA_VERSION_MISMATCH", name, raw, contract["schema_version"]))
        if name in ranges and kind in ("integer", "number"):
            low, high = ranges[name]
            found.append(issue(value.isNotNull() & ~value.between(low, high), "VALUE_OUT_OF_RANGE", name, raw, f"{low}..{high}"))
    known = {f["name"] for f in contract["fields"]}
    own = [c for c in rows.columns if c.startswith("_")]
    for extra in [c for c in rows.columns if c not in known and c not in own]:
        found.append(issue(F.col(extra).isNotNull(), "UNEXPECTED_FIELD", extra, severity="WARNING"))
    return rows.select(*own, *cols, issues(*found).alias("issues"))


def unexpected_fields(keys: Column, contract: Sequence[str]) -> Column:
    return F.array_sort(F.array_except(keys, F.array(*[F.lit(c) for c in contract])))


def range_issues(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumn("issues", issues(*[issue(~F.col(n).between(lo, hi), "VALUE_OUT_OF_RANGE", n, F.col(n), f"{lo}..{hi}") for n, (lo, hi) in ranges.items()]))


def duplicate_issues(rows: DataFrame, key: list[str], order: list[str], out: str = "n_duplicate_issues") -> DataFrame:
    """Adds how many duplicate issues a row has: each later copy of a key one, the first copy as many as there are later ones.

    Rows without a part of the key aren't judged. Counting is partially aggregated. Of rows that are equal in `order`, too, one is
    the first; only these are ranked, so a key with many copies is no task's alone.
    """
    twice = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first")).filter("_n > 1")
    joined = rows.join(twice, key, "left").withColumn("_tied", F.coalesce(F.struct(*order) == F.col("_first"), F.lit(False)))
    spread = F.when(~F.col("_tied"), F.pmod(F.xxhash64(*key, *order), F.lit(1 << 20)))
    place = F.row_number().over(Window.partitionBy(*key, "_tied", spread).orderBy(*order))
    return joined.withColumn(out, F.when(F.col("_n").isNull(), 0).when(F.col("_tied") & (place == 1), F.col("_n") - 1).otherwise(1).cast("long")).select(*rows.columns, out)


def missing_keys(rows: DataFrame, key: str, dimension: DataFrame, dim_key: str) -> DataFrame:
    """Rows whose key isn't in the dimension (rows without a key included)."""
    return rows.join(dimension.select(F.col(dim_key).alias(key)).distinct(), key, "left_anti").select(*rows.columns)


def fk_issue(rows: DataFrame, key: str, dimension: DataFrame, dim_key: str) -> DataFrame:
    """Adds FOREIGN_KEY_NOT_FOUND to `issues` where a given key isn't in the dimension."""
    known = dimension.select(F.col(dim_key).alias(key)).distinct().withColumn("_k", F.lit(True))
    joined = rows.join(known, key, "left")
    return joined.withColumn("issues", F.concat("issues", issues(issue(F.col(key).isNotNull() & F.col("_k").isNull(), "FOREIGN_KEY_NOT_FOUND", key, F.col(key))))).select(*rows.columns)


def hierarchy_mismatches(rows: DataFrame, key: str, dimension: DataFrame, dim_key: str, fields: dict[str, str]) -> DataFrame:
    """Rows whose fields differ (null-safe) from those of their dimension row; `fields` maps the row's column to the dimension's.
    Adds `mismatched`, the names of the fields. Rows without a dimension row are not judged."""
    dim = dimension.select(F.col(dim_key).alias("_k"), *[F.col(d).alias(f"_d_{r}") for r, d in fields.items()])
    joined = rows.join(dim, F.col(key) == F.col("_k"))
    wrong = F.array_compact(F.array(*[F.when(~F.col(r).eqNullSafe(F.col(f"_d_{r}")), F.lit(r)) for r in fields]))
    return joined.withColumn("mismatched", wrong).filter(F.size("mismatched") > 0).select(*rows.columns, "mismatched")


def _before(a: str, b: str, strict: bool = True) -> Column:
    return (F.col(a) < F.col(b)) if strict else (F.col(a) <= F.col(b))


def chronology_issues(dataset: str) -> list[Column]:
    """Rules between fields of one row, by dataset."""
    c = F.col
    bad = lambda when, field, rule, severity="ERROR": issue(when, "CHRONOLOGY_INVALID", field, None, rule, severity)
    if dataset == "smart_meter_events":
        return [bad(_before("ingested_at", "event_timestamp"), "ingested_at", ">= event_timestamp")]
    if dataset == "substation_events":
        off = F.abs(100 * c("load_mw") / F.when(c("capacity_mva") > 0, c("capacity_mva")) - c("utilisation_pct")) > 0.75
        return [bad(_before("ingested_at", "event_timestamp"), "ingested_at", ">= event_timestamp"), issue(off, "DERIVED_VALUE_MISMATCH", "utilisation_pct", c("utilisation_pct"))]
    if dataset == "asset_inventory":
        return [bad(_before("last_inspection_date", "commissioned_date"), "last_inspection_date", ">= commissioned_date"), bad(_before("next_inspection_due", "last_inspection_date"), "next_inspection_due", ">= last_inspection_date"),
                issue((c("asset_type") == "primary_substation") & (F.coalesce(c("feeder_id"), F.lit("")) != ""), "HIERARCHY_MISMATCH", "feeder_id", c("feeder_id"))]
    if dataset == "maintenance_logs":
        done = c("maintenance_status") == "completed"
        return [bad(_before("actual_start", "scheduled_start"), "actual_start", ">= scheduled_start, unless the schedule was changed", "WARNING"), bad(_before("completed_at", "actual_start"), "completed_at", ">= actual_start"),
                issue(done & (c("actual_start").isNull() | c("completed_at").isNull()), "REQUIRED_FIELD_MISSING", "completed_at"), issue(c("maintenance_status").isin("scheduled", "cancelled") & (F.coalesce(c("downtime_minutes"), F.lit(-1)) != 0), "VALUE_OUT_OF_RANGE", "downtime_minutes", c("downtime_minutes"), "0", "WARNING")]
    if dataset == "outage_history":
        took = F.floor((F.unix_timestamp("restoration_time") - F.unix_timestamp("outage_start")) / 60)
        return [bad(_before("restoration_time", "outage_start", strict=False), "restoration_time", "> outage_start"), issue(F.abs(took - c("duration_minutes")) > 1, "DERIVED_VALUE_MISMATCH", "duration_minutes", c("duration_minutes")),
                issue(F.coalesce(c("planned_flag"), F.lit(False)) != F.coalesce(c("outage_type") == "planned", F.lit(False)), "DERIVED_VALUE_MISMATCH", "planned_flag")]
    return []


def with_rules(rows: DataFrame, dataset: str, key: list[str], order: str = "_row") -> DataFrame:
    """Chronology and duplicate issues added to those that error-free rows have."""
    ok = ~F.exists("issues", lambda i: i["severity"] == "ERROR")
    good = rows.filter(ok)
    ruled = duplicate_issues(good.withColumn("issues", F.concat("issues", issues(*chronology_issues(dataset)))), key, [order])
    one = F.struct(F.lit("DUPLICATE_PRIMARY_KEY").alias("code"), F.lit("ERROR").alias("severity"), F.lit(",".join(key)).alias("field"), F.lit(None).cast("string").alias("observed"), F.lit(None).cast("string").alias("expected"))
    ruled = ruled.withColumn("issues", F.concat("issues", F.array_repeat(one, F.col("n_duplicate_issues").cast("int")))).drop("n_duplicate_issues")
    return ruled.unionByName(rows.filter(~ok))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): a row with any ERROR is quarantined."""
    bad = F.exists("issues", lambda i: i["severity"] == "ERROR")
    return rows.filter(~bad), rows.filter(bad)


def ingestion_metrics(rows: DataFrame, by: str = "dataset", limit: float = 0.1) -> DataFrame:
    """Counts per dataset and in total (dataset ALL), error rate, and PASSED or FAILED_QUALITY_THRESHOLD beyond the limit."""
    bad = F.exists("issues", lambda i: i["severity"] == "ERROR")
    warned = F.exists("issues", lambda i: i["severity"] == "WARNING")
    n = lambda cond: F.sum(cond.cast("long"))
    out = rows.rollup(by).agg(F.count("*").alias("discovered"), n(~bad).alias("valid"), n(bad).alias("invalid"), n(warned).alias("with_warnings"), F.grouping(by).alias("_g"))
    rate = F.col("invalid") / F.col("discovered")
    return out.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col(by)).alias(by), "discovered", "valid", "invalid", "with_warnings", rate.alias("error_rate"), F.when(rate > limit, "FAILED_QUALITY_THRESHOLD").otherwise("PASSED").alias("status"))


def reconciled(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(dataset, expected, observed, status) for datasets on either side."""
    both = manifest.select("dataset", "expected").join(counts.select("dataset", "observed"), "dataset", "full_outer")
    return both.withColumn("status", F.when(F.col("expected").isNull(), "UNEXPECTED_DATASET").when(F.col("observed").isNull(), "MISSING_DATASET").when(F.col("expected") == F.col("observed"), "MATCHED").otherwise("RECORD_COUNT_MISMATCH"))
