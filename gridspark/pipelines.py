"""Runs over files: ingestion of raw datasets by contract, and reliability of what was ingested.

Each run takes a dict of settings (or a YAML file's path), writes its tables as Parquet, its figures as one small JSON file, and
returns a Run. Statuses are fixed values: PASSED, PASSED_WITH_WARNINGS, FAILED_MANIFEST, FAILED_QUALITY_THRESHOLD, COMPLETED.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import epoch_minutes
from .operators import reliability, validation
from .sources import contracts, files, manifest, readers, shared, sinks


class ConfigError(ValueError):
    pass


@dataclass
class Run:
    component: str
    run_id: str
    status: str
    counts: dict[str, dict] = field(default_factory=dict)
    found: list[tuple[str, str]] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)

    def failed(self) -> bool:
        return self.status.startswith("FAILED")


def settings(given: dict | str, needed: tuple[str, ...], defaults: dict) -> dict:
    """Settings with defaults filled in; ConfigError for unknown or absent ones, and for values of another type than the default's."""
    if isinstance(given, str):
        import yaml

        text = files.read_text(SparkSession.active(), given)
        if text is None:
            raise ConfigError(f"{given}: no such file")
        given = yaml.safe_load(text)
    if not isinstance(given, dict):
        raise ConfigError("settings have to be a mapping")
    if unknown := set(given) - set(needed) - set(defaults):
        raise ConfigError(f"unknown: {sorted(unknown)}")
    if absent := [n for n in needed if not given.get(n)]:
        raise ConfigError(f"absent: {absent}")
    for name, value in given.items():
        usual = defaults.get(name)
        if usual is not None and not isinstance(value, (int, float) if isinstance(usual, float) else type(usual)) or isinstance(value, bool) and usual is not None and not isinstance(usual, bool):
            raise ConfigError(f"{name}: {value!r} isn't like {usual!r}")
    return {**defaults, **given}


def run_name(given: str | None) -> str:
    return given or dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%SZ")


def finished(run: Run, root: str, figures: dict) -> Run:
    """Writes the run's file and returns the run."""
    run.paths["metrics"] = f"{root}/{run.component}_{run.run_id}.json"
    now = dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    sinks.write_manifest({**asdict(run), "finished_at": now, **figures, "paths": {k: v for k, v in run.paths.items() if k != "metrics"}}, run.paths["metrics"])
    return run


def load_contracts(spark: SparkSession, given: dict | str) -> dict[str, dict]:
    """Contracts by dataset, from a mapping or a folder of YAML files on any file system."""
    if isinstance(given, dict):
        return {d: contracts.checked(c) for d, c in given.items()}
    found = files.listed(spark, given, "*.y*ml")
    if found is None:
        raise ConfigError(f"{given}: no such folder")
    import yaml

    rows = spark.read.option("pathGlobFilter", "*.y*ml").text(given, wholetext=True).collect()  # as many as datasets
    return {k["dataset"]: k for k in (contracts.checked(yaml.safe_load(r[0])) for r in rows)}


def _issue(code, field_name, severity: str):
    text = lambda v: v.cast("string") if hasattr(v, "cast") else F.lit(v).cast("string")
    return F.struct(text(code).alias("code"), F.lit(severity).alias("severity"), text(field_name).alias("field"), text(None).alias("observed"), text(None).alias("expected"))


def typed(spark: SparkSession, path: str, contract: dict) -> DataFrame:
    """Typed rows of a source with the issues of their line and of the contract, still to be numbered. A line that can't be taken
    apart has that issue alone."""
    rows = validation.typed(readers.raw(spark, path, contract), contract)
    none = F.array().cast(f"array<{validation.ISSUE}>")
    own = F.when(F.col("_issue").isNotNull(), F.array(_issue(F.col("_issue"), None, "ERROR"))).otherwise(F.col("issues"))
    if "_keys" in rows.columns:
        extra = F.transform(validation.unexpected_fields(F.coalesce("_keys", F.array().cast("array<string>")), contracts.fields(contract)), lambda k: _issue("UNEXPECTED_FIELD", k, "WARNING"))
        own = F.concat(own, F.when(F.col("_issue").isNull(), extra).otherwise(none))
    return rows.withColumn("issues", own).drop("_keys", "_issue")


INGESTION = {"contracts": {}, "manifest": "manifest.json", "require_manifest": True, "fail_on_contract_error": True, "maximum_error_rate": 0.1, "relations": []}


def run_ingestion(spark: SparkSession, config: dict | str, run_id: str | None = None) -> Run:
    """Verifies, reads, judges and splits every dataset of the contracts.

    config: source_root, interim_root, quarantine_root, report_root, contracts ({dataset: contract} or a folder of YAML files), and
    INGESTION's other settings; `relations` lists (dataset, key, dimension dataset, its key), each a foreign-key check. Findings about
    files and manifest end the run with FAILED_MANIFEST, if fail_on_contract_error says so. Valid rows go to interim_root/dataset,
    others whole to quarantine_root. Datasets are as many as contracts; rows never reach the driver, only counts.
    """
    c = settings(config, ("source_root", "interim_root", "quarantine_root", "report_root", "contracts"), {k: v for k, v in INGESTION.items() if k != "contracts"})
    kinds = load_contracts(spark, c["contracts"])
    run = Run("ingestion", run_name(run_id), "PASSED")
    listed: dict = {"files": []}
    try:
        listed = manifest.load(spark, f"{c['source_root']}/{c['manifest']}")
        run.found += manifest.entries(listed, sorted(kinds))
        run.found += [(r["name"], r["code"]) for r in manifest.verify(spark, c["source_root"], listed).collect()]  # one row a file
    except manifest.ManifestError as e:
        if c["require_manifest"] or e.code != "MANIFEST_MISSING":
            run.found.append((c["manifest"], e.code))
    sources, strange = manifest.discover(spark, c["source_root"], kinds)
    run.found += strange + [(d, "FILE_MISSING") for d in sorted(set(kinds) - set(sources) - {n for n, code in strange if code == "UNSUPPORTED_FORMAT"})]
    run.found = sorted(set(run.found))
    if run.found and c["fail_on_contract_error"]:
        run.status = "FAILED_MANIFEST"
        return finished(run, c["report_root"], {})

    at = {d: f"{c['interim_root']}/_judged/{run.run_id}/{d}" for d in sources}
    for d, path in sources.items():
        # Typed rows are written before they are judged: a filter on issues would repeat all that issues come from.
        typed(spark, path, kinds[d]).write.mode("overwrite").parquet(f"{at[d]}/typed")
        rows = readers.numbered(spark.read.parquet(f"{at[d]}/typed"), readers.READERS[kinds[d]["format"]][1])
        rows = validation.with_rules(rows, d, kinds[d]["primary_key"])
        rows.write.mode("overwrite").parquet(f"{at[d]}/judged")
    of = {d: spark.read.parquet(f"{p}/judged") for d, p in at.items()}
    for d, key, other, its in c["relations"]:
        if d in of and other in of:
            of[d] = validation.fk_issue(of[d], key, validation.split(of[other])[0], its)
    expected = {f["dataset"]: f.get("records") for f in listed["files"]}
    everything = reduce(DataFrame.unionByName, [rows.select(F.lit(d).alias("dataset"), "issues") for d, rows in of.items()], spark.createDataFrame([], f"dataset string, issues array<{validation.ISSUE}>"))
    run.counts = {r["dataset"]: r.asDict() for r in validation.ingestion_metrics(everything, limit=c["maximum_error_rate"]).collect()}
    for d in sources:
        seen = run.counts.get(d, {}).get("discovered", 0)
        if not seen:
            run.found.append((d, "EMPTY_FILE"))
        if expected.get(d) is not None and expected[d] != seen:
            run.found.append((d, "MANIFEST_COUNT_MISMATCH"))
    if run.found and c["fail_on_contract_error"]:
        run.status = "FAILED_MANIFEST"
        return finished(run, c["report_root"], {})
    for d, rows in of.items():
        valid, bad = validation.split(rows)
        sinks.write_parquet(valid.drop("issues", "_row", "_file"), f"{c['interim_root']}/{d}")
        sinks.write_quarantine(bad, c["quarantine_root"], run.run_id, d)
        run.paths[d] = f"{c['interim_root']}/{d}"
    codes = everything.select("dataset", F.explode("issues").alias("i")).groupBy("dataset", "i.code", "i.severity").agg(F.count("*").alias("n"))
    told = [r.asDict() for r in codes.orderBy("dataset", "code", "severity").collect()]
    for p in at.values():  # what was judged is written where it belongs
        for part in ("typed", "judged"):
            shared.emptied(spark.read.parquet(f"{p}/{part}"))
    whole = run.counts.get("ALL", {})
    if whole.get("status") == "FAILED_QUALITY_THRESHOLD":
        run.status = "FAILED_QUALITY_THRESHOLD"
    elif run.found or whole.get("with_warnings") or whole.get("invalid"):
        run.status = "PASSED_WITH_WARNINGS"
    return finished(run, c["report_root"], {"issues": told})


LEVELS = {"grid_region": "grid_region", "substation": "substation_id", "feeder": "feeder_id"}
RELIABILITY = {"frequency": "full", "sustained_minutes": 5, "restoration_target_minutes": 180, "minimum_population": 1, "minimum_data_completeness": 0.5, "max_reason_codes": 5}


def run_reliability(spark: SparkSession, config: dict | str, run_id: str | None = None) -> Run:
    """KPIs, score, band and reasons per entity of each level and period, and the system's summary, from ingested outages and meters.

    config: interim_root, output_root, start and end of the analysis (timestamps), and RELIABILITY's other settings. Every entity has a row
    in every period. `kpis` has all that was worked out, `reliability` and `reliability_reasons` have the columns of star.SOURCES.
    """
    c = settings(config, ("interim_root", "output_root", "start", "end"), RELIABILITY)
    if c["frequency"] not in ("full", *reliability.PERIODS):
        raise ConfigError(f"frequency: {c['frequency']}")
    minutes = lambda t: int(dt.datetime.fromisoformat(str(t)).replace(tzinfo=dt.UTC).timestamp()) // 60
    start, end = minutes(c["start"]), minutes(c["end"])
    if end <= start:
        raise ConfigError("the end isn't after the start")
    run = Run("reliability", run_name(run_id), "COMPLETED", paths={n: f"{c['output_root']}/{n}" for n in ("kpis", "reliability", "reliability_reasons")})
    meters = spark.read.parquet(f"{c['interim_root']}/smart_meter_events").select(*LEVELS.values(), "meter_id").distinct()
    o = spark.read.parquet(f"{c['interim_root']}/outage_history").withColumns({
        "start_min": epoch_minutes("outage_start"), "planned": F.coalesce("planned_flag", F.lit(False)), "cause": F.col("cause_category"), "severe": F.coalesce("severe_weather_related", F.lit(False)),
        "customers": F.col("customers_interrupted"), "load_mw": F.col("estimated_load_lost_mw")})
    o = reliability.with_period(o.withColumn("end_min", F.col("start_min") + F.col("duration_minutes")), start, end, c["frequency"])
    levelled, members = reliability.by_level(o, LEVELS), reliability.by_level(meters, LEVELS)
    step = end - start if c["frequency"] == "full" else reliability.PERIODS[c["frequency"]]
    first = F.lit(start).cast("long") + F.col("period") * step
    # As many periods as the analysis has, on each entity.
    pop = reliability.population(members, members, "meter_id").withColumn("period", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((end - start - 1) // step).cast("long"))))
    pop = pop.withColumns({"period_start": first, "period_minutes": F.least(first + step, F.lit(end)) - first})
    k = reliability.kpis(levelled, ["level", "entity_id", "period"], pop, "period_minutes", c["sustained_minutes"], c["restoration_target_minutes"])
    k = reliability.reasons(reliability.score(k, c["minimum_population"]), c["minimum_population"], c["max_reason_codes"], c["minimum_data_completeness"])
    place = F.struct("grid_region", F.when(F.col("level") != "grid_region", F.col("substation_id")).alias("substation_id"), F.when(F.col("level") == "feeder", F.col("feeder_id")).alias("feeder_id"))
    places = members.groupBy("level", "entity_id").agg(F.max(place).alias("_p")).select("level", "entity_id", "_p.*")
    sinks.write_parquet(k.join(places, ["level", "entity_id"]), run.paths["kpis"])
    k = spark.read.parquet(run.paths["kpis"])
    iso = lambda m: F.date_format(F.timestamp_seconds(m * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    known = F.when(F.col("population") >= c["minimum_population"], 1.0).otherwise(0.0)
    told = k.select(
        F.lit(run.run_id).alias("reliability_run_id"), F.col("level").alias("entity_type"), "entity_id", "grid_region", "substation_id", "feeder_id", iso(F.col("period_start")).alias("period_start"),
        iso(F.col("period_start") + F.col("period_minutes")).alias("period_end"), F.col("population").alias("population_denominator"), "outage_count", F.col("planned_count").alias("planned_outage_count"),
        F.col("unplanned_count").alias("unplanned_outage_count"), "customer_interruptions", F.col("customer_minutes").alias("customer_interruption_minutes"), "saifi", "saidi_minutes", "caidi_minutes", "asai", "asui",
        "reliability_score", "reliability_band", known.alias("data_completeness_ratio"), F.get("reason_codes", F.lit(0)).alias("primary_reason_code"), "reason_codes")
    sinks.write_parquet(told.drop("reason_codes"), run.paths["reliability"])
    reasons = told.select("reliability_run_id", "entity_type", "entity_id", "period_start", F.posexplode("reason_codes").alias("_at", "reason_code"))
    sinks.write_parquet(reasons.withColumn("reason_rank", F.col("_at") + 1).drop("_at"), run.paths["reliability_reasons"])
    bands = {r["reliability_band"]: r["n"] for r in k.groupBy("reliability_band").agg(F.count("*").alias("n")).collect()}
    system = reliability.system_summary(k, "grid_region").first()
    names = ("saifi", "saidi_minutes", "caidi_minutes", "asai")
    whole = k.agg(F.count("*").alias("n"), F.count_if(F.col("population") > 0).alias("covered"), *[F.count_if(F.col(x).isNull()).alias(x) for x in names]).first()
    run.counts = {"results": {"n": whole.n}}
    figures = {"entities_assessed": whole.n, "population_coverage": whole.covered / whole.n if whole.n else None, "null_kpi_counts": {x: whole[x] for x in names}}
    return finished(run, c["output_root"], {"counts_by_reliability_band": bands, "system": system.asDict() if system else {}, "assessment_start": str(c["start"]), "assessment_end": str(c["end"]), **figures})


RUNS = {"ingestion": run_ingestion, "reliability": run_reliability}
