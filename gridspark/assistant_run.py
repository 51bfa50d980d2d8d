"""The assistant's run: approved sources to chunks, questions to ranked evidence, evidence to grounded answers with citations, or to
refusals; every step is a join or a grouped aggregate over all questions at once.

Sources are data: a registry of folders with their component, what questions they may answer, and whether they are approved. A
chunk carries its source's categories, so what a question may not see is left out before anything is scored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import tokens
from .operators import documents, retrieval
from .pipelines import ConfigError, Run, finished, run_name, settings
from .sources import files, shared, sinks

_COMMON = ("executive_summary", "methodology", "incident_investigation")
#: Folders of sources, their component, the files that count, and categories of questions besides _COMMON.
REGISTRY = [
    ("reports/ingestion", "ingestion", ("md",), ()), ("outputs/forecasting", "forecasting", ("json",), ("forecast_summary",)), ("reports/forecasting", "forecasting", ("md",), ("forecast_summary",)),
    ("outputs/asset_health", "asset_health", ("csv",), ("asset_health", "maintenance_priority")), ("reports/asset_health", "asset_health", ("md",), ("asset_health", "maintenance_priority")),
    ("outputs/outage_prediction", "outage_prediction", ("csv",), ("outage_risk",)), ("reports/outage_prediction", "outage_prediction", ("md",), ("outage_risk",)),
    ("outputs/reliability", "reliability", ("csv",), ("reliability_performance",)), ("reports/reliability", "reliability", ("md",), ("reliability_performance",)),
    ("outputs/monitoring", "monitoring", ("csv",), ("monitoring_alerts",)), ("reports/monitoring", "monitoring", ("md",), ("monitoring_alerts",)),
    ("docs", "documentation", ("md",), ()), ("configs/data_contracts", "contracts", ("yaml",), ()),
]
#: Parts of a path that are never read.
EXCLUDED = ("data/raw/", "data/quarantine/", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", "outputs/genai/", "reports/genai/", ".env")
ASSISTANT = {
    "registry": [], "approved_components": ["ingestion", "forecasting", "asset_health", "outage_prediction", "reliability", "monitoring", "documentation", "contracts"], "excluded": list(EXCLUDED),
    "top_k": 5, "minimum_relevance_score": 0.05, "maximum_context_chunks": 5, "maximum_context_characters": 6000, "chunk_size_characters": 1200, "chunk_overlap_characters": 120,
    "minimum_grounding_coverage": 0.35, "minimum_confidence": 0.45, "provider": "deterministic_local",
}
QUESTION = "query_id string, query_text string, expected_category string, expected_source_components array<string>, expected_response_status string, must_refuse boolean, minimum_citations long"


def registry(c: dict) -> list[dict]:
    """The registry's entries: the usual ones, or those of the settings."""
    if c["registry"]:
        for e in c["registry"]:
            if absent := {"folder", "component", "formats", "categories"} - set(e):
                raise ConfigError(f"registry: an entry without {sorted(absent)}")
        return [{"approved": True, **e} for e in c["registry"]]
    return [{"folder": f, "component": n, "formats": list(x), "categories": [*more, *_COMMON], "approved": n in c["approved_components"]} for f, n, x, more in REGISTRY]


def evidence(spark: SparkSession, root: str, entries: list[dict], excluded: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sections of approved sources, sources with what became of them). An excluded path, or a file of a form that its entry doesn't name, is no
    source; a section that repeats another's content within a source counts once."""
    parts, told = [], []
    for e in entries:  # a dozen folders
        found = files.listed(spark, f"{root}/{e['folder']}", "*", deep=True)
        if found is None:
            continue
        kind = F.lower(F.element_at(F.split("name", r"\."), -1))
        relative = F.substring_index("path", f"{e['folder']}/", -1)
        barred = reduce(Column.__or__, [F.contains("path", F.lit(x)) for x in excluded], F.lit(False))
        state = F.when(F.lit(not e["approved"]), "NOT_APPROVED").when(barred, "EXCLUDED").when(~kind.isin(e["formats"]), "OTHER_FORMAT").otherwise("APPROVED")
        told.append(found.select("path", F.concat(F.lit(f"{e['folder']}/"), relative).alias("source_path"), F.lit(e["component"]).alias("component"), F.array(*map(F.lit, e["categories"])).alias("categories"), state.alias("state")))
        if e["approved"]:
            parts.append(documents.extract(spark, f"{root}/{e['folder']}"))
    empty = spark.createDataFrame([], "path string, source_path string, component string, categories array<string>, state string")
    sources = shared.written(reduce(DataFrame.unionByName, told, empty).withColumn("source_id", F.concat(F.lit("SRC-"), F.upper(F.substring(F.sha2("source_path", 256), 1, 12)))))
    if not parts:
        return spark.createDataFrame([], "source_id string, source_path string, component string, categories array<string>, section int, title string, content string, run_id string, entity_id string, malformed boolean, document_id string, content_hash string"), sources
    # Paths are compared without their scheme: one listing may say file:/x, another file:///x.
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    sections = reduce(DataFrame.unionByName, parts).withColumnRenamed("source_path", "_p").withColumn("_p", plain("_p"))
    own = sources.filter("state = 'APPROVED'").select(plain("path").alias("_p"), "source_id", "source_path", "component", "categories")
    rows = sections.join(own, "_p").withColumn("content_hash", F.sha2("content", 256))
    once = rows.groupBy("source_id", "content_hash").agg(F.min_by(F.struct("source_path", "component", "categories", "section", "title", "content", "run_id", "entity_id", "malformed"), "section").alias("_r")).select("source_id", "content_hash", "_r.*")
    identity = F.concat(F.lit("DOC-"), F.upper(F.substring(F.sha2(F.concat_ws("|", "source_id", F.col("section").cast("string"), "title"), 256), 1, 12)))
    return once.withColumn("document_id", identity), sources


def ranked(chunks: DataFrame, questions: DataFrame, c: dict) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best chunks that may answer each classified question. A token counts per category, so only
    chunks of the question's category meet it; document frequencies are those over all chunks."""
    n = chunks.count()
    post = retrieval.postings(chunks, "chunk_id", "chunk")
    frequency = retrieval.document_frequency(post)
    within = lambda category, token: F.concat_ws("\u0001", category, token)
    cats = chunks.select("chunk_id", F.explode("categories").alias("category"))
    mine = post.join(cats, "chunk_id").select("chunk_id", within("category", "token").alias("token"), "tf")
    asked = retrieval.postings(questions, "query_id", "query_text").join(questions.select("query_id", "query_category"), "query_id")
    df = asked.select("token", "query_category").distinct().join(frequency, "token").select(within("query_category", "token").alias("token"), "df")
    asked = asked.select("query_id", within("query_category", "token").alias("token"), "tf")
    about_chunk = chunks.select("chunk_id", "component", "entity_id", "metrics")
    about_query = questions.select("query_id", "components", "entities", F.array_distinct(tokens("query_text")).alias("words"))

    def boosted(pairs: DataFrame) -> DataFrame:
        hits = pairs.join(about_chunk, "chunk_id").join(about_query, "query_id")
        component = F.array_contains("components", F.col("component"))
        entity = F.coalesce(F.exists("entities", lambda e: e == F.col("entity_id")), F.lit(False))
        return hits.withColumn("boost", retrieval.boost(component, entity, F.lit(True), F.arrays_overlap("metrics", "words")))

    return retrieval.search_postings(mine, asked, n, "chunk_id", "query_id", c["top_k"], c["minimum_relevance_score"], df=df, most=sum(retrieval.BOOSTS.values()), boosted=boosted)


def run_assistant(spark: SparkSession, config: dict | str, run_id: str | None = None) -> Run:
    """Answers questions from the approved sources below a root, and writes responses, retrievals, citations, audits and evaluations.

    config: source_root, output_root, questions (a JSON-lines file with query_id and query_text, and optionally what is expected of the
    response, or a list of such mappings), and ASSISTANT's settings. Restricted questions are refused, questions on live status too; without
    enough evidence the answer says so. A response's columns are those of star.SOURCES. Malformed sources are named in `found` and have no text.
    """
    c = settings(config, ("source_root", "output_root", "questions"), ASSISTANT)
    if not 0 <= c["chunk_overlap_characters"] < c["chunk_size_characters"]:
        raise ConfigError("chunk_overlap_characters isn't under chunk_size_characters")
    run = Run("genai", run_name(run_id), "COMPLETED", paths={n: f"{c['output_root']}/{n}" for n in ("sources", "chunks", "responses", "retrievals", "citations", "audits", "evaluations")})
    given = c["questions"]
    if isinstance(given, list):
        asked = spark.createDataFrame([json.dumps(q) for q in given], "string").select(F.from_json("value", QUESTION).alias("q")).select("q.*") if given else spark.createDataFrame([], QUESTION)
    else:
        asked = spark.read.schema(QUESTION).json(given)
    asked = shared.written(asked.filter("query_id IS NOT NULL"))
    n, ids = asked.agg(F.count("*"), F.count_distinct("query_id")).first()
    if n != ids or not n:
        raise ConfigError(f"questions: {n} with {ids} ids")
    sections, sources = evidence(spark, c["source_root"], registry(c), c["excluded"])
    sinks.write_parquet(sources.drop("path"), run.paths["sources"])
    sections = shared.written(sections)
    run.found = [(r.source_path, "MALFORMED_SOURCE") for r in sections.filter("malformed").select("source_path").distinct().collect()]  # a row per file
    about = sections.select("document_id", "source_id", "source_path", "component", "categories", "title", "content_hash", "run_id", "entity_id", documents.metric_names(F.col("content")).alias("metrics"), documents.reason_codes(F.col("content")).alias("reason_codes"))
    pieces = retrieval.chunks(sections.filter("content <> ''"), "document_id", "content", c["chunk_size_characters"], c["chunk_overlap_characters"])
    sinks.write_parquet(pieces.join(about, "document_id"), run.paths["chunks"])
    chunks = spark.read.parquet(run.paths["chunks"])
    questions = shared.written(retrieval.classify(asked, "query_text"))
    hits = ranked(chunks, questions, c).join(chunks.select("chunk_id", "document_id", "source_id", "source_path", "component", "title", "content_hash", "run_id", "chunk", F.length("chunk").alias("size")), "chunk_id")
    sinks.write_parquet(hits, run.paths["retrievals"])
    hits = spark.read.parquet(run.paths["retrievals"])
    context = shared.written(retrieval.context_budget(hits.filter(F.col("rank") <= c["maximum_context_chunks"]), "query_id", "size", c["maximum_context_characters"]))

    runs_agree = F.when(F.count_distinct("run_id") <= 1, 1.0).otherwise(0.75)
    used = context.groupBy("query_id").agg(F.count("*").alias("chunks"), runs_agree.alias("agree"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "chunk"))).alias("_c"))
    scores = hits.groupBy("query_id").agg(F.avg("score").alias("mean_score"))
    rows = questions.join(used, "query_id", "left").join(scores, "query_id", "left").withColumns({"chunks": F.coalesce("chunks", F.lit(0)), "mean_score": F.coalesce("mean_score", F.lit(0.0))})
    refused = F.col("restricted") | F.col("unsupported_current")
    some = ~refused & (F.col("chunks") > 0)
    cover = F.least(F.lit(1.0), F.col("chunks") / F.lit(float(max(1, c["maximum_context_chunks"]))))
    confidence = F.least(F.lit(1.0), (F.least(F.lit(1.0), F.col("mean_score") / 3) + cover + 1.0 + F.col("agree")) / 4)
    rows = rows.withColumns({"grounding_coverage": F.when(some, cover).otherwise(0.0), "citation_coverage": F.when(some, 1.0).otherwise(0.0), "confidence": F.when(some, confidence).otherwise(0.0)})
    rows = rows.withColumn("grounded", (F.col("grounding_coverage") >= c["minimum_grounding_coverage"]) & (F.col("confidence") >= c["minimum_confidence"]))
    rows = shared.written(retrieval.response_status(rows))

    told = context.join(rows.filter(~refused).select("query_id"), "query_id", "left_semi")
    same = ["query_id", "source_id", "title", "content_hash"]
    cited = told.groupBy(*same).agg(F.min(F.struct("rank", "source_path", "run_id")).alias("_f")).select(*same, "_f.*")
    place = F.row_number().over(retrieval.Window.partitionBy("query_id").orderBy("rank"))
    cited = cited.withColumn("citation_id", F.format_string("SRC-%03d", place)).withColumn("row_reference", F.when(F.contains(F.lower("title"), F.lit("row")), F.col("title")))
    sinks.write_parquet(cited, run.paths["citations"])
    cited = spark.read.parquet(run.paths["citations"])
    ids = cited.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("citation_id")), "|").alias("citation_ids"), F.count("*").alias("citations"))
    out = rows.join(ids, "query_id", "left").withColumns({"citation_ids": F.coalesce("citation_ids", F.lit("")), "citations": F.coalesce("citations", F.lit(0))})
    reason = F.coalesce("safety_reason", F.when(F.col("status") != "GROUNDED", "INSUFFICIENT_GROUNDED_EVIDENCE"))
    sinks.write_parquet(out.select(
        F.lit(run.run_id).alias("assistant_run_id"), "query_id", "query_text", "query_category", F.col("status").alias("response_status"), retrieval.answer(out).alias("answer"), F.round("mean_score", 6).alias("retrieval_score"),
        F.round("grounding_coverage", 6).alias("grounding_coverage"), "citation_coverage", F.round("confidence", 6).alias("response_confidence"), reason.alias("safety_reason_code"), "citation_ids", "citations"), run.paths["responses"])
    text = F.array_join(F.transform(F.coalesce("_c", F.array().cast("array<struct<rank:int,chunk_id:string,chunk:string>>")), lambda x: x.chunk), "\n")
    audited = rows.withColumn("context", text)
    sinks.write_parquet(audited.select(
        "query_id", F.lit(c["provider"]).alias("provider"), "query_category", F.transform("_c", lambda x: x.chunk_id).alias("retrieved_chunk_ids"),
        F.sha2(F.concat_ws("|", F.coalesce("query_text", F.lit("")), "query_category", "context"), 256).alias("prompt_hash"), F.length("context").alias("context_characters"), F.col("status").alias("response_status")), run.paths["audits"])
    responses = spark.read.parquet(run.paths["responses"])
    answered = responses.select("query_id", F.col("response_status").alias("status"), "citations")
    sinks.write_parquet(retrieval.evaluation(asked.filter("expected_category IS NOT NULL"), answered, questions), run.paths["evaluations"])
    run.counts = {"responses": {r["status"]: r["n"] for r in answered.groupBy("status").agg(F.count("*").alias("n")).collect()}, "sources": {r["state"]: r["n"] for r in sources.groupBy("state").agg(F.count("*").alias("n")).collect()}}
    figures = {"rates": retrieval.metrics(answered).first().asDict(), "evaluation": retrieval.evaluation_summary(spark.read.parquet(run.paths["evaluations"])).first().asDict(), "document_count": sections.count(), "chunk_count": chunks.count()}
    return finished(run, c["output_root"], figures)
