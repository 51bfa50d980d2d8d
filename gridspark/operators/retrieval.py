"""Lexical evidence retrieval: chunks, postings, top-k scores, context budget, query classification, safety and grounding."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import ratio, share, tokens
from ..sources.shared import written

#: Query categories, the words that choose them (first match wins) and the components that answer them.
CATEGORIES: list[tuple[str, Sequence[str], Sequence[str]]] = [
    ("forecast_summary", ("forecast", "demand", "load"), ("forecasting",)),
    ("maintenance_priority", ("maintenance priority", "highest maintenance"), ("asset_health",)),
    ("asset_health", ("asset health", "health score", "asset"), ("asset_health",)),
    ("outage_risk", ("outage risk", "risk score", "elevated outage"), ("outage_prediction",)),
    ("reliability_performance", ("reliability", "saifi", "saidi", "caidi", "asai"), ("reliability",)),
    ("monitoring_alerts", ("monitoring", "alert", "alerts"), ("monitoring",)),
    ("incident_investigation", ("incident", "investigate", "why"), ("monitoring", "reliability", "outage_prediction")),
    ("executive_summary", ("executive", "summary", "status"), ("monitoring", "reliability", "forecasting")),
    ("methodology", ("methodology", "calculated", "how are", "limitations"), ("documentation",)),
    ("grid_status", ("grid status", "platform status"), ("monitoring",)),
]
#: What is refused, and why.
RESTRICTED: list[tuple[str, str]] = [
    ("open breaker|open this breaker|close breaker|switch feeder|switch this feeder", "RESTRICTED_OPERATIONAL_CONTROL"),
    ("override protection|change protection|protection setting", "RESTRICTED_PROTECTION_CHANGE"),
    ("dispatch crew|send crew automatically", "RESTRICTED_OPERATIONAL_CONTROL"),
    ("guarantee|will definitely outage", "RESTRICTED_REAL_TIME_TARGETING"),
    (r"\bsuppress\b.*\balerts?\b", "RESTRICTED_ALERT_SUPPRESSION"),
    (r"\bbypass\b.*\balarms?\b", "RESTRICTED_ALERT_SUPPRESSION"),
    (r"\bsilence\b.*\balarms?\b", "RESTRICTED_ALERT_SUPPRESSION"),
]
#: How an entity's id looks, and what a match of metadata adds to a score.
ENTITY = r"\b(?:FDR|SUB|GRID|AST)-[A-Z0-9\-]+\b"
BOOSTS = {"component": 1.0, "entity": 1.0, "category": 0.3, "metric": 0.5}


def chunks(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, chunk_index, chunk_id, chunk): pieces of `size` characters, each beginning size - overlap after the last, up to the
    one that reaches the end; trimmed, blank ones dropped, numbered from 1 after that."""
    t = F.coalesce(F.col(text), F.lit(""))
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(t) - overlap) / step)).cast("int")
    parts = F.filter(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.trim(F.substring(t, i * step + 1, F.lit(size)))), lambda c: c != "")
    out = docs.select(key, F.posexplode_outer(parts).alias("chunk_index", "chunk")).filter("chunk is not null").withColumn("chunk_index", F.col("chunk_index") + 1)
    return out.select(key, "chunk_index", F.concat(F.lit("CHK-"), F.upper(F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("chunk_index").cast("string"), "chunk"), 256), 1, 12))).alias("chunk_id"), "chunk")


def unique_content(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The document with the least key of each distinct text."""
    return docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content_hash")).agg(F.min(key).alias(key))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf)"""
    return docs.select(key, F.explode_outer(tokens(text)).alias("token")).filter("token is not null").groupBy(key, "token").agg(F.count("*").alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    """(token, df): postings have one row per key and token, so counting rows counts keys."""
    return post.groupBy("token").agg(F.count("*").alias("df"))


#: Postings of a query's rarest tokens that are scored first, per hit asked for; and the room that rounding to DIGITS leaves in a bound.
SEED, DIGITS, ROOM = 20, 6, 1e-6


def _terms(mine: DataFrame, q: DataFrame, n_docs: Column | int, query: str, df: DataFrame | None = None) -> DataFrame:
    """(query, token, qtf, qn, df, idf, bound): a query's tokens that any document has, and the most that one adds to a lexical sum. q has the
    queries' postings, df (token, df), if that isn't to be counted."""
    q = q.withColumnRenamed("tf", "qtf")
    total = q.groupBy(query).agg(F.sum("qtf").alias("qn"))
    df = mine.groupBy("token").agg(F.count("*").alias("df")) if df is None else df
    df = df.withColumn("idf", F.log((1 + n_docs) / (1 + F.col("df"))) + 1)
    return q.join(total, query).join(df, "token").withColumn("bound", F.col("qtf") * F.col("idf"))


def _best(pairs: DataFrame, key: str, query: str, by: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col(by).desc(), key))
    return written(pairs.select(query, key, place.alias("_r")).filter(F.col("_r") <= k).drop("_r"))


def _least(mine: DataFrame, best: DataFrame, terms: DataFrame, key: str, query: str, k: int) -> DataFrame:
    """(query, least): the smallest whole sum of a query's k documents in `best`, null if there are fewer. Its k-th best sum is no less."""
    theirs = mine.join(best.select(key).distinct(), key, "left_semi")
    sums = best.join(terms.select(query, "token", "qtf", "idf"), query).join(theirs, [key, "token"]).groupBy(query, key).agg(F.sum(F.least("qtf", "tf") * F.col("idf")).alias("sum"))
    return sums.groupBy(query).agg(F.when(F.count("*") == k, F.min("sum")).alias("least"))


def candidates(mine: DataFrame, terms: DataFrame, key: str, query: str, k: int, most: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """((query, key, lexical), terms with `needed`): documents that can be among a query's k best, with what its needed tokens add.

    The k documents that are best by a query's rarest tokens are scored whole; the least of these sums is no more than the k-th best. Tokens
    are left out, the least bounds first, while their bounds add up to less than that: a document with none but such tokens isn't among the k
    best, so the postings of common words aren't joined. Of the others those go that the left-out tokens' bounds can't lift to the least sum
    either, first by these documents' sums and then by those of the k that are best by the needed tokens. `most` is what a boost adds to a
    score at most.
    """
    hit = lambda t: F.sum(F.least("qtf", "tf") * F.col("idf")).alias(t)
    rare = Window.partitionBy(query).orderBy("df", "token").rowsBetween(Window.unboundedPreceding, 0)
    first = terms.withColumn("_c", F.sum("df").over(rare) - F.col("df")).filter(F.col("_c") < SEED * k)
    part = mine.join(first, "token").groupBy(query, key).agg(hit("part"))
    least = _least(mine, _best(part, key, query, "part", k), terms, key, query, k)
    lift = F.lit(most) * F.col("qn")
    terms = terms.join(least, query, "left")
    below = F.sum("bound").over(Window.partitionBy(query).orderBy("bound", "token").rowsBetween(Window.unboundedPreceding, 0))
    needed = F.coalesce(below + lift + ROOM * F.col("qn") >= F.col("least"), F.lit(True))
    terms = written(terms.withColumn("needed", needed))
    rest = terms.groupBy(query).agg(F.sum(F.when(~F.col("needed"), F.col("bound")).otherwise(0.0)).alias("rest"), F.max("least").alias("_least"), F.max(lift + ROOM * F.col("qn")).alias("_more"))
    found = mine.join(terms.filter("needed").select(query, "token", "qtf", "idf"), "token").groupBy(query, key).agg(hit("lexical"))
    able = F.col("_least").isNull() | (F.col("lexical") + F.col("rest") + F.col("_more") >= F.col("_least"))
    kept = written(found.join(rest, query).filter(able))
    closer = _least(mine, _best(kept, key, query, "lexical", k), terms, key, query, k)
    kept = kept.join(closer, query).withColumn("_least", F.col("least")).filter(able)
    return kept.select(query, key, "lexical"), terms


def search(
    post: DataFrame, n_docs: Column | int, queries: DataFrame, key: str, query: str, text: str, k: int, least: float = 0.0, boosts: DataFrame | None = None) -> DataFrame:
    """(query, key, score, rank): the k best per query by score, rounded to DIGITS, then key.

    score = sum over shared tokens of min(query tf, tf) * (ln((1 + N) / (1 + df)) + 1), over the query's tokens, plus boosts
    (query, key, boost; none below 0). See search_postings.
    """
    most, add = 0.0, None
    if boosts is not None:
        most = boosts.agg(F.coalesce(F.max("boost"), F.lit(0.0))).first()[0]
        add = lambda pairs: pairs.join(boosts, [query, key], "left")
    return search_postings(post, postings(queries, query, text), n_docs, key, query, k, least, most=most, boosted=add)


def search_postings(
    post: DataFrame, q: DataFrame, n_docs: Column | int, key: str, query: str, k: int, least: float = 0.0, df: DataFrame | None = None, most: float = 0.0,
    boosted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`search` by postings of documents (key, token, tf) and of queries (query, token, tf).

    Postings are cut to the queries' tokens, and pairs to those that can be among the k best, before scores are completed; the
    result is that of scoring all. `boosted` adds a column `boost` of 0 to `most` (or null) to (query, key, ...); `df` gives document
    frequencies that aren't counted over `post`.
    """
    mine = written(post.join(q.select("token").distinct(), "token", "left_semi").select(key, "token", "tf"))
    terms = written(_terms(mine, q, n_docs, query, df))
    kept, terms = candidates(mine, terms, key, query, k, most)
    kept = written(kept)
    left = kept.select(query, key).join(terms.filter("NOT needed").select(query, "token", "qtf", "idf"), query).join(mine, [key, "token"])
    more = left.groupBy(query, key).agg(F.sum(F.least("qtf", "tf") * F.col("idf")).alias("more"))
    scored = kept.join(more, [query, key], "left").join(terms.groupBy(query).agg(F.max("qn").alias("qn")), query)
    scored = scored.withColumn("score", (F.col("lexical") + F.coalesce("more", F.lit(0.0))) / F.greatest(F.lit(1), F.col("qn")))
    if boosted is not None:
        scored = boosted(scored).withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0)))
    scored = scored.withColumn("score", F.round("score", DIGITS))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), key))
    return scored.filter(F.col("score") >= least).select(query, key, "score", rank.alias("rank")).filter(F.col("rank") <= k)


def boost(component: Column, entity: Column, category: Column, metric: Column) -> Column:
    """Sum of the boosts whose condition holds."""
    return reduce(lambda a, b: a + b, [F.when(c, BOOSTS[n]).otherwise(0.0) for n, c in (("component", component), ("entity", entity), ("category", category), ("metric", metric))])


def context_budget(hits: DataFrame, query: str, size: str, limit: int) -> DataFrame:
    """Hits in rank order while their sizes add up to no more than the limit; the first always stays."""
    used = F.sum(size).over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", used).filter((F.col("rank") == 1) | (F.col("used") <= limit))


def _contains(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def classify(queries: DataFrame, text: str) -> DataFrame:
    """Adds category, components, entities, restricted reason, unsupported flag, time scope and confidence."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    category, parts = F.lit("unsupported"), F.array().cast("array<string>")
    for name, words, comps in reversed(CATEGORIES):
        hit = _contains(low, words)
        category = F.when(hit, name).otherwise(category)
        parts = F.when(hit, F.array(*[F.lit(c) for c in comps])).otherwise(parts)
    reason = F.lit(None).cast("string")
    for pattern, why in reversed(RESTRICTED):
        reason = F.when(low.rlike(pattern), why).otherwise(reason)
    current = F.contains(low, F.lit("real")) & (F.contains(low, F.lit("current")) | F.contains(low, F.lit("live")))
    out = queries.withColumns({"components": parts, "restricted": reason.isNotNull(), "unsupported_current": current, "query_category": F.when(current, "unsupported").otherwise(category),
                               "entities": F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(F.col(text), F.lit(""))), F.lit(ENTITY), F.lit(0)))), "safety_reason": F.when(current, "UNSUPPORTED_REAL_WORLD_STATUS").otherwise(reason),
                               "time_scope": F.when(F.contains(low, F.lit("latest")), "latest_repository_evidence").otherwise("repository_evidence")})
    return out.withColumn("confidence", F.when(F.col("restricted"), 1.0).when(F.col("query_category") == "unsupported", 0.2).otherwise(0.95))


def response_status(classified: DataFrame) -> DataFrame:
    """Adds `status`: REFUSED for what is restricted or asks for live status, INSUFFICIENT_EVIDENCE without chunks or ground,
    else GROUNDED. Needs chunks (count) and grounded (boolean)."""
    return classified.withColumn("status", F.when(F.col("restricted") | F.col("unsupported_current"), "REFUSED").when((F.col("chunks") == 0) | ~F.col("grounded"), "INSUFFICIENT_EVIDENCE").otherwise("GROUNDED"))


def grounding(hits: DataFrame, query: str, max_chunks: int, consistent: str | None = None, least_coverage: float = 0.35, least_confidence: float = 0.45) -> DataFrame:
    """(query, chunks, coverage, confidence, grounded) from ranked hits."""
    g = hits.groupBy(query).agg(F.count("*").alias("chunks"), F.avg("score").alias("_s"), *([F.min(F.col(consistent).cast("int")).alias("_c")] if consistent else []))
    same = F.when(F.col("_c") == 0, 0.75).otherwise(1.0) if consistent else F.lit(1.0)
    cover = F.least(F.lit(1.0), F.col("chunks") / float(max_chunks))
    confidence = F.least(F.lit(1.0), (F.least(F.lit(1.0), F.col("_s") / 3) + cover + F.lit(1.0) + same) / 4)
    return g.select(query, "chunks", cover.alias("coverage"), confidence.alias("confidence")).withColumn("grounded", (F.col("coverage") >= least_coverage) & (F.col("confidence") >= least_confidence))


def answer(rows: DataFrame) -> Column:
    """Template text for a classified and grounded query."""
    return (F.when(F.col("status") == "REFUSED", F.format_string("This request can't be served (%s).", F.coalesce("safety_reason", F.lit("RESTRICTED_OPERATIONAL_CONTROL")))).when(F.col("status") == "INSUFFICIENT_EVIDENCE", F.lit("There isn't enough evidence to answer this."))
            .otherwise(F.format_string("%d pieces of evidence on %s support this answer (confidence %.2f).", F.col("chunks"), F.col("query_category"), F.col("confidence"))))


def prompt_hash(hits: DataFrame, query: str, chunk: str) -> DataFrame:
    """(query, prompt_sha256): of the chunks in rank order, one per line."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", chunk))), lambda x: x[chunk])
    return hits.groupBy(query).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("prompt_sha256"))


def citations(hits: DataFrame, query: str, source: str) -> DataFrame:
    """One citation per source and query, at its best rank, numbered by it."""
    best = hits.groupBy(query, source).agg(F.min("rank").alias("rank"))
    return best.withColumn("citation", F.row_number().over(Window.partitionBy(query).orderBy("rank")))


def evaluation(questions: DataFrame, responses: DataFrame, classified: DataFrame, on: str = "query_id") -> DataFrame:
    """Per question: whether category, status, refusal, components and the number of citations are as expected."""
    j = questions.join(responses, on).join(classified.select(on, F.col("query_category").alias("_cat"), F.col("components").alias("_comp")), on)
    return j.select(on, (F.col("expected_category") == F.col("_cat")).alias("category_ok"), (F.col("expected_response_status") == F.col("status")).alias("status_ok"), (F.col("must_refuse") == (F.col("status") == "REFUSED")).alias("refusal_ok"),
                    F.coalesce(F.arrays_overlap("expected_source_components", "_comp"), F.lit(True)).alias("components_ok"), (F.col("citations") >= F.col("minimum_citations")).alias("citations_ok"))


def evaluation_summary(e: DataFrame) -> DataFrame:
    return e.agg(F.count("*").alias("n"), *[share(F.sum(F.col(c).cast("long")), F.count("*")).alias(c.replace("_ok", "_accuracy")) for c in ("category_ok", "status_ok", "refusal_ok", "components_ok", "citations_ok")])


def sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, section, heading, body): HTML cut at its h1..h6 tags, tags removed and white space folded; section 0 has no heading."""
    cut = F.split(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?i)(?=<h[1-6][\s>])")
    out = pages.select(key, F.posexplode(cut).alias("section", "_raw"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    heading = F.regexp_extract("_raw", r"(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>", 1)
    return out.select(key, "section", clean(heading).alias("heading"), clean(F.regexp_replace("_raw", r"(?is)^<h[1-6][^>]*>.*?</h[1-6]>", " ")).alias("body"))


def metrics(e: DataFrame) -> DataFrame:
    """Shares of grounded, refused and insufficient responses."""
    n = lambda s: ratio(F.sum((F.col("status") == s).cast("long")), F.count("*"))
    return e.agg(F.count("*").alias("n"), n("GROUNDED").alias("grounded_rate"), n("REFUSED").alias("refused_rate"), n("INSUFFICIENT_EVIDENCE").alias("insufficient_rate"))
