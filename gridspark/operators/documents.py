"""Documents of several formats as sections of text: nested objects flattened to `path=value` lines, Markdown cut at its headings.

Flattening walks VARIANT values level by level within a document's row: each round puts the fields of the objects that are left in their
place, and what isn't an object is a line. There are as many rounds as the deepest document has levels; nothing is shuffled or written.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import files
from ..sources.shared import written

#: Elements of a list that a line shows, and records of a CSV or JSON-lines file that become sections.
LIST_ITEMS, RECORDS = 20, 50
#: Fields that say which run, entity and time a document is about.
RUN_FIELDS = ("run_id", "forecast_run_id", "asset_health_run_id", "outage_prediction_run_id", "reliability_run_id", "monitoring_run_id")
ENTITY_FIELDS = ("entity_id", "asset_id", "feeder_id")
METADATA = ("run_id", "assessment_start", "assessment_end", "entity_type", "entity_id")
#: Names that are metrics without an underscore, and how reason codes look.
METRIC_WORDS = ("saifi", "saidi", "caidi", "asai", "wape", "mae", "bias")
REASON = r"\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b"


def _fields(v: Column) -> Column:
    """An object's values by name; null for what is none."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _text(v: Column) -> Column:
    """A leaf as a line shows it: null, True and False in words, lists as JSON of their first items, numbers and texts as they are."""
    items, plain = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "string")
    said = F.when(plain.isin("true", "false") & (F.schema_of_variant(v) == "BOOLEAN"), F.initcap(plain)).otherwise(plain)
    return F.when(v.isNull() | F.is_variant_null(v), "null").otherwise(F.coalesce(F.to_json(F.slice(items, 1, LIST_ITEMS)), said))


def _entry(path: Column, v: Column) -> Column:
    return F.struct(path.alias("path"), v.alias("v"))


def _entries(docs: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, _e): per document, an array of the paths and values of everything that isn't an object."""
    rows = docs.select(*keys, F.try_parse_json(payload).alias("_v")).filter("_v IS NOT NULL")
    below = lambda path, v: F.transform(F.map_entries(_fields(v)), lambda f: _entry(F.array_append(path, f.key), f.value))
    alone = F.array(_entry(F.array(F.lit("value")), F.col("_v")))
    rows = rows.select(*keys, F.coalesce(below(F.array().cast("array<string>"), F.col("_v")), alone).alias("_e"))
    while not rows.filter(F.exists("_e", lambda x: _fields(x.v).isNotNull())).isEmpty():
        rows = rows.select(*keys, F.flatten(F.transform("_e", lambda x: F.coalesce(below(x.path, x.v), F.array(_entry(x.path, x.v))))).alias("_e"))
    return rows


def _told(x: Column) -> Column:
    return F.struct(x.path.alias("path"), _text(x.v).alias("value"))


def leaves(docs: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, path, value): everything in a JSON text that isn't an object; path is an array of field names.

    A text that is no JSON has no lines, one that is no object stands under the name `value`, and empty objects have no lines.
    """
    return _entries(docs, keys, payload).select(*keys, F.explode(F.transform("_e", _told)).alias("_x")).select(*keys, "_x.*")


def flattened(docs: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, line_no, line): `path=value` lines of each document, ordered by path, name by name; from 1."""
    lines = _entries(docs, keys, payload).select(*keys, F.posexplode(F.array_sort(F.transform("_e", _told))).alias("_at", "_x"))
    return lines.select(*keys, (F.col("_at") + 1).alias("line_no"), F.concat(F.array_join("_x.path", "."), F.lit("="), "_x.value").alias("line"))


def as_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): the lines of each document, one below the other."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line)
    return lines.groupBy(*keys).agg(F.array_join(ordered, "\n").alias("content"))


def markdown_sections(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, section, title, content): a text cut before each line that begins with #; what stands before the first is `Document`."""
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n")
    out = docs.select(*keys, F.posexplode(F.split(whole, r"\n(?=#)")).alias("section", "content")).filter("content <> ''")
    heading = F.btrim(F.substring_index("content", "\n", 1), F.lit("# "))
    title = F.when(~F.col("content").startswith("#"), "Document").when(heading == "", "Section").otherwise(heading)
    return out.select(*keys, "section", title.alias("title"), "content")


def normalised(content: Column) -> Column:
    """Without blank lines and blanks at line ends."""
    lines = F.transform(F.split(F.regexp_replace(content, r"\r\n?", "\n"), "\n"), lambda x: F.rtrim(x))
    return F.trim(F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), "\n"))


def metric_names(content: Column) -> Column:
    """Sorted names that look like metrics: lower-case words with an underscore, and METRIC_WORDS."""
    names = F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit(r"\b[a-z][a-z0-9_]*\b"), F.lit(0)))
    return F.array_sort(F.filter(names, lambda x: F.contains(x, F.lit("_")) | x.isin(*METRIC_WORDS)))


def reason_codes(content: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(REASON), F.lit(0))))


def metadata(payload: str) -> dict[str, Column]:
    """METADATA of a JSON text's own fields; the last field of several for one thing that is given."""
    v = F.try_parse_json(payload)
    at = lambda f: F.nullif(F.try_variant_get(v, f"$.{f}", "string"), F.lit(""))
    of = {"run_id": RUN_FIELDS, "entity_id": ENTITY_FIELDS}
    return {m: F.coalesce(*map(at, of.get(m, (m,)))) for m in METADATA}


def _yaml_as_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        import json

        import yaml

        def one(t: str) -> str | None:
            try:
                return json.dumps(yaml.safe_load(t) or {}, default=str)
            except yaml.YAMLError:
                return None

        return texts.map(one)

    return convert(text)


def _first_lines(spark: SparkSession, root: str, ext: str, most: int) -> DataFrame:
    """(source_path, n, line): the first lines that aren't blank of each file, from 1; of a file's first split, so no file is held whole."""
    rows = spark.read.option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", "true").text(root)
    rows = rows.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.rtrim("value", F.lit("\r")).alias("line"))
    place = F.row_number().over(Window.partitionBy("source_path").orderBy("i"))
    return rows.filter((F.col("b") == 0) & (F.trim("line") != "")).select("source_path", place.alias("n"), "line").filter(F.col("n") <= most)


def extract(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, section, title, content, METADATA, malformed) of the .md, .json, .yaml, .yml, .csv and .jsonl files below a folder.

    Markdown gives a section for each heading; JSON and YAML one for the file; CSV and JSON lines one for each of the first RECORDS
    records, and a CSV without any a section that says so. Files that can't be read are one malformed row. Other files are left out. Sections
    without text are left out, too.
    """
    none = [F.lit(None).cast("string").alias(m) for m in METADATA]
    found = files.listed(spark, root, "*", deep=True)
    kinds = set() if found is None else {r.e for r in found.select(F.lower(F.element_at(F.split("name", r"\."), -1)).alias("e")).distinct().collect()}
    whole = lambda ext: spark.read.option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    shape = "source_path string, section int, title string, content string, " + ", ".join(f"{m} string" for m in METADATA) + ", malformed boolean"
    out = [spark.createDataFrame([], shape)]
    if "md" in kinds:
        out.append(markdown_sections(whole("md"), ["source_path"], "text").select("source_path", "section", "title", "content", *none, F.lit(False).alias("malformed")))
    payloads = []
    for ext in ("json", "yaml", "yml"):
        if ext in kinds:
            made = F.col("text") if ext == "json" else _yaml_as_json(F.col("text"))
            payloads.append(whole(ext).select("source_path", F.lit(0).alias("section"), F.lit("JSON summary").alias("title"), made.alias("payload")))
    if "jsonl" in kinds:
        records = _first_lines(spark, root, "jsonl", RECORDS).select("source_path", (F.col("n") - 1).alias("section"), F.col("line").alias("payload"))
        payloads.append(records.select("source_path", "section", F.format_string("JSONL record %d", F.col("section") + 1).alias("title"), "payload"))
    if payloads:
        docs = written(reduce(DataFrame.unionByName, payloads))
        keys = ["source_path", "section", "title"]
        text = as_text(flattened(docs, keys, "payload"), keys)
        told = docs.join(text, keys, "left").withColumns(metadata("payload"))
        broken = F.try_parse_json("payload").isNull()
        out.append(told.select(*keys, F.coalesce("content", F.lit("")).alias("content"), *METADATA, broken.alias("malformed")))
    if "csv" in kinds:
        lines = _first_lines(spark, root, "csv", RECORDS + 1)
        heads = lines.filter("n = 1").select("source_path", F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("head"))
        each = lines.filter("n > 1").join(heads, "source_path").withColumn("section", F.col("n") - 2)
        cells = F.split("line", ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", -1)
        value = lambda x: F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')
        pairs = F.zip_with("head", F.transform(cells, value), lambda k, v: F.struct(k.alias("k"), F.when(F.coalesce(v, F.lit("")) == "", "null").otherwise(v).alias("v")))
        each = each.withColumns({"pairs": pairs, "payload": F.to_json(F.map_from_entries(F.filter(pairs, lambda p: p.v != "null")))})
        told = each.withColumns(metadata("payload")).select("source_path", "section", F.format_string("CSV row %d", F.col("section") + 1).alias("title"), F.array_join(F.transform("pairs", lambda p: F.concat(p.k, F.lit("="), p.v)), "; ").alias("content"), *METADATA, F.lit(False).alias("malformed"))
        empty = whole("csv").select("source_path").join(lines.filter("n > 1").select("source_path"), "source_path", "left_anti").select("source_path", F.lit(0).alias("section"), F.lit("CSV empty").alias("title"), F.lit("No rows available.").alias("content"), *none, F.lit(False).alias("malformed"))
        out += [told, empty]
    return reduce(DataFrame.unionByName, out).withColumn("content", normalised(F.col("content"))).filter("content <> '' OR malformed")
