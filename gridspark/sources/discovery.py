"""What runs have left: unlike JSON documents, from any number of folders, as one table of runs.

Every document is read as a VARIANT and each column looks for its value at several places, in order. A run may have left several
documents (its figures and its manifest); they are one row. Files that are no JSON object are rows too, as failed runs; so are roots
that hold nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import star
from . import files

#: Components, and the field that holds a run's id in their documents.
RUN_ID = {"data_generation": "generation_run_id", "ingestion": "ingestion_run_id", "forecasting": "forecast_run_id", "asset_health": "asset_health_run_id",
          "outage_prediction": "outage_prediction_run_id", "reliability": "reliability_run_id", "monitoring": "monitoring_run_id", "genai": "assistant_run_id"}
#: Where a value may stand in a document, first come first served.
PLACES = {
    "component_name": ("component_name", "component"),
    "source_run_id": ("run_id", *RUN_ID.values()),
    "run_status": ("run_status", "status", "pipeline_status"),
    "run_timestamp": ("generated_at", "finished_at", "assessment_timestamp", "monitoring_timestamp"),
    "assessment_start": ("assessment_start",),
    "assessment_end": ("assessment_end",),
    "input_records": ("totals.source_records_discovered", "counts.ALL.discovered", "input_records"),
    "output_records": ("totals.valid_records", "counts.ALL.valid", "assets_scored", "entities_assessed", "forecast_row_count", "row_counts.prediction_rows", "output_records"),
    "invalid_records": ("totals.invalid_records", "counts.ALL.invalid", "invalid_records"),
    "warning_records": ("totals.warning_records", "counts.ALL.with_warnings", "warning_count"),
    "schema_version": ("schema_version",),
}
NUMBERS = ("input_records", "output_records", "invalid_records", "warning_records")
TIMES = ("run_timestamp", "assessment_start", "assessment_end")
COLUMNS = (*PLACES, "malformed", "documents", "doc")


def at(doc: str | Column, place: str, kind: str = "string") -> Column:
    """What stands at a place of a document, null where it doesn't or isn't of the kind."""
    return F.try_variant_get(doc, "$" + "".join(f"['{p}']" for p in place.split(".")), kind)


def documents(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, path, text) of every JSON file below the roots; a root without any has one row with null path and text."""
    out = []
    for root in roots:  # a few folders
        found = files.listed(spark, root, "*.json", deep=True)
        texts = None if found is None else spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(root, wholetext=True)
        none = spark.createDataFrame([(root, None, None)], "root string, path string, text string")
        if texts is None:
            out.append(none)
            continue
        rows = texts.select(F.lit(root).alias("root"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        out.append(rows.unionByName(none.join(rows.select("root").distinct(), "root", "left_anti")))
    return reduce(DataFrame.unionByName, out, spark.createDataFrame([], "root string, path string, text string"))


def component_runs(docs: DataFrame, known: list[str] | None = None) -> DataFrame:
    """COLUMNS and `copies`, `newest`: one row for each run of `documents`, and for each root without any, malformed ones included.

    A document that names no component is of the one whose id field it has, else of the folder above its own, else of its root's name; one
    that names no run is of its folder. A run whose documents name different files is one row; its values come from the first path that
    has them. `copies` counts the places (folders) that claim one run id, `newest` marks the latest run of a component.
    """
    known = known or list(RUN_ID)
    v = docs.withColumns({"doc": F.try_parse_json("text")}).withColumn("whole", F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False)))
    v = v.withColumn("doc", F.when(F.col("whole"), F.col("doc")))
    found = {c: F.coalesce(*(at("doc", p) for p in places)) for c, places in PLACES.items()}
    parts = F.split(F.coalesce("path", "root"), "/")
    inferred = F.coalesce(*(F.when(at("doc", f).isNotNull(), c) for c, f in RUN_ID.items()))
    names = F.array(*map(F.lit, known))
    by_folder = F.element_at(F.filter(parts, lambda x: F.array_contains(names, x)), -1)  # null without any
    by_folder = F.when(F.exists(parts, lambda x: F.array_contains(names, x)), by_folder)
    root_name = F.element_at(F.split(F.rtrim(F.col("root"), F.lit("/")), "/"), -1)
    folder = F.try_element_at(parts, F.lit(-2))
    named = v.withColumns(found).withColumns({
        "component_name": F.coalesce("component_name", inferred, by_folder, root_name),
        "source_run_id": F.coalesce("source_run_id", F.when(F.col("path").isNull(), "not-available").otherwise(folder)),
        "place": F.when(F.col("path").isNull(), F.col("root")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")),
        "malformed": F.col("path").isNotNull() & ~F.col("whole"),
        "doc": F.to_json("doc")})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("path"))).alias(c)
    taken = [c for c in PLACES if c not in ("component_name", "source_run_id")]
    each = named.groupBy("component_name", "source_run_id").agg(
        *map(first, taken), F.bool_or("malformed").alias("malformed"), F.count("path").alias("documents"), F.count_distinct("place").alias("copies"), first("doc"), F.array_sort(F.collect_list("doc")).alias("docs"))
    status = (F.when(F.col("malformed"), "FAILED_MALFORMED_JSON").when(F.col("documents") == 0, "NOT_AVAILABLE").otherwise(F.coalesce("run_status", F.lit("PASSED"))))
    each = each.withColumns({"run_status": status} | {c: F.col(c).try_cast("long") for c in NUMBERS})
    # A component has as many rows here as it has had runs.
    order = Window.partitionBy("component_name").orderBy(F.col("run_timestamp").desc_nulls_last(), F.col("source_run_id").desc())
    return each.select(*COLUMNS, "docs", "copies", (F.row_number().over(order) == 1).alias("newest"))


def as_source(runs: DataFrame) -> DataFrame:
    """The columns that the star schema's run dimension takes; roots without a run are left out."""
    return runs.filter("documents > 0").select(*star.SOURCES["runs"])
