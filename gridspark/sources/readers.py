"""Scans of source files: CSV and JSON lines as raw text columns with their row numbers, by contract; Parquet with guards.

Readers keep everything: a malformed line becomes a row with `_issue`. Typing and rules are validation's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .contracts import fields
from .shared import written


class HeaderError(ValueError):
    pass


#: Where a row stands: its file, the split of the file that it was read with, its number among all rows of the scan, and whether it is
#: only there to be counted.
PLACE = ("_file", "_block", "_id", "_blank")


def _place(blank: Column) -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), blank.alias("_blank")]


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """Rows with PLACE, as a table that was written, with `_row` in its stead: the number in the file, as a sequential read would count.

    A task reads the rows of a split in order and one after the other, so a row's number in its split is a difference of ids. The splits
    of a file, a row each, are counted and summed up; no row is sorted. Written rows are needed because a second scan of the
    source could be split in another way.
    """
    splits = rows.groupBy("_file", "_block").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("_file", "_block", "_least", (F.coalesce(before, F.lit(0)) + first).alias("_offset"))
    at = (F.col("_id") - F.col("_least") + F.col("_offset")).alias("_row")
    kept = [c for c in rows.columns if c not in PLACE]
    return rows.join(offsets, ["_file", "_block"]).filter(~F.col("_blank")).select(*kept, at, "_file")


def raw_csv(spark: SparkSession, path: str, contract: dict) -> DataFrame:
    """Text columns in contract order with PLACE and _issue, for `numbered` from 2.

    The header has to list the contract's fields in order (HeaderError otherwise). Short and long lines are INCONSISTENT_CSV_ROW. A record
    is a line: quotes that run over several lines are refused as such rows. Blank lines aren't counted.
    """
    names = fields(contract)
    head = spark.read.option("header", True).csv(path).columns
    if head != names:
        raise HeaderError(f"expected {names}, found {head}")
    shape = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_corrupt", T.StringType())])
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "multiLine": False, "enforceSchema": True}
    rows = spark.read.schema(shape).options(**options).csv(path)
    return rows.select(*names, *_place(F.lit(False)), F.when(F.col("_corrupt").isNotNull(), "INCONSISTENT_CSV_ROW").alias("_issue"))


def raw_jsonl(spark: SparkSession, path: str, contract: dict) -> DataFrame:
    """Text columns with PLACE, _issue and _keys (the object's field names), for `numbered` from 1. Lines that are no JSON object are
    MALFORMED_RECORD; blank ones count as lines, and go with the numbering. One field of a wrong type doesn't spoil the others, as each is
    read by itself."""
    lines = spark.read.text(path).select("value", *_place(F.trim("value") == ""))
    v = lines.withColumn("_v", F.try_parse_json("value"))
    whole = v.withColumn("_ok", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    get = lambda n: F.when(F.col("_ok"), F.try_variant_get("_v", f"$['{n}']", "string"))
    return whole.select(*[get(n).alias(n) for n in fields(contract)], *PLACE, F.when(~F.col("_ok"), "MALFORMED_RECORD").alias("_issue"), F.when(F.col("_ok"), F.json_object_keys("value")).alias("_keys"))


#: Format to its reader and the number of a file's first row.
READERS = {"csv": (raw_csv, 2), "jsonl": (raw_jsonl, 1)}


def raw(spark: SparkSession, path: str, contract: dict) -> DataFrame:
    """A source as its format's reader gives it, still to be numbered."""
    try:
        reader, _ = READERS[contract["format"]]
    except KeyError:
        raise ValueError(f"format {contract['format']} is unknown") from None
    return reader(spark, path, contract)


def read(spark: SparkSession, path: str, contract: dict) -> DataFrame:
    """A source with _row, its number in the file: from 2 after a CSV header, from 1 in JSON lines. Writes the rows once."""
    return numbered(written(raw(spark, path, contract)), READERS[contract["format"]][1])


def read_interim(spark: SparkSession, path: str, version: str, kind: str = "parquet") -> DataFrame:
    """Rows of a validated dataset; raises ValueError unless all carry the schema version."""
    rows = spark.read.format(kind).load(path)
    if not rows.filter(F.coalesce(F.col("schema_version") != version, F.lit(True))).isEmpty():
        raise ValueError(f"rows of another version than {version}")
    return rows


def until(rows: DataFrame, times: list[str], at: str | Column) -> DataFrame:
    """Rows whose first non-null time is no later than `at`; with one time column the filter reaches the scan."""
    when = F.col(times[0]) if len(times) == 1 else F.coalesce(*times)
    return rows.filter(when <= (F.lit(at).cast("timestamp") if isinstance(at, str) else at))


def period(rows: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """start <= time < end; a plain comparison, which is pushed to the scan."""
    kind = dict(rows.dtypes)[time]
    return rows.filter((F.col(time) >= F.lit(start).cast(kind)) & (F.col(time) < F.lit(end).cast(kind)))
