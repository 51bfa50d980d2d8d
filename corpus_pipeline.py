"""A corpus pipeline over the documents table: each stage takes what its predecessor kept, whole, and decides on it.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents; the last returns the columns of the encoding.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import bpe, decontamination, jaccard, language, substrings
from gridspark.llm.common import forget, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected where it has no letters, or where its profile is like no language: n characters tell a cosine to within
#: about 1 / sqrt(n), and even the upper end of that is under LEAST_SCORE.
LEAST_SCORE = 0.15


def named(docs: DataFrame) -> DataFrame:
    """docs with `unnamed`; rows without an id get one from their text that is larger than any below 2^62."""
    stand_in = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    return docs.select(*COLUMNS).withColumn("unnamed", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", stand_in))


def as_named(rows: DataFrame) -> DataFrame:
    """The columns of documents, with the ids that `named` replaced null again."""
    return rows.withColumn("doc_id", F.when(~F.col("unnamed"), F.col("doc_id"))).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (so null and empty texts), and those of which even score + 1 / sqrt(characters) is under
    LEAST_SCORE. Repeated rows and rows without an id are judged like any other; the latter are trained on. With no labelled
    document there is no language to be like, and all are rejected."""
    prototypes = language.train(docs.filter(~language.held_out()))
    most = F.col("score") + 1 / F.sqrt(F.length("text"))
    return language.predict(docs.select(*COLUMNS), prototypes).filter((F.col("lang_pred") != "und") & (most >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked documents: that with the smallest id, and where rows of the group share it, that with
    the smallest checksum of the text. A row is known by its id and text; of rows with equal ids and texts any one stays.
    Rows without an id come after all others."""
    rows = named(docs).withColumn("md5", F.md5("text"))
    judged = written(jaccard.join(rows, carry=("md5",), group=True).filter(F.col("group").isNotNull()))
    first = judged.filter(F.col("doc_id") == F.col("component_id"))
    several = first.groupBy("group").agg(F.min("md5").alias("least"), F.max("md5").alias("most"), F.count("*").alias("k")).filter("k > 1")
    later = first.join(several.filter("least < most"), "group").filter(F.col("md5") > F.col("least"))
    gone = judged.filter(F.col("doc_id") != F.col("component_id")).select("doc_id", "md5").unionByName(later.select("doc_id", "md5")).distinct()
    kept = rows.join(gone, ["doc_id", "md5"], "left_anti")
    again = several.join(first, "group").filter(F.col("md5") == F.col("least")).groupBy("doc_id", "md5").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id", "md5")
    if not again.isEmpty():
        kept = kept.join(again, ["doc_id", "md5"], "left_anti").unionByName(kept.join(again, ["doc_id", "md5"], "left_semi").dropDuplicates(["doc_id", "md5"]))
    return as_named(kept)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that stand in an earlier document; documents of which nothing is left go. n_chars follows the text."""
    kept = substrings.dedup(named(docs), keep_text=True, carry=("lang", "source", "unnamed"))
    return as_named(kept.filter(F.length("kept") > 0).select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"), "unnamed"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item; each row is judged by its own text, with or without an id. An empty benchmark
    drops none."""
    return as_named(decontamination.clean(named(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, lang, source) of what is left, one row for each row; a null text is empty."""
    return bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"), carry=("lang", "source"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("BPE encoding", encode),
]

#: Training a classifier, prefix doubling on hashes and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is written to the shared folder, read again, and deleted when its successor is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
