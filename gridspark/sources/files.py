"""Small texts (settings, manifests, run files) and listings, on any file system that Spark reads."""

from __future__ import annotations

import hashlib
import os
import pathlib
from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local(path: str) -> pathlib.Path | None:
    """The path on this machine, None for one of another file system."""
    parts = urlsplit(path)
    if len(parts.scheme) <= 1:  # none, or a drive
        return pathlib.Path(path)
    return pathlib.Path(unquote(parts.path)) if parts.scheme == "file" else None


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or what `write_text` left; None where there is nothing."""
    if (at := local(path)) is not None:
        return at.read_text(encoding="utf-8") if at.is_file() else None
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows[0][0] if rows else None


def write_text(text: str, path: str) -> str:
    """Writes a small text and returns its SHA-256: by rename on this machine, elsewhere as a folder with one part, by Spark's committer."""
    if (at := local(path)) is None:
        SparkSession.active().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        at.parent.mkdir(parents=True, exist_ok=True)
        part = at.with_name(at.name + ".part")
        part.write_text(text, encoding="utf-8")
        os.replace(part, at)
    return hashlib.sha256(text.encode()).hexdigest()


def listed(spark: SparkSession, folder: str, pattern: str = "*", deep: bool = False) -> DataFrame | None:
    """(path, name, folder, length, modified) of files, without their contents; None where there is no such folder."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(deep).lower()).load(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    parts = F.split("path", "/")
    return found.select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"), "length", F.col("modificationTime").alias("modified"))
