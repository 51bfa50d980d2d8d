"""Source discovery and manifest verification. The manifest is one small JSON file; files are hashed by Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


class ManifestError(ValueError):
    """Its `code` says what is wrong."""

    def __init__(self, code: str, what: str = ""):
        super().__init__(f"{code}: {what}")
        self.code = code


def _once(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ManifestError("MANIFEST_DUPLICATE_ENTRY")
    return out


def load(spark: SparkSession, path: str) -> dict:
    """The manifest {files: [{dataset, name, size, sha256, records}]}; records may be absent."""
    text = files.read_text(spark, path)
    if text is None:
        raise ManifestError("MANIFEST_MISSING", path)
    try:
        got = json.loads(text, object_pairs_hook=_once)
    except json.JSONDecodeError as e:
        raise ManifestError("MANIFEST_MALFORMED", str(e)) from None
    if not isinstance(got, dict) or not isinstance(got.get("files"), list):
        raise ManifestError("MANIFEST_MALFORMED", "no files")
    for f in got["files"]:
        if not isinstance(f, dict) or (absent := [k for k in ("dataset", "name", "size", "sha256") if not isinstance(f.get(k), int if k == "size" else str)]):
            raise ManifestError("MANIFEST_MALFORMED", f"an entry without {absent}" if isinstance(f, dict) else "an entry that is no object")
    return got


def entries(manifest: dict, expected: list[str]) -> list[tuple[str, str]]:
    """(dataset or name, code) for entries of a dataset or name that is given twice, of a dataset that isn't expected, and for
    expected datasets without an entry."""
    found = []
    for part in ("dataset", "name"):
        values = [f[part] for f in manifest["files"]]
        found += [(v, "MANIFEST_DUPLICATE_ENTRY") for v in sorted(set(values)) if values.count(v) > 1]
    given = {f["dataset"] for f in manifest["files"]}
    return found + [(d, "MANIFEST_DATASET_UNEXPECTED") for d in sorted(given - set(expected))] + [(d, "MANIFEST_DATASET_MISSING") for d in sorted(set(expected) - given)]


def verify(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """(name, code) for files that are missing, unexpected, or of another size or checksum."""
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("got_size"), F.sha2("content", 256).alias("got_sha"))
    want = spark.createDataFrame([(f["name"], f["size"], f["sha256"]) for f in manifest["files"]], "name string, size long, sha string")
    both = want.join(found.filter(F.col("name") != "manifest.json"), "name", "full_outer")
    code = F.when(F.col("got_size").isNull(), "FILE_MISSING").when(F.col("size").isNull(), "FILE_UNEXPECTED").when(F.col("size") != F.col("got_size"), "MANIFEST_SIZE_MISMATCH").when(F.col("sha") != F.col("got_sha"), "MANIFEST_CHECKSUM_MISMATCH")
    return both.select("name", code.alias("code")).filter("code is not null")


def discover(spark: SparkSession, folder: str, contracts: dict[str, dict], formats: tuple[str, ...] = ("csv", "jsonl")) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Paths of the datasets that a folder holds by contract name, and (name, code) of what doesn't belong there or can't be read.

    On this machine symbolic links are refused, as they may leave the folder; other file systems have none. One row a file.
    """
    root = files.local(folder)
    links = {p.name for p in root.iterdir() if p.is_symlink()} if root is not None and root.is_dir() else set()
    names = files.listed(spark, folder)
    names = {r.name for r in names.select("name").collect()} if names is not None else set()
    expected = {f"{n}.{c['format']}": n for n, c in contracts.items() if c["format"] in formats}
    wrong = [(n, "UNSUPPORTED_FORMAT") for n, c in contracts.items() if c["format"] not in formats]
    wrong += [(n, "FILE_UNEXPECTED") for n in sorted(links | names) if n in links or n not in expected and n != "manifest.json"]
    return {expected[n]: f"{folder.rstrip('/')}/{n}" for n in sorted(names - links) if n in expected}, wrong


def latest_run(spark: SparkSession, root: str, name: str = "*.json") -> str | None:
    """The lexically last folder below a root that holds a file of such a name."""
    found = files.listed(spark, root, name, deep=True)
    last = None if found is None else found.agg(F.max(F.struct("folder", "path")).alias("m")).first().m
    return last and last.path.rpartition("/")[0]
