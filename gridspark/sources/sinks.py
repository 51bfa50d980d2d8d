"""Sinks. Spark's committers make directory writes atomic; small reports are one file each, replaced atomically."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import write_text


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per line, fields in the order of their names."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str], order: list[str], single: bool = False) -> None:
    """Fixed columns in a total order; range-partitioned parts unless a single file is asked for (small results only)."""
    ordered = rows.select(*columns).orderBy(*order)
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_parquet(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    rows.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_quarantine(rows: DataFrame, path: str, run_id: str, dataset: str) -> None:
    """Rejected rows whole, with their issues, by run and dataset."""
    raw = [c for c in rows.columns if c != "issues"]
    out = rows.select(F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset_name"), F.to_json(F.struct(*raw)).alias("record"), "issues")
    out.write.mode("append").partitionBy("run_id", "dataset_name").json(path)


def write_manifest(content: dict, path: str) -> str:
    return write_text(json.dumps(content, sort_keys=True, indent=2, default=str) + "\n", path)


def markdown(title: str, tables: dict[str, DataFrame], limit: int = 50) -> str:
    """A report over small aggregates: at most `limit` rows of each table (a report's cut, said where it is made)."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(limit + 1).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:limit]]
        out += [f"(first {limit} rows)"] * (len(rows) > limit) + [""]
    return "\n".join(out)
