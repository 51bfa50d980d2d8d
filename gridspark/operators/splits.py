"""Chronological splits: by last timestamps, with purge, and rolling-origin folds.

The distinct timestamps of a grid are a small table (one row per tick), so ranking them needs no partitioning; the boundaries
that come out of it are scalars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ranked(rows: DataFrame, at: str) -> DataFrame:
    """Distinct timestamps, newest first."""
    return rows.select(F.col(at).alias("t")).distinct().withColumn("k", F.dense_rank().over(Window.orderBy(F.col("t").desc())))


def _nth_last(rows: DataFrame, at: str, n: int):
    """The n-th newest timestamp as a scalar."""
    return _ranked(rows, at).filter(F.col("k") == n).select("t").scalar()


def chronological(rows: DataFrame, validation: int, test: int, at: str = "ts") -> DataFrame:
    """Adds `split`: the last `test` distinct timestamps are test, the `validation` before them validation, the rest train."""
    test_start, val_start = _nth_last(rows, at, test), _nth_last(rows, at, test + validation)
    return rows.withColumn("split", F.when(F.col(at) >= test_start, "test").when(F.col(at) >= val_start, "validation").otherwise("train"))


def purged(rows: DataFrame, validation: int, test: int, purge: int, step_minutes: int, at: str = "ts", label_end: str = "label_end") -> DataFrame:
    """Like chronological, but train ends `purge` steps before validation, and train and validation labels end by the start of
    what follows them; rows in between are left out."""
    test_start, val_start = _nth_last(rows, at, test), _nth_last(rows, at, test + validation)
    gap = F.expr(f"interval {purge * step_minutes} minutes")
    split = F.when(F.col(at) >= test_start, "test").when((F.col(at) >= val_start) & (F.col(label_end) <= test_start), "validation").when((F.col(at) < val_start - gap) & (F.col(label_end) <= val_start), "train")
    return rows.withColumn("split", split).filter(F.col("split").isNotNull())


def rolling_origins(rows: DataFrame, folds: int, origin: str = "ts", target: str = "forecast_ts") -> DataFrame:
    """A row per fold it belongs to: `fold` (1 is the oldest), `cutoff`, and `part`: train if its target time is no later than
    the cutoff, evaluate if its origin is the cutoff."""
    cut = _ranked(rows, origin).filter(F.col("k") <= folds).select(F.col("t").alias("cutoff"), (F.lit(folds + 1) - F.col("k")).alias("fold"))
    # A handful of rows, one per fold.
    each = rows.join(F.broadcast(cut), F.col(target) <= F.col("cutoff")).withColumn("part", F.lit("train"))
    return each.unionByName(rows.join(F.broadcast(cut), F.col(origin) == F.col("cutoff")).withColumn("part", F.lit("evaluate")))
