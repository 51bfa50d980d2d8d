"""Places and running sums in a total order, without a window over everything in one task.

Rows are sorted by ranges (Spark's own sampled range partitioning) and written once; a range's row count or total is one row, so the
offsets of the ranges are small, and what is left is local to a range. Nothing gathers a group in a task, however large the group is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: monotonically_increasing_id holds the partition above these bits, and the row in it below.
ROW_BITS = 33
AT = "_ranged_at"


def ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows sorted and written, with its place: the range and the row in it. Break ties in `order`, or equal rows gather in one range."""
    return written(df.orderBy(*order).withColumn(AT, F.monotonically_increasing_id()))


def _range() -> Column:
    return F.shiftright(AT, ROW_BITS)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """The rows with their place in the order, from 1."""
    rows = ranged(df, order)
    counts = sorted((r.k, r.n) for r in rows.groupBy(_range().alias("k")).agg(F.count("*").alias("n")).collect())  # a row per range
    before = [0, *accumulate(n for _, n in counts)]
    offsets = df.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(counts, before)] or [(0, 0)], "_k long, _before long")
    place = F.col("_before") + F.col(AT).bitwiseAND((1 << ROW_BITS) - 1) + 1
    return rows.join(F.broadcast(offsets), _range() == F.col("_k")).withColumn(name, place).drop(AT, "_k", "_before")


def running(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, str], maxes: dict[str, str] | None = None, totals: dict[str, str] | None = None
) -> DataFrame:
    """The rows with running sums and maxima per group in the order, the row itself included, and sums over the whole group, each as
    {new column: its column}. Nulls count as 0 in sums.

    A group may span any number of ranges: each (range, group) has one row of sums; those of a group in earlier ranges are added to what is
    local to a range. These rows are windowed per group, with at most a row per range there.
    """
    maxes, totals = maxes or {}, totals or {}
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    rows = ranged(df, [*by, *order]).withColumn("_k", _range())
    parts = rows.groupBy("_k", *by).agg(
        *(total(c).alias(f"_s_{n}") for n, c in sums.items()), *(F.max(c).alias(f"_m_{n}") for n, c in maxes.items()), *(total(c).alias(f"_t_{n}") for n, c in totals.items()))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("_k").alias("_ok"), *(F.col(b).alias(f"_ob_{i}") for i, b in enumerate(by)), *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums),
        *(F.max(f"_m_{n}").over(earlier).alias(f"_before_{n}") for n in maxes), *(F.sum(f"_t_{n}").over(whole).alias(f"_all_{n}") for n in totals))
    local = Window.partitionBy("_k", *by).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.select("*", *(total(c).over(local).alias(f"_here_{n}") for n, c in sums.items()), *(F.max(c).over(local).alias(f"_here_{n}") for n, c in maxes.items()))
    on = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_ob_{i}")) for i, b in enumerate(by)], F.col("_k") == F.col("_ok"))
    # A key of this join is a group in a range, so the hottest one has a range's rows.
    return kept.join(offsets, on).select(
        *(F.col(c) for c in df.columns), *((F.col(f"_here_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums),
        *(F.greatest(f"_here_{n}", f"_before_{n}").alias(n) for n in maxes), *(F.col(f"_all_{n}").alias(n) for n in totals))


def value_ranks(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, n, upto, total): how many rows have each value that isn't null, how many it or a smaller one, and how many any."""
    each = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running(each, by, [value], {"upto": "n"}, totals={"total": "n"})


def at_places(ranks: DataFrame, by: Sequence[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by, names): of each group's sorted values those at the given places, from 0; a place is an expression of `total`."""
    held = lambda at: (F.col("upto") - F.col("n") <= at) & (at < F.col("upto"))
    return ranks.groupBy(*by).agg(*(F.max(F.when(held(at), F.col(value))).alias(name) for name, at in places.items()))


def median(ranks: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(by, name): exact medians, means of the two values in the middle, from value_ranks."""
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    both = at_places(ranks, by, value, {"_low": low, "_high": high})
    return both.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias(name))
