"""Forecast and outage models: baselines as expressions, and two linear models fitted from aggregates.

A fitted model is plain numbers; predicting is a column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

Model = Callable[[DataFrame], DataFrame]


def _at_least_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def persistence(rows: DataFrame) -> DataFrame:
    return rows.withColumn("predicted", _at_least_zero(F.col("lag_1")))


def moving_average(window: int) -> Model:
    return lambda rows: rows.withColumn("predicted", _at_least_zero(F.col(f"rolling_mean_{window}")))


def seasonal_naive(season: int = 24) -> Model:
    return lambda rows: rows.withColumn("predicted", _at_least_zero(F.col(f"lag_{season}")))


class Linear(NamedTuple):
    """intercept + sum of coefficient * feature; missing features count as 0."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        return reduce(lambda a, fc: a + F.coalesce(F.col(fc[0]).cast("double"), F.lit(0.0)) * fc[1], zip(self.features, self.coefficients), F.lit(self.intercept))

    def forecast(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("predicted", _at_least_zero(self.column()))

    def probability(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-self.column())))


def fit_ridge(rows: DataFrame, features: list[str], target: str = "actual", alpha: float = 0.01) -> Linear:
    """Solves the normal equations with penalty alpha on all but the intercept; one aggregate gives the Gram matrix, whose size
    is that of the feature list."""
    x = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]
    y = F.col(target).cast("double")
    k = len(x)
    sums = [F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)] + [F.sum(c * y) for c in x]
    got = [v or 0.0 for v in rows.filter(F.col(target).isNotNull()).agg(*[s.alias(f"_{i}") for i, s in enumerate(sums)]).collect()[0]]
    gram, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = got[at]
            at += 1
    penalty = alpha * np.eye(k)
    penalty[0, 0] = 0
    try:
        beta = np.linalg.solve(gram + penalty, np.array(got[at:]))
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(gram + penalty, np.array(got[at:]), rcond=None)[0]
    return Linear(tuple(features), tuple(map(float, beta[1:])), float(beta[0]))


#: Distinct (features, label) rows that the driver may hold while a model is fitted, and those of a block where there are more.
HELD_ROWS, BLOCK_ROWS = 10_000, 4096


def _blocks(table: DataFrame, mean: np.ndarray, deviation: np.ndarray, weight: float) -> DataFrame:
    """(n, z, y, times) of BLOCK_ROWS rows at most, as bytes of doubles: standardised features, labels, and what a row weighs."""
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                z = (np.column_stack([part.column(f"x{i}").to_numpy() for i in range(d)]) - mean) / deviation if d else np.zeros((part.num_rows, 0))
                y = part.column("y").to_numpy()
                times = part.column("n").to_numpy() * np.where(y == 1, weight, 1.0)
                yield pa.RecordBatch.from_pydict({"n": pa.array([part.num_rows], pa.int32()), "z": [z.tobytes()], "y": [y.tobytes()], "times": [times.tobytes()]})

    return table.mapInArrow(run, "n int, z binary, y binary, times binary")


def _gradient(blocks: DataFrame, w: np.ndarray, b: float) -> np.ndarray:
    """Sums over all rows of the intercept's and the features' gradients: a task adds up its blocks, and tasks are added per feature."""
    d = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1)
        for batch in batches:
            for block in batch.to_pylist():
                z, y, times = (np.frombuffer(block[c]) for c in ("z", "y", "times"))
                z = z.reshape(block["n"], d)
                with np.errstate(over="ignore"):
                    error = times * (1 / (1 + np.exp(-(z @ w + b))) - y)
                total += np.concatenate([[error.sum()], z.T @ error])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d + 1), pa.int32()), "g": total})

    got = blocks.mapInArrow(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()  # a row per feature
    return np.array([g for _, g in sorted((r.i, r.g) for r in got)])


def fit_logistic(rows: DataFrame, features: list[str], label: str = "label", iterations: int = 400, rate: float = 0.05, l2: float = 0.01, positive_weight: float | None = None) -> Linear:
    """Full-batch gradient descent on standardised features (population deviation, 1 where that is 0).

    Equal rows are summed first, so an iteration is one pass over distinct feature vectors: in NumPy where there are at most HELD_ROWS of
    them, else a job of one stage and a small sum over blocks of vectors, which are written and cached once; a job's plan is the same at
    every step. The intercept starts at the logit of the prevalence, clipped to [.001, .999], and isn't penalised.
    """
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)]
    table = rows.filter(F.col(label).isNotNull()).select(*x, F.col(label).cast("double").alias("y")).groupBy(*[f"x{i}" for i in range(len(x))], "y").agg(F.count("*").cast("double").alias("n")).persist()
    try:
        stats = table.agg(F.sum("n"), F.sum(F.col("n") * F.col("y")), *[s for i in range(len(x)) for s in (F.sum(F.col("n") * F.col(f"x{i}")), F.sum(F.col("n") * F.col(f"x{i}") * F.col(f"x{i}")))]).collect()[0]
        n, positives = stats[0] or 0.0, stats[1] or 0.0
        if not n:
            return Linear(tuple(features), (0.0,) * len(features), 0.0)
        mean = np.array(stats[2::2]) / n
        deviation = np.sqrt(np.maximum(np.array(stats[3::2]) / n - mean**2, 0))
        deviation[deviation == 0] = 1.0
        weight = positive_weight if positive_weight is not None else (n - positives) / positives if positives else 1.0
        base = min(max(positives / n, 0.001), 0.999)
        w, b = np.zeros(len(features)), float(np.log(base / (1 - base)))
        few = table.limit(HELD_ROWS + 1).collect()
        if len(few) <= HELD_ROWS:
            data = np.array(sorted(map(tuple, few)))
            z, y, times = (data[:, :-2] - mean) / deviation, data[:, -2], data[:, -1] * np.where(data[:, -2] == 1, weight, 1.0)
            for _ in range(iterations):
                with np.errstate(over="ignore"):
                    error = times * (1 / (1 + np.exp(-(z @ w + b))) - y)
                w -= rate * (z.T @ error / n + l2 * w)
                b -= rate * error.sum() / n
            iterations = 0
        if iterations:
            blocks = written(_blocks(table, mean, deviation, weight)).persist()
            try:
                for _ in range(iterations):
                    g = _gradient(blocks, w, b)
                    w -= rate * (g[1:] / n + l2 * w)
                    b -= rate * g[0] / n
            finally:
                blocks.unpersist()
        return Linear(tuple(features), tuple(map(float, w / deviation)), float(b - (w * mean / deviation).sum()))
    finally:
        table.unpersist()


def prevalence(rows: DataFrame, label: str = "label") -> Model:
    """Every score is the training prevalence."""
    p = rows.agg(F.avg(F.col(label).cast("double"))).collect()[0][0] or 0.0
    return lambda df: df.withColumn("score", F.lit(float(p)))


def recent_outage(rows: DataFrame) -> DataFrame:
    hit = (F.col("prior_unplanned_outage_count") > 0) & (F.col("days_since_previous_unplanned_outage") <= 7)
    return rows.withColumn("score", F.when(hit, 0.75).otherwise(0.15))


#: Weights of the warnings.
def operational_warning(rows: DataFrame) -> DataFrame:
    c = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    flag = lambda cond, w: F.when(cond, w).otherwise(0.0)
    total = (F.lit(0.10) + F.least(F.lit(0.25), 0.10 * c("alarm_count")) + F.least(F.lit(0.20), 0.20 * c("high_utilisation_share")) + flag(c("temperature_warning_count") > 0, 0.15)
             + flag((c("severe_weather_flag") > 0) | (c("recent_severe_weather_count") > 0), 0.15) + flag(c("constrained_count") > 0, 0.10) + flag(c("offline_count") > 0, 0.10))
    return rows.withColumn("score", F.least(F.lit(0.95), total))


def scored(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    """The union of what all models give, with `model`; a model that lacks a column is left out by the caller."""
    return reduce(DataFrame.unionByName, [m(rows).withColumn("model", F.lit(name)) for name, m in models.items()])


def backtest(folds: DataFrame, model: str, fit: Callable[[DataFrame], Model]) -> DataFrame:
    """Fits per fold on its train part and predicts its evaluate part; rows are named <model>_backtest_fold_<n>."""
    out = []
    for (n,) in sorted(folds.select("fold").distinct().collect()):
        one = folds.filter(F.col("fold") == n)
        done = fit(one.filter("part = 'train'"))(one.filter("part = 'evaluate'"))
        out.append(done.withColumn("model", F.lit(f"{model}_backtest_fold_{n}")).withColumn("split", F.concat(F.lit("backtest_cutoff_"), F.date_format("cutoff", "yyyy-MM-dd'T'HH:mm:ss"))))
    return reduce(DataFrame.unionByName, out)
