"""Forecast and classification metrics, residual quantiles and model selection, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from . import ordered

FORECAST_METRICS = ("mae", "rmse", "mape", "smape", "wape", "bias")


def forecast(rows: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE, MAPE, sMAPE, WAPE (percentages), bias and, with lower/upper columns, interval coverage. Zero terms are
    skipped; null where nothing is left."""
    a, p = F.col(actual), F.col(predicted)
    e = p - a
    size = (F.abs(a) + F.abs(p)) / 2
    out = [
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.when(a != 0, F.abs(e) / F.abs(a)))).alias("mape"),
        (100 * F.avg(F.when(size != 0, F.abs(e) / size))).alias("smape"), (100 * ratio(F.sum(F.abs(e)), F.sum(F.abs(a)))).alias("wape"), F.avg(e).alias("bias")]
    if "lower" in rows.columns:
        out.append(F.avg(((a >= F.col("lower")) & (a <= F.col("upper"))).cast("double")).alias("coverage"))
    return rows.groupBy(*keys).agg(*out)


def overall(metrics: DataFrame, keys: list[str], names: tuple[str, ...] = FORECAST_METRICS) -> DataFrame:
    """Means weighted by n; null if any group is null."""
    weighted = lambda m: F.when(F.count(m) == F.count("*"), F.sum(F.col(m) * F.col("n")) / F.sum("n"))
    return metrics.groupBy(*keys).agg(F.sum("n").alias("n"), *[weighted(m).alias(m) for m in names])


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The sorted values at index floor(p * (n - 1)) of each group, as one column per share. Groups may be of any size."""
    places = {name: F.floor(F.lit(p) * (F.col("total") - 1)) for name, p in shares.items()}
    return ordered.at_places(ordered.value_ranks(rows, keys, value), keys, value, places)


def intervals(predictions: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """lower and upper from residual quantiles q_lo and q_hi: lower = max(0, min(v, v + q_lo)), upper = max(v, v + q_hi, lower)."""
    v = F.col("predicted")
    out = predictions.join(quantiles, keys, "left")
    lower = F.greatest(F.lit(0.0), F.least(v, v + F.coalesce("q_lo", F.lit(0.0))))
    return out.withColumn("lower", lower).withColumn("upper", F.greatest(v, v + F.coalesce("q_hi", F.lit(0.0)), F.col("lower"))).drop("q_lo", "q_hi")


def select_model(metrics: DataFrame, keys: list[str], metric: str = "mae", name: str = "model") -> DataFrame:
    """The model with the least value per key, ties by name."""
    best = metrics.filter(F.col(metric).isNotNull()).groupBy(*keys).agg(F.min(F.struct(F.col(metric).alias("value"), F.col(name).alias("model"))).alias("b"))
    return best.select(*keys, "b.model", "b.value")


def select_classifier(metrics: DataFrame, keys: list[str], metric: str, candidates: list[str]) -> DataFrame:
    """The candidate with the largest value, ties by the order of candidates; a model with a null in any group is excluded, and
    without any left it is the first candidate."""
    place = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("model"))
    mean = metrics.groupBy(*keys, "model").agg(F.when(F.count(metric) == F.count("*"), F.sum(F.col(metric) * F.col("n")) / F.sum("n")).alias("value"))
    best = mean.groupBy(*keys).agg(F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("value")).alias("v"), place.alias("p"), F.col("model").alias("m")))).alias("b"))
    return best.select(*keys, F.coalesce("b.m", F.lit(candidates[0])).alias("model"), (-F.col("b.v")).alias("value"))


def confusion(rows: DataFrame, keys: list[str], label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Confusion counts and derived rates."""
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), one(y & hit).alias("tp"), one(~y & hit).alias("fp"), one(~y & ~hit).alias("tn"), one(y & ~hit).alias("fn"))
    precision, recall = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": precision, "recall": recall, "specificity": ratio("tn", F.col("tn") + F.col("fp")), "accuracy": ratio(F.col("tp") + F.col("tn"), "n"),
                            "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "prevalence": ratio(F.col("tp") + F.col("fn"), "n")})


def _by_score(rows: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """One row per distinct score: counts of either label. All curves are computed on these, not on the rows."""
    y = F.when(F.col(label) == 1, 1).otherwise(0)
    return rows.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(y).cast("double").alias("_p"), F.sum(1 - y).cast("double").alias("_q"))


def roc_auc(rows: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Pairs won, ties counting half, over all pairs; null without both labels."""
    won = ordered.running(_by_score(rows, keys, label, score), keys, ["_s"], {"_upto": "_q"})
    return won.groupBy(*keys).agg(ratio(F.sum(F.col("_p") * (F.col("_upto") - 0.5 * F.col("_q"))), F.sum("_p") * F.sum("_q")).alias("roc_auc"))


#: Terms of a harmonic sum that are added one by one; from there on its series is exact to a double.
TERMS = 16


def _harmonic(n: Column, p: Column) -> Column:
    """1 / (n + 1) + ... + 1 / (n + p), whatever p."""
    first = F.least(p, F.lit(float(TERMS)))
    head = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.lit(0.0), lambda acc, k: acc + F.when(k <= first, 1 / (n + k)).otherwise(0.0))
    x, y = n + first + 1, n + p + 1  # digamma(y) - digamma(x)
    tail = lambda z: -1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    return head + F.log1p((y - x) / x) + tail(y) - tail(x)


def pr_auc(rows: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Trapezoids from (recall 0, precision 1) over rows by falling score, positives of a tied score first; null without positives.

    Among the p positives of one score precision runs over (t + k) / (t + f + k), k = 1..p, after t hits and f misses: its sum is
    p - f (H(t + f + p) - H(t + f)) with harmonic numbers H, so a tie of any size is one expression.
    """
    g = ordered.running(_by_score(rows, keys, label, score), keys, [F.desc("_s")], {"_tp1": "_p", "_fp1": "_q"}, totals={"_all": "_p"})
    p, hits, falls = F.col("_p"), F.col("_tp1") - F.col("_p"), F.col("_fp1") - F.col("_q")
    seen = hits + falls
    start = F.when(seen > 0, hits / seen).otherwise(1.0)
    last = (hits + p) / (seen + p)
    area = p - F.when(falls > 0, falls * _harmonic(seen, p)).otherwise(0.0) + (start - last) / 2
    return g.groupBy(*keys).agg(ratio(F.sum(F.when(p > 0, area).otherwise(0.0)), F.max("_all")).alias("pr_auc"))


def probabilistic(rows: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Brier score and log-loss, scores clipped to [1e-6, 1 - 1e-6]."""
    y = F.col(label).cast("double")
    s = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    return rows.groupBy(*keys).agg(F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"), (-F.avg(y * F.log(s) + (1 - y) * F.log(1 - s))).alias("log_loss"))


def thresholds(rows: DataFrame, keys: list[str], cuts: tuple[float, ...], score: str = "score") -> DataFrame:
    """(keys, threshold, n, predicted_positive) for each cut."""
    each = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum((F.col(score) >= c).cast("long")).alias(f"_{i}") for i, c in enumerate(cuts)])
    pairs = F.array(*[F.struct(F.lit(c).alias("threshold"), F.col(f"_{i}").alias("predicted_positive")) for i, c in enumerate(cuts)])
    return each.select(*keys, "n", F.inline(pairs))


def class_balance(rows: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(F.col(label).cast("double")).alias("prevalence"))
