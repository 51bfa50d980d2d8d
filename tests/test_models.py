"""Logistic descent over blocks, as beyond HELD_ROWS, against NumPy."""

import math
import random

import numpy as np
import pytest

from gridspark.operators import models


def by_hand(rows, iterations, weight):
    x, y = np.array([r[:2] for r in rows], float), np.array([r[2] for r in rows], float)
    mean, deviation = x.mean(0), x.std(0)
    deviation[deviation == 0] = 1
    z, times = (x - mean) / deviation, np.where(y == 1, weight, 1.0)
    w, b = np.zeros(2), math.log(y.mean() / (1 - y.mean()))
    for _ in range(iterations):
        e = times * (1 / (1 + np.exp(-(z @ w + b))) - y)
        w, b = w - 0.05 * (z.T @ e / len(y) + 0.01 * w), b - 0.05 * e.mean()
    return [*(w / deviation), b - (w * mean / deviation).sum()]


@pytest.mark.parametrize("weight", [None, 3.0])
def test_blocks_like_numpy(spark, monkeypatch, weight):
    monkeypatch.setattr(models, "HELD_ROWS", 50)
    monkeypatch.setattr(models, "BLOCK_ROWS", 37)
    rng = random.Random(14)
    rows = [(rng.gauss(3, 2), rng.randint(0, 5), int(rng.random() < 0.3)) for _ in range(900)] + [(1.0, 2, 1)] * 40
    positive = sum(r[2] for r in rows)
    df = spark.createDataFrame(rows, "a double, b int, label int").repartition(5)
    got = models.fit_logistic(df, ["a", "b"], iterations=12, positive_weight=weight)
    want = by_hand(rows, 12, weight or (len(rows) - positive) / positive)
    assert [*got.coefficients, got.intercept] == pytest.approx(want, rel=1e-9)
    monkeypatch.setattr(models, "HELD_ROWS", 10_000)
    held = models.fit_logistic(df, ["a", "b"], iterations=12, positive_weight=weight)
    assert [*held.coefficients, held.intercept] == pytest.approx(want, rel=1e-9)
