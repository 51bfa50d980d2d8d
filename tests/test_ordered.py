"""Places, running sums, ranks and curves of one large group that spans many ranges, against NumPy; sweeps against a loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import health, metrics, ordered, risk


@pytest.fixture()
def many_ranges(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def test_places_and_sums(spark, many_ranges):
    rows = [(None if i % 50 == 0 else "hot" if i % 9 else "cold", (i * 7919) % 20_011, i % 5 if i % 4 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, v int, x int")
    assert {r.v: r.place for r in ordered.numbered(df.select("v"), ["v"]).collect()} == {v: n for n, v in enumerate(sorted(r[1] for r in rows), 1)}
    sizes = [r["count"] for r in ordered.ranged(df, ["g", "v"]).groupBy(ordered._range().alias("k")).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 20_000 / 5
    got = ordered.running(df, ["g"], [F.desc("v")], {"s": "x"}, maxes={"m": "x"}, totals={"t": "x"})
    assert got.columns == ["g", "v", "x", "s", "m", "t"]
    want, sums, most = {}, {}, {}
    for g, v, x in sorted(rows, key=lambda r: -r[1]):
        sums[g] = sums.get(g, 0) + (x or 0)
        most[g] = max([y for y in (most.get(g), x) if y is not None], default=None)
        want[g, v] = (x, sums[g], most[g])
    assert {(r.g, r.v): (r.x, r.s, r.m) for r in got.collect()} == want
    assert {(r.g, r.t) for r in got.collect()} == set(sums.items())
    none = ordered.running(df.limit(0), ["g"], ["v"], {"s": "x"})
    assert none.count() == 0 and ordered.numbered(df.limit(0), ["v"]).count() == 0


def test_quantiles_and_medians(spark, many_ranges):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=30_001), np.repeat([1.0, 2.0, 3.0, 9.0], 500)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("c", 5.0), ("d", None)], "g string, v double").repartition(6)
    got = {r.g: (r.lo, r.hi) for r in metrics.nearest_rank(df, ["g"], "v", {"lo": 0.1, "hi": 0.9}).collect()}
    rank = lambda x, p: sorted(x)[int(p * (len(x) - 1))]
    assert got == {"a": (rank(a, 0.1), rank(a, 0.9)), "b": (rank(b, 0.1), rank(b, 0.9)), "c": (5.0, 5.0)}
    middle = {r.g: r.median for r in ordered.median(ordered.value_ranks(df, ["g"], "v"), ["g"], "v").collect()}
    assert middle == {"a": np.median(a), "b": 2.5, "c": 5.0}
    fleet = {r.g: (r.assets, r.median_score) for r in health.fleet(df.withColumnRenamed("v", "health_score").withColumn("completeness", F.lit(1.0)), ["g"]).collect()}
    assert fleet == {"a": (30_001, np.median(a)), "b": (2000, 2.5), "c": (1, 5.0), "d": (1, None)}


def curves_by_hand(rows):
    ranked = sorted(rows, key=lambda r: (-r[0], -r[1]))
    tp, fp, points = 0, 0, [(0.0, 1.0)]
    total = sum(y for _, y in rows)
    for _, y in ranked:
        tp, fp = tp + y, fp + 1 - y
        points.append((tp / total, tp / (tp + fp)))
    pr = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(points, points[1:]))
    scores = np.array([s for s, _ in rows])
    below = {s: (scores[[y == 0 for _, y in rows]] < s).sum() + 0.5 * (scores[[y == 0 for _, y in rows]] == s).sum() for s in set(scores)}
    return sum(below[s] for s, y in rows if y) / (total * (len(rows) - total)), pr


def test_curves_of_one_model(spark, many_ranges):
    rng = random.Random(4)
    smooth = [(rng.random(), int(rng.random() < 0.3)) for _ in range(4000)]
    tied = [(rng.choice([0.1, 0.2, 0.2, 0.9]), int(rng.random() < 0.4)) for _ in range(3000)]
    edge = [(0.5, 1)] * 40 + [(0.5, 0)] * 3 + [(0.7, 0)] + [(0.2, 1)]
    df = spark.createDataFrame([(m, s, y) for m, rows in (("smooth", smooth), ("tied", tied), ("edge", edge)) for s, y in rows], "model string, score double, label int")
    roc = {r.model: r.roc_auc for r in metrics.roc_auc(df, ["model"]).collect()}
    pr = {r.model: r.pr_auc for r in metrics.pr_auc(df, ["model"]).collect()}
    for m, rows in (("smooth", smooth), ("tied", tied), ("edge", edge)):
        assert (roc[m], pr[m]) == pytest.approx(curves_by_hand(rows), rel=1e-11)
    one = df.filter("label = 1")
    assert {r.roc_auc for r in metrics.roc_auc(one, ["model"]).collect()} == {None} and {round(r.pr_auc, 12) for r in metrics.pr_auc(one, ["model"]).collect()} == {1.0}


def test_harmonic_sums(spark):
    pairs = [(n, p) for n in (0.0, 1.0, 5.0, 1000.0) for p in (1.0, 2.0, 15.0, 16.0, 17.0, 100.0, 50_000.0)]
    got = spark.createDataFrame(pairs, "n double, p double").select("n", "p", metrics._harmonic(F.col("n"), F.col("p")).alias("h")).collect()
    for r in got:
        assert r.h == pytest.approx((1 / (r.n + np.arange(1, r.p + 1))).sum(), rel=1e-12)


def test_sweep(spark, many_ranges):
    rng = random.Random(12)
    ticks = [(e, 1000 + 7 * i) for e in ("hot", "b", "quiet") for i in range(200)]
    events = []
    for i in range(2500):
        start = rng.randint(0, 2600)
        events.append((i, "hot" if rng.random() < 0.9 else "b", start, start + rng.choice([0, 1, 5, 60, 900]), rng.random() < 0.2, rng.choice(["equipment_failure", "other"]), rng.random() < 0.3, rng.randint(1, 99)))
    out = spark.createDataFrame(events, "i int, entity_id string, start_min long, end_min long, planned boolean, cause string, severe boolean, duration_minutes long")
    rows = spark.createDataFrame(ticks, "entity_id string, obs long")
    reach = 500
    got = {(r.entity_id, r.obs): r for r in risk.prior_outage_features(rows, out, reach).collect()}
    assert len(got) == len(ticks)
    for e, obs in ticks:
        seen = [x for x in events if x[1] == e and not x[4] and obs - reach <= x[2] < obs and x[3] <= obs]
        r = got[e, obs]
        assert (r.prior_unplanned_outage_count, r.prior_equipment_failure_outage_count, r.prior_severe_weather_outage_count, r.historical_outage_duration_minutes) == (
            len(seen), sum(x[5] == "equipment_failure" for x in seen), sum(x[6] for x in seen), sum(x[7] for x in seen))
        assert r.days_since_previous_unplanned_outage == (obs // 1440 - max(x[2] for x in seen) // 1440 if seen else risk.NEVER)
