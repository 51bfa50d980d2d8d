"""Yinyang clustering against plain clustering by hand; vectors that aren't kept, ties, repeated rows, few vectors, an empty table."""

import hashlib
import math
import random

import numpy as np
import pytest

from gridspark.llm import clustering

ROW = "vec_id long, embedding array<float>, v string, cluster string, n string"


def by_hand(rows, k=40, rounds=5, seed=2, dims=64):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    heads = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, h)), c) for c, h in enumerate(heads))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(heads)):
            if of := [v for (_, v), o in zip(kept, own) if o == c]:
                heads[c] = [sum(x) // len(of) for x in zip(*of)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = {c: sum(d for _, o, d in last if o == c) for _, c, _ in last}
    return [(i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, heads[c])).encode()).hexdigest()) for i, c, d in last]


def table(spark, rows):
    return spark.createDataFrame([(i, e, "clash", "clash", "clash") for i, e in rows], ROW)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_clusters_by_hand(spark):
    rng = random.Random(5)
    heads = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(50)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(heads)]) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(150)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1])]
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.5] * 63 + [None]), (905, [0.5] * 63 + [math.nan]), (906, [-math.inf] + [0.5] * 63)]
    work = []
    got = clustering.cluster(table(spark, rows + odd).repartition(3), work=work)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(got) == sorted(by_hand(rows + odd), key=str)
    # The filters leave out distances, and more of them as centroids settle.
    assert work[0] == len(rows) * 41 and work[-1] < work[0] // 2


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 5) - 2.0] + [0.0] * 63) for i in range(60)]
    assert rows_of(clustering.cluster(table(spark, rows))) == sorted(by_hand(rows), key=str)


@pytest.mark.parametrize("rows", [[(7, [0.25] * 64)], [(7, [0.25] * 64)] * 9, [(i, [i / 7] * 64) for i in range(5)]])
def test_few_vectors(spark, rows):
    assert rows_of(clustering.cluster(table(spark, rows))) == sorted(by_hand(rows), key=str)


def test_large_components_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-20_000, 20_000) for _ in range(64)]) for i in range(90)]
    assert rows_of(clustering.cluster(table(spark, rows), rounds=2)) == sorted(by_hand(rows, rounds=2), key=str)
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(table(spark, [*rows, (99, [1e20] * 64)])).collect()


def test_nothing(spark):
    got = clustering.cluster(table(spark, [(1, None)]).limit(0))
    assert got.count() == 0 and got.columns[0] == "vec_id"
    assert clustering.cluster(table(spark, [(1, None), (2, [1.0])])).count() == 0


def test_bounds_never_hide_the_nearest():
    rng = np.random.default_rng(4)
    v = rng.integers(-60, 60, (500, 8))
    at = rng.integers(-60, 60, (23, 8))
    c = clustering.Centroids(at, clustering.groups_of(at), np.zeros(23))
    own, upper, lower = np.zeros(500, np.int64), np.full(500, np.inf), np.zeros((500, c.group.max() + 1))
    for _ in range(8):
        own, upper, lower, _ = clustering.assign(v, own, upper, lower, c)
        d = ((v[:, None] - c.at[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all() and (upper >= np.sqrt(d.min(1)) - 1e-9).all()
        d[np.arange(500), own] = 1 << 40
        for g in range(lower.shape[1]):
            assert (lower[:, g] <= np.sqrt(d[:, c.group == g].min(1)) + 1e-9).all()
        new = c.at + rng.integers(-3, 4, c.at.shape)
        c = clustering.Centroids(new, c.group, np.sqrt(((new - c.at) ** 2).sum(1)) * (1 + 1e-9))
