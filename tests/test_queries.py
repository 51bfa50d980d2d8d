"""Every registered query against its SQL, at the smallest scale."""

import math

import duckdb
import numpy as np
import pytest

from gridspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.7g}")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    a = sorted([tuple(plain(r[c]) for c in cols) for r in got], key=str)
    b = sorted([tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()], key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-5, abs_tol=1e-9) for p, q in zip(x, y)), (x, y)


def test_logistic_is_trained_to_the_end(spark, con):
    """400 full-batch steps at rate 0.05, as the reference."""
    rows = con.sql("SELECT source, toxic, (n_chars % 101) / 100.0::DOUBLE, quality FROM labels JOIN documents USING (doc_id)").fetchall()
    source, (y, *x) = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], float).T
    z = np.stack([(c - c.mean()) / (c.std() or 1) for c in x], axis=1)
    weight, w, b = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0), np.zeros(2), math.log(y.mean() / (1 - y.mean()))
    for _ in range(400):
        e = weight * (1 / (1 + np.exp(-(z @ w + b))) - y)
        w, b = w - 0.05 * (z.T @ e / len(y) + 0.01 * w), b - 0.05 * e.mean()
    p = 1 / (1 + np.exp(-(z @ w + b)))
    got = {r.source: (r.brier, r.log_loss) for r in QUERIES["clf_logistic"](spark, SF).collect()}
    for s in set(source):
        at = source == s
        assert got[s] == pytest.approx((((p - y)[at] ** 2).mean(), -np.log(np.where(y == 1, p, 1 - p)[at]).mean()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
