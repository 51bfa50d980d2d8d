"""Steps whose work grew faster than their input: brute force on odd rows, and what must not be in their plans."""

import contextlib
import io
import random
import re
import time

import pytest

from gridspark.llm import licenses
from gridspark.operators import documents, reliability, risk


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def meters():
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(0, 90), rng.choice([None, *range(5)]), i, float(rng.randrange(50)), rng.choice(["GOOD", "ESTIMATED"]), rng.choice([200.0, 230.0])) for i in range(150)]
    return [*rows, ("a", 30, 1, None, 7.0, "GOOD", 230.0), ("b", 95, None, 900, 3.0, "GOOD", 230.0), ("c", 0, 9, 901, 4.0, "GOOD", 230.0)]


METERS = "entity_id string, ts_min long, meter_id long, event_id long, active_energy_kwh double, quality_code string, voltage_v double"


def test_meter_features_by_hand(spark, meters):
    obs = [(e, o) for e in "abcd" for o in range(0, 150, 7)]
    got = risk.meter_features(spark.createDataFrame(obs, "entity_id string, obs long"), spark.createDataFrame(meters, METERS), 23)
    assert got.count() == len(obs)
    for r in got.collect():
        mine = [m for m in meters if m[0] == r.entity_id and r.obs - 23 <= m[1] <= r.obs]
        line = sorted(mine, key=lambda m: (m[1], -1 if m[3] is None else m[3]))
        n, known = len(mine), len({m[2] for m in mine} - {None})
        assert r.aggregate_energy_kwh == sum(m[4] for m in mine)
        assert r.energy_change_rate == (line[-1][4] - line[0][4] if line else 0.0)
        assert (r.meter_count, r.meter_coverage_ratio) == (known, min(1.0, n / max(1, 2 * known)) if n else 0.0)
        assert r.estimated_reading_share == (sum(m[5] == "ESTIMATED" for m in mine) / n if n else 0.0)
        assert (r.missing_reading_share, r.voltage_quality_issue_count) == (0.0 if n else 1.0, sum(m[6] == 200 for m in mine))


def test_readings_are_added_up_before_they_meet_observations(spark, meters):
    """Distinct meters of pairs of reading and observation would shuffle a row for each such pair."""
    rows = spark.createDataFrame([("a", 5)], "entity_id string, obs long")
    assert "distinct meter_id" not in plan(risk.meter_features(rows, spark.createDataFrame(meters, METERS), 23))


def test_flattening_stays_in_a_row(spark):
    docs = spark.createDataFrame([(1, '{"a": {"b": {"c": {}, "d": [1, {"x": 2}]}, "e": null}, "t": "true", "u": true}'), (1, '[1, 2]'), (2, "no json"), (3, "{}")], "k long, j string")
    got = documents.flattened(docs, ["k"], "j")
    assert "Exchange" not in plan(got)
    assert sorted((r.k, r.line_no, r.line) for r in got.collect()) == [(1, 1, 'a.b.d=[1,{"x":2}]'), (1, 1, "value=[1,2]"), (1, 2, "a.e=null"), (1, 3, "t=true"), (1, 4, "u=True")]


def test_deciding_terms_of_a_licence_are_found_as_by_a_pattern_and_faster():
    m = licenses.Matcher(licenses.LICENCES, {}, 1000, licenses.LEAST)
    pattern = re.compile("|".join(rf"(?<![A-Za-z]){t}(?![A-Za-z])" if t.isalpha() else re.escape(t) for t in sorted(m.anchored, key=lambda t: (-len(t), t))), re.I | re.A)
    rng, parts = random.Random(2), [*m.anchored, "MIT", "Zero", "\n", " ", "x", "\u00e9", "\u212a", "\u0130", "\u0660"]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=30))
        assert m.lines(text) == [line for line in text.split("\n") if pattern.search(line)]
    text = "lorem ipsum dolor sit amet " * 20000
    began = time.perf_counter()
    assert m.scan(text, False) == (None, 0.0)
    middle = time.perf_counter()
    assert not pattern.search(text)
    assert (middle - began) * 3 < time.perf_counter() - middle


def test_median_of_durations_from_counts(spark):
    rows = [("a", d, 10, 1.0, False, "x", True) for d in (3, 5, 7, 7, 200)] + [("b", 4, 10, 1.0, True, "x", False), ("c", 9, 1, 1.0, None, None, None)]
    o = spark.createDataFrame(rows, "e string, duration_minutes long, customers long, load_mw double, planned boolean, cause string, severe boolean")
    k = reliability.kpis(o, ["e"], o.select("e").distinct().selectExpr("e", "4L AS population"), 100, overlap=False)
    assert "median(" not in plan(k) and "percentile" not in plan(k).lower()
    got = {r.e: (r.outage_count, r.sustained_count, r.mean_duration, r.median_duration, r.max_duration, r.unplanned_count, r.customer_minutes) for r in k.collect()}
    assert got == {"a": (5, 4, 54.75, 7.0, 200, 5, 2190), "b": (1, 0, None, None, None, 0, 0), "c": (1, 1, 9.0, 9.0, 9, 0, 9)}
