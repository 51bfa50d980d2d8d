"""Flattening against a recursive version by hand; extraction of files of every format."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators import documents


def by_hand(x, path=()):
    if isinstance(x, dict):
        return [line for k in sorted(x) for line in by_hand(x[k], (*path, k))]
    shown = json.dumps(x[:20], sort_keys=True, separators=(",", ":"), ensure_ascii=False) if isinstance(x, list) else "null" if x is None else str(x)
    return [(path or ("value",), shown)]


def nested(rng, depth):
    roll = rng.random()
    if depth and roll < 0.5:
        return {rng.choice(["a", "b", "a.b", "Z", "é", "a b", "_"]) + str(rng.randint(0, 3)): nested(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return rng.choice([None, True, False, 7, -3, 2.5, "text", "", "with = sign", "é😀", [], list(range(30)), ["x", None, {"b": 1, "a": [2]}], 123456789012])


def test_flatten(spark):
    rng = random.Random(9)
    docs = [(i, json.dumps(nested(rng, 6))) for i in range(150)] + [(900, "{broken"), (901, None), (902, ""), (903, "{}"), (904, "[1, 2]"), (905, "null"), (906, '"x"')]
    got = documents.flattened(spark.createDataFrame(docs, "k long, payload string").withColumn("value", F.lit("clash")), ["k"], "payload")
    want = {}
    for k, text in docs:
        try:
            lines = sorted(by_hand(json.loads(text)))
        except (TypeError, ValueError):
            continue
        for n, (path, shown) in enumerate(lines, 1):
            want[k, n] = f"{'.'.join(path)}={shown}"
    assert {(r.k, r.line_no): r.line for r in got.collect()} == want and len(want) > 200
    assert documents.flattened(spark.createDataFrame([], "k long, payload string"), ["k"], "payload").count() == 0


def test_markdown(spark):
    text = "before\r\n\n# One\nfirst\n##  Two ## \n\n#\nlast\nno # heading"
    got = documents.markdown_sections(spark.createDataFrame([(1, text), (2, "# Only"), (3, ""), (4, None)], "k long, t string"), ["k"], "t").orderBy("k", "section").collect()
    assert [(r.k, r.section, r.title) for r in got] == [(1, 0, "Document"), (1, 1, "One"), (1, 2, "Two"), (1, 3, "Section"), (2, 0, "Only")]
    assert got[1].content == "# One\nfirst" and got[3].content == "#\nlast\nno # heading"


@pytest.mark.parametrize("by", ["plain", "uri"])
def test_extract(spark, tmp_path, by):
    put = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    put("a/guide.md", "intro\n# SAIFI\nAverage interruption frequency, REASON_CODE_ONE.\n\n")
    put("a/m.json", json.dumps({"reliability_run_id": "r1", "feeder_id": "FDR-1", "kpis": {"saifi": 1.5, "asai": None}}))
    put("b/c.yaml", "run_id: y1\nlimits:\n  high: [1, 2]\n  open: true\n")
    put("b/rows.csv", 'asset_id,score\nAST-1,"3,5"\nAST-2,\n' + "".join(f"AST-{i},1\n" for i in range(3, 70)))
    put("b/none.csv", "x,y\n")
    put("b/r.jsonl", "".join(json.dumps({"run_id": f"j{i}", "n": i}) + "\n" for i in range(60)))
    put("bad.json", "{")
    put("skip.txt", "nothing")
    got = {(r.source_path.rpartition("/")[2], r.section): r for r in documents.extract(spark, str(tmp_path) if by == "plain" else f"file://{tmp_path}").collect()}
    assert got["guide.md", 1].content == "# SAIFI\nAverage interruption frequency, REASON_CODE_ONE." and got["guide.md", 0].title == "Document"
    m = got["m.json", 0]
    assert m.content == "feeder_id=FDR-1\nkpis.asai=null\nkpis.saifi=1.5\nreliability_run_id=r1" and (m.run_id, m.entity_id) == ("r1", "FDR-1")
    assert got["c.yaml", 0].content == "limits.high=[1,2]\nlimits.open=True\nrun_id=y1"
    assert got["rows.csv", 0].content == "asset_id=AST-1; score=3,5" and got["rows.csv", 1].content == "asset_id=AST-2; score=null" and got["rows.csv", 0].entity_id == "AST-1"
    assert sum(k[0] == "rows.csv" for k in got) == 50 and sum(k[0] == "r.jsonl" for k in got) == 50 and got["r.jsonl", 49].content == "n=49\nrun_id=j49"
    assert got["none.csv", 0].content == "No rows available." and got["bad.json", 0].malformed and not any("skip" in k[0] for k in got)
    assert documents.extract(spark, str(tmp_path / "gone")).count() == 0
    names = spark.createDataFrame([("The mae, saifi_minutes AND_SO_ON Wape are HIGH_RISK or X_1",)], "t string").select(documents.metric_names(F.col("t")).alias("m"), documents.reason_codes(F.col("t")).alias("r")).first()
    assert names.m == ["and_so_on", "high_risk", "mae", "saifi_minutes", "wape", "x_1"] and names.r == ["AND_SO_ON", "HIGH_RISK"]
