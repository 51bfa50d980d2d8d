"""The assistant's run over files of every form, against what each question should find; its responses in reporting."""

import hashlib
import json
import math
import re
from collections import Counter

import pytest

from gridspark import assistant_run, pipelines, runs
from gridspark.sources import files

QUESTIONS = [
    {"query_id": "q1", "query_text": "What is the SAIFI reliability of FDR-NORTH-1?", "expected_category": "reliability_performance", "expected_source_components": ["reliability"], "expected_response_status": "GROUNDED", "must_refuse": False, "minimum_citations": 1},
    {"query_id": "q2", "query_text": "Open this breaker now.", "expected_category": "unsupported", "expected_response_status": "REFUSED", "must_refuse": True, "minimum_citations": 0},
    {"query_id": "q3", "query_text": "Show the demand forecast for zebras", "expected_category": "forecast_summary", "expected_response_status": "INSUFFICIENT_EVIDENCE", "must_refuse": False, "minimum_citations": 0},
    {"query_id": "q4", "query_text": "What is the real current status?"},
    {"query_id": "q5", "query_text": None},
]


@pytest.fixture()
def sources(tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    put("outputs/reliability/kpis.csv", "reliability_run_id,feeder_id,saifi,reliability_band\nrl-1,FDR-NORTH-1,2.5,WEAK\nrl-1,FDR-SOUTH-2,0.1,STRONG\n")
    put("reports/reliability/r.md", "# Reliability report\nThe reliability of feeders is measured by saifi.\n# Other\nreliability and saifi of substations\n# Copy\nx\n")
    put("docs/how.md", "# How SAIFI is calculated\nThe reliability methodology divides interruptions by customers.\n")
    put("outputs/forecasting/metrics.json", json.dumps({"forecast_run_id": "fc-1", "selected_model": "persistence", "mae": 1.5}))
    put("outputs/reliability/raw.txt", "reliability saifi FDR-NORTH-1")
    put("outputs/genai/old.csv", "saifi\n1\n")
    put("configs/data_contracts/bad.yaml", "a: [1")
    put("secret/reliability.md", "# saifi\nreliability")
    return tmp_path


def test_run(spark, sources, tmp_path):
    c = {"source_root": f"file://{sources}", "output_root": f"file://{tmp_path}/out", "questions": QUESTIONS}
    run = assistant_run.run_assistant(spark, c, "ga-1")
    assert run.status == "COMPLETED" and run.found == [("configs/data_contracts/bad.yaml", "MALFORMED_SOURCE")]
    got = {r.query_id: r for r in spark.read.parquet(run.paths["responses"]).collect()}
    assert {k: (r.query_category, r.response_status) for k, r in got.items()} == {
        "q1": ("reliability_performance", "GROUNDED"), "q2": ("unsupported", "REFUSED"), "q3": ("forecast_summary", "INSUFFICIENT_EVIDENCE"), "q4": ("unsupported", "REFUSED"), "q5": ("unsupported", "INSUFFICIENT_EVIDENCE")}
    assert got["q2"].safety_reason_code == "RESTRICTED_OPERATIONAL_CONTROL" and got["q4"].safety_reason_code == "UNSUPPORTED_REAL_WORLD_STATUS" and got["q2"].citation_ids == "" and got["q3"].citation_ids.count("SRC") <= 1
    hits = spark.read.parquet(run.paths["retrievals"]).filter("query_id = 'q1'").orderBy("rank").collect()
    # The entity's own row comes first: component, entity, category and metric add 1, 1, 0.3 and 0.5 to its words.
    assert hits[0].source_path == "outputs/reliability/kpis.csv" and "FDR-NORTH-1" in hits[0].chunk
    words = lambda t: Counter(x.lower() for x in re.findall("[A-Za-z0-9_][A-Za-z0-9_-]*", t))
    chunks, want = [words(r.chunk) for r in spark.read.parquet(run.paths["chunks"]).collect()], words(QUESTIONS[0]["query_text"])
    for h, boost in zip(hits[:2], (2.8, 1.8)):
        shared = {t: min(want[t], n) for t, n in words(h.chunk).items() if t in want}
        lexical = sum(n * (math.log((1 + len(chunks)) / (1 + sum(t in c for c in chunks))) + 1) for t, n in shared.items()) / sum(want.values())
        assert h.score == pytest.approx(lexical + boost, abs=2e-6)
    # Documentation may not answer this category; other forms and folders are no sources.
    assert {h.component for h in hits} == {"reliability"} and not any("raw.txt" in h.source_path or "secret" in h.source_path for h in hits)
    states = {r.source_path: r.state for r in spark.read.parquet(run.paths["sources"]).collect()}
    assert states["outputs/reliability/raw.txt"] == "OTHER_FORMAT" and states["docs/how.md"] == "APPROVED" and "outputs/genai/old.csv" not in states
    cited = spark.read.parquet(run.paths["citations"]).filter("query_id = 'q1'").orderBy("citation_id").collect()
    assert got["q1"].citation_ids == "|".join(r.citation_id for r in cited) and cited[0].row_reference == "CSV row 1" and cited[0].run_id == "rl-1"
    audit = {r.query_id: r for r in spark.read.parquet(run.paths["audits"]).collect()}["q1"]
    text = "\n".join(h.chunk for h in hits[:5])
    assert audit.prompt_hash == hashlib.sha256(f"{QUESTIONS[0]['query_text']}|reliability_performance|{text}".encode()).hexdigest() and audit.context_characters == len(text)
    told = json.loads(files.read_text(spark, run.paths["metrics"]))
    assert told["rates"]["n"] == 5 and told["rates"]["refused_rate"] == 0.4 and told["evaluation"]["n"] == 3 and told["evaluation"]["status_accuracy"] == 1.0 and told["evaluation"]["refusal_accuracy"] == 1.0

    report = {"output_root": f"{tmp_path}/r", "date_dimension_start": "2026-01-01", "date_dimension_end": "2026-01-02", "roots": [c["output_root"]]}
    r = runs.run_reporting(spark, report, "rp-1")
    assert r.status == "COMPLETED" and r.counts["fact_assistant_response"]["rows"] == 5 and r.counts["bridge_response_citation"]["rows"] == sum(len([x for x in g.citation_ids.split("|") if x]) for g in got.values())
    measures = json.loads(files.read_text(spark, r.paths["metrics"]))["measures"]
    assert measures["Grounded Response Rate"] == 0.2 and measures["Citation Coverage"] == pytest.approx(sum(g.citation_coverage for g in got.values()) / 5)


def test_refuses(spark, sources, tmp_path):
    c = {"source_root": str(sources), "output_root": f"{tmp_path}/out"}
    for bad in ({"questions": []}, {"questions": [QUESTIONS[0], QUESTIONS[0]]}, {"questions": QUESTIONS, "chunk_overlap_characters": 1200}, {"questions": QUESTIONS, "registry": [{"folder": "docs"}]}):
        with pytest.raises(pipelines.ConfigError):
            assistant_run.run_assistant(spark, c | bad)
    none = assistant_run.run_assistant(spark, c | {"questions": QUESTIONS[:3], "registry": [{"folder": "docs", "component": "documentation", "formats": ["md"], "categories": ["methodology"], "approved": False}]}, "no")
    assert none.counts["responses"] == {"REFUSED": 1, "INSUFFICIENT_EVIDENCE": 2} and none.counts["sources"] == {"NOT_APPROVED": 1}
