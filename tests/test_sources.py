"""Readers, manifests, sinks, the generator and streams, on files of their own."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gridspark.operators import validation
from gridspark.sources import contracts, generator, manifest, readers, sinks
from gridspark.streaming import micro

CONTRACT = {"dataset": "d", "schema_version": "1", "format": "csv", "primary_key": "id", "fields": [{"name": "id", "type": "string"}, {"name": "v", "type": "number"}, {"name": "schema_version", "type": "string"}]}


def test_contract_checks():
    assert contracts.checked(dict(CONTRACT))["primary_key"] == ["id"]
    assert contracts.schema(CONTRACT).fieldNames() == ["id", "v", "schema_version"]
    for broken in ({"fields": []}, {"primary_key": "x"}, {"fields": [{"name": "id", "type": "decimal"}]}):
        with pytest.raises(contracts.ContractError):
            contracts.checked({**CONTRACT, **broken})


def test_csv(spark, tmp_path):
    f = tmp_path / "d.csv"
    f.write_text("id,v,schema_version\na,1.5,1\nb,x,1\nc,2\n")
    got = readers.read(spark, str(f), contracts.checked(dict(CONTRACT)))
    assert {r.id: (r._row, r._issue) for r in got.collect()} == {"a": (2, None), "b": (3, None), "c": (4, "INCONSISTENT_CSV_ROW")}
    typed = validation.typed(got.drop("_file", "_issue"), CONTRACT)
    assert {r.id: [i.code for i in r.issues] for r in typed.collect()}["b"] == ["INVALID_DATA_TYPE"]
    f.write_text("v,id,schema_version\n1,a,1\n")
    with pytest.raises(readers.HeaderError):
        readers.read(spark, str(f), CONTRACT)


@pytest.mark.parametrize("kind", ["csv", "jsonl"])
def test_row_numbers_of_many_splits(spark, tmp_path, kind):
    """As a sequential read counts them, whatever the splits; several files, blank lines and short rows included."""
    want, before = {}, {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for f in "ab":
        lines = [f"{f}{i},{i}.5,1" if i % 7 else f"{f}{i},2" for i in range(3000)]
        if kind == "jsonl":
            lines = [json.dumps(dict(zip(("id", "v", "schema_version"), x.split(",")))) if i % 5 else ("" if i % 2 else "{broken " + x) for i, x in enumerate(lines)]
        (tmp_path / f"{f}.{kind}").write_text("".join(x + "\n" for x in ["id,v,schema_version"] * (kind == "csv") + lines))
        want |= {(f, i + (2 if kind == "csv" else 1)): x for i, x in enumerate(lines) if x}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        raw = readers.raw(spark, str(tmp_path), {**CONTRACT, "format": kind})
        assert raw.select("_file", "_block").distinct().count() > 20
        got = readers.read(spark, str(tmp_path), {**CONTRACT, "format": kind}).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r._file[-len(kind) - 2], r._row) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        line = want[r._file[-len(kind) - 2], r._row]
        assert r._issue in ("MALFORMED_RECORD", "INCONSISTENT_CSV_ROW") or r.id in line.replace('"', "").replace("{id: ", "").split(",")


def test_jsonl(spark, tmp_path):
    f = tmp_path / "d.jsonl"
    f.write_text('{"id": "a", "v": 1.5, "schema_version": "1", "extra": 2}\n\n[1]\n{bad\n{"id": "b", "v": "x"}\n')
    got = sorted(readers.read(spark, str(f), {**CONTRACT, "format": "jsonl"}).collect(), key=lambda r: r._row)
    assert [(r._row, r._issue) for r in got] == [(1, None), (3, "MALFORMED_RECORD"), (4, "MALFORMED_RECORD"), (5, None)]
    assert got[0].v == "1.5" and got[3].v == "x" and got[0]._keys == ["id", "v", "schema_version", "extra"]


def test_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    good = {"files": [{"dataset": "a", "name": "a.csv", "size": 1, "sha256": hashlib.sha256(b"x").hexdigest(), "records": 0}]}
    (tmp_path / "manifest.json").write_text(json.dumps(good))
    loaded = manifest.load(spark, str(tmp_path / "manifest.json"))
    assert manifest.verify(spark, str(tmp_path), loaded).count() == 0
    (tmp_path / "a.csv").write_text("y")
    assert [r.code for r in manifest.verify(spark, str(tmp_path), loaded).collect()] == ["MANIFEST_CHECKSUM_MISMATCH"]
    for text, code in (("{", "MANIFEST_MALFORMED"), ('{"files": [], "files": []}', "MANIFEST_DUPLICATE_ENTRY")):
        (tmp_path / "manifest.json").write_text(text)
        with pytest.raises(manifest.ManifestError) as e:
            manifest.load(spark, str(tmp_path / "manifest.json"))
        assert e.value.code == code
    with pytest.raises(manifest.ManifestError):
        manifest.load(spark, str(tmp_path / "no.json"))
    twice = {"files": [{"dataset": "a", "name": "a.csv"}, {"dataset": "a", "name": "z.csv"}, {"dataset": "q", "name": "q.csv"}]}
    assert manifest.entries(twice, ["a", "b"]) == [("a", "MANIFEST_DUPLICATE_ENTRY"), ("q", "MANIFEST_DATASET_UNEXPECTED"), ("b", "MANIFEST_DATASET_MISSING")]
    found, strange = manifest.discover(spark, str(tmp_path), {"a": {"format": "csv"}})
    assert set(found) == {"a"} and strange == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "b int, a string")
    sinks.write_csv(df, str(tmp_path / "c"), ["a", "b"], ["b"], single=True)
    assert next((tmp_path / "c").glob("part*")).read_text() == "a,b\nx,1\n,2\n"
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    q = df.withColumn("issues", validation.issues(validation.issue(F.col("a").isNull(), "X", "a")))
    sinks.write_quarantine(q, str(tmp_path / "q"), "r1", "d")
    assert spark.read.json(str(tmp_path / "q")).filter("run_id = 'r1'").count() == 2
    assert sinks.write_manifest({"b": 1, "a": 2}, str(tmp_path / "m.json")) == hashlib.sha256((tmp_path / "m.json").read_bytes()).hexdigest()
    assert "| 1 | x |" in sinks.markdown("t", {"rows": df})


def test_generator(spark):
    net = generator.network(spark, 2, 1, 1, 3)
    args = ("2024-01-01 00:00:00", "2024-01-01 06:00:00")
    m = generator.smart_meter_events(spark, net, *args, drop=0.0)
    assert m.count() == 36 and m.select("event_id").distinct().count() == 36
    assert sorted(map(str, m.collect())) == sorted(map(str, generator.smart_meter_events(spark, net, *args, drop=0.0).repartition(3).collect()))
    a = generator.assets(net, "2024-01-01")
    assert generator.substation_events(spark, net, *args).count() == 12 and generator.weather(spark, *args, 2).count() == 12 and a.count() == 12
    assert generator.maintenance(a, args[0]).count() > 0
    assert generator.outages(net, a, args[0], 6, chance=1.0).count() == 2


def test_streams_match_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    src.union(src.limit(50)).repartition(1).write.parquet(str(tmp_path / "in"))
    s = micro.with_event_time(micro.read_stream(spark, str(tmp_path / "in"), src.schema), "ts", "60 days")
    micro.run_once(micro.deduplicated(s, ["event_id"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == src.count()
    ordered = micro.with_event_time(micro.read_stream(spark, str(tmp_path / "in"), src.schema), "ts", "30 minutes")
    micro.run_once(micro.hourly(ordered, "ts", "event_type", "value"), str(tmp_path / "h"), str(tmp_path / "hcp"))
    assert spark.read.parquet(str(tmp_path / "h")).count() > 0
    micro.validated(micro.read_stream(spark, str(tmp_path / "in"), src.schema), lambda b: (b.filter("value > 10"), b.filter("value <= 10")), str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "vcp"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() + spark.read.parquet(str(tmp_path / "no")).count() == src.count() + 50
    state = micro.freshness_state(micro.with_event_time(micro.read_stream(spark, str(tmp_path / "in"), src.schema), "ts"), "event_type", "ts")
    q = state.writeStream.outputMode("update").format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "scp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from fresh").first()[0] == src.count() + 50
