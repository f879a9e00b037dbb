"""File sources and sinks round trip; streams give the batch rows, state is bounded, sinks do not repeat batches."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.sources import files
from lorekeep.streaming import streams


def test_export_and_document_import(spark, tmp_path):
    doc = {"version": "1.0", "patterns": [{"problem": "p", "solution": "s", "domain": "rust.async", "tags": ["a"], "reward": 0.5, "reuse_count": 3}, {"problem": "q", "solution": "t", "domain": "go", "tags": [], "reward": 0.7}]}
    (tmp_path / "e.json").write_text(json.dumps(doc, indent=2))
    got = files.import_document(spark, str(tmp_path / "e.json"))
    assert {(r["problem"], r["domain"], r["reuse_count"]) for r in got.collect()} == {("p", "rust.async", 3), ("q", "go", None)}
    files.export_lines(got, str(tmp_path / "out"), gzip=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_seed_import_drops_broken_and_known_lines(spark, tmp_path):
    lines = ['{"problem": "a", "solution": "b", "domain": "x", "tags": [], "reward": 0.1}', "not json", '{"problem": "a", "solution": "b"}', '{"problem": "c", "solution": "d", "reward": 0.2}']
    (tmp_path / "seed.jsonl").write_text("\n".join(lines))
    first = files.import_seed(spark, str(tmp_path / "seed.jsonl"), prefix="qe.")
    assert {r["problem"] for r in first.collect()} == {"a", "c"}
    assert files.import_seed(spark, str(tmp_path / "seed.jsonl"), known=first.where("problem = 'a'")).count() == 1


def test_text_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rs").write_text("fn main() {}\n")
    (tmp_path / "b.txt").write_text("x")
    got = files.text_folder(spark, str(tmp_path), "*.rs").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["text"].rstrip()) for r in got] == [("a.rs", "fn main() {}")]


def test_snapshots_restore_to_a_part(spark, tmp_path):
    p = str(tmp_path / "backup")
    files.snapshot(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, t long"), p, 0)
    files.snapshot(spark.createDataFrame([(1, "c", 2)], "id long, v string, t long"), p, 1)
    files.snapshot(spark.createDataFrame([(2, "d", 3)], "id long, v string, t long"), p, 2)
    state = lambda n: {(r["id"], r["v"]) for r in files.restored(spark, p, "id", "t", n).collect()}
    assert state(0) == {(1, "a"), (2, "b")}
    assert state(1) == {(1, "c"), (2, "b")}
    assert state(2) == {(1, "c"), (2, "d")}


def test_notifications_leave_broken_payloads_out(spark):
    raw = spark.createDataFrame([("a", '{"k": 1}'), ("b", "nope")], "channel string, payload string")
    got = [(r["channel"], r["k"]) for r in files.notifications(raw, "k long").where("k IS NOT NULL").collect()]
    assert got == [("a", 1)]


def test_near_unique_stream_keeps_state_across_batches(spark, tmp_path):
    schema = "key long, id long, ts timestamp, v array<double>"
    rows = [(1, 1, "2024-01-01 00:00:00", [1.0, 0.0]), (1, 2, "2024-01-01 00:01:00", [0.99, 0.01]), (1, 3, "2024-01-01 00:02:00", [0.0, 1.0]), (1, 4, "2024-01-01 00:09:00", [1.0, 0.0]), (2, 5, "2024-01-01 00:01:00", [1.0, 0.0])]
    for k, r in enumerate(rows):
        df = spark.createDataFrame([r], "key long, id long, ts string, v array<double>").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {r["id"] for r in streams.finished(streams.near_unique(stream, "key")).collect()}
    assert got == {1, 3, 4, 5}


def test_sink_writes_each_batch_once(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        streams.into(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: seen.append(b.count()))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20 and sum(seen) == 20


def test_gate_policies(spark):
    df = spark.createDataFrame([(1, "clean"), (2, "mail a@b.org"), (3, 'token = "0123456789abcdef0123456789abcdef"')], "id long, text string")
    gate = lambda policy, n: streams.gated(df, "text", T.redacted(F.col("text")), T.personal_class(F.col("text")), n, policy)
    assert {r["id"] for r in gate("reject", 4).collect()} == {1, 2}
    assert {r["text"] for r in gate("redact", 2).collect()} == {"clean", "mail [EMAIL]", "[SECRET]"}
