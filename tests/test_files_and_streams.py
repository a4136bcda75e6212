import json
import os
import random

import pytest
from pyspark.sql import functions as F

from spanmill.functions import folds
from spanmill.sources import readers, sinks
from spanmill.streaming import jobs

RECORDS = [{"turn": i, "timestamp": f"2026-08-04T10:0{i}:00Z", "capture": {"client": "codex"}, "request": {"path": "/v1/responses", "body": {"model": "g", "instructions": "long words " * 100, "input": [{"role": "user", "content": f"question {i}"}]}}, "response": {"status": 200, "body": {"output": [{"type": "message", "content": [{"type": "output_text", "text": f"answer {i}"}]}], "usage": {"input_tokens": 2, "output_tokens": 1}}}} for i in range(3)]


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def lines(rows):
    return "\n".join(json.dumps(r) for r in rows)


def test_readers_and_sinks(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/in/a.jsonl", lines(RECORDS) + "\n\nbroken {\n[1]\n")
    assert readers.read_jsonl(spark, f"{root}/in/a.jsonl").count() == 3
    df = readers.read_traces(spark, f"{root}/in/a.jsonl").withColumn("session_id", F.lit("s"))
    assert [json.loads(r["payload"]) for r in df.orderBy("record_index").collect()] == RECORDS
    bundle = sinks.as_compact(df).first()["value"]
    assert len(bundle) < 0.8 * len(lines(RECORDS))
    write(f"{root}/in/b.json", bundle)
    write(f"{root}/in/c.json", json.dumps(RECORDS))
    for name in "bc":
        again = readers.read_traces(spark, f"{root}/in/{name}.json")
        assert [json.loads(r["payload"]) for r in again.orderBy("record_index").collect()] == RECORDS
    write(f"{root}/in/d.json", bundle.replace('"version":1,"record_count"', '"version":9,"record_count"'))
    with pytest.raises(Exception, match="version"):
        readers.read_traces(spark, f"{root}/in/d.json").count()
    assert [json.loads(r["value"]) for r in sinks.as_jsonl(df).collect()] == RECORDS
    text = sinks.as_markdown(df).first()["value"]
    assert "- Input tokens: 6" in text and "question 2" in text and "answer 0" in text
    turns = json.loads(sinks.as_json(df).first()["value"])
    assert len(turns) == 3 and turns[0]["usage"]["output_tokens"] == 1 and "error" not in turns[0]
    sinks.export(df, path=f"{root}/out.md")
    assert "# Trace" in "\n".join(r[0] for r in spark.read.text(f"{root}/out.md").collect())
    with pytest.raises(ValueError):
        sinks.export(df, "odd")


def test_directory(spark, tmp_path):
    root = str(tmp_path / "old")
    write(f"{root}/2026-08-04/trace_1.jsonl", lines(RECORDS))
    write(f"{root}/trace_2.jsonl", lines([{"turn": 1, "request": {}}]))
    write(f"{root}/.x-manifest.json", json.dumps({"traces": [{"client": "kimi", "created_at": "2026-01-01T00:00:00Z", "files": ["2026-08-04\\trace_1.jsonl"]}]}))
    write(f"{root}/2026-08-04/trace_1.log", "10:00:01 first\n\nsecond\n")
    sessions, records = readers.read_directory(spark, root, "k")
    got = {r["legacy_rel_path"]: r for r in sessions.collect()}
    assert {k: (v["date_key"], v["record_count"]) for k, v in got.items()} == {"2026-08-04/trace_1.jsonl": ("2026-08-04", 3), "trace_2.jsonl": ("legacy", 1)}
    assert got["2026-08-04/trace_1.jsonl"]["started_at"] == "2026-08-04T10:00:00Z" and records.count() == 4
    again, _ = readers.read_directory(spark, root, "k", sessions.where("date_key = 'legacy'"))
    assert again.count() == 1
    logs = readers.read_logs(spark, f"{root}/2026-08-04/trace_1.log").orderBy("line_no").collect()
    assert [(r["logged_at"], r["message"]) for r in logs] == [("10:00:01", "first"), ("", "second")]


def test_transcripts(spark, tmp_path):
    root = str(tmp_path / "p")
    rows = [{"role": "assistant", "message": {"content": "lost"}}, {"role": "user", "message": {"content": [{"type": "text", "text": "<user_query>hi</user_query>"}]}}, {"role": "assistant", "message": {"content": [{"type": "text", "text": "yo"}, {"type": "tool_use", "name": "t"}]}}, {"role": "assistant", "content": "more"}, {"role": "system", "content": "x"}]
    write(f"{root}/proj/agent-transcripts/s1/t.jsonl", lines(rows))
    got = readers.read_transcripts(spark, root).orderBy("turn", "step").collect()
    assert [(r["turn"], r["step"], r["role"], r["text"]) for r in got] == [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "assistant", "more")]
    assert got[1]["record_path"] == "/cursor/transcript/s1/turn/1/step/1" and got[1]["tools"] == ["t"]


EVENTS = [("a", 0, "message_start", '{"message":{"content":[]}}'), ("a", 1, "content_block_delta", '{"index":0,"delta":{"type":"text_delta","text":"hel"}}'), ("b", 0, "response.created", '{"response":{"id":"r"}}'), ("a", 2, "content_block_delta", '{"index":0,"delta":{"type":"text_delta","text":"lo"}}'), ("b", 1, "response.completed", '{"response":{"id":"r","status":"completed"}}'), ("a", 3, "message_stop", "{}")]


def test_stream_equals_batch(spark, tmp_path):
    schema = "request_id string, seq long, event string, data string"
    batch = {r["key"]: json.loads(r["document"]) for r in jobs.fold_batch(spark.createDataFrame(EVENTS, schema)).collect()}
    for i in range(2):
        spark.createDataFrame(EVENTS[i * 3 : i * 3 + 3], schema).coalesce(1).write.mode("append").json(str(tmp_path / "ev"))
    out: list = []
    stream = jobs.fold_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "ev")))
    q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: out.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["key"]: json.loads(r["document"]) for r in out} == batch and all(r["complete"] for r in out)
    assert batch["a"]["content"] == [{"type": "text", "text": "hello"}]


def test_folds_of_many_requests_in_small_batches(spark):
    """Requests that go over several Arrow batches and tasks, with and without a document, one without a key."""
    text = lambda k, i: f'{{"index":0,"delta":{{"type":"text_delta","text":"{k}{i} "}}}}'
    sizes = {f"k{n}": n % 23 for n in range(60)} | {"long": 500, None: 4}
    rows = [(k, i + 1, "content_block_delta", text(k, i)) for k, size in sizes.items() for i in range(size)] + [(k, 0, "message_start", '{"message":{"content":[]}}') for k in sizes if k != "k7"]
    random.Random(5).shuffle(rows)
    events = spark.createDataFrame(rows, "request_id string, seq long, event string, data string").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["key"]: r["document"] and json.loads(r["document"]) for r in jobs.fold_batch(events).collect()}
        assert jobs.fold_batch(events.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == set(sizes)
    for k, size in sizes.items():
        want = folds.fold_events([("message_start", {"message": {"content": []}})] * (k != "k7") + [("content_block_delta", json.loads(text(k, i))) for i in range(size)])
        assert got[k] == want


def test_liveness_and_merge(spark, tmp_path):
    schema = "session_id string, payload string, failed boolean"
    spark.createDataFrame([("x", "p", False), ("x", "q", False), ("y", None, False)], schema).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    out: list = []
    q = jobs.liveness(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).foreachBatch(lambda df, n: out.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["session_id"], r["status"], r["record_count"]) for r in out} >= {("x", "active", 2), ("y", "active", 0)}
    publish = jobs.merge_new(str(tmp_path / "kb"), ["session_id"], "batch_no")
    batch = spark.createDataFrame([("x", "p", False)], schema)
    publish(batch, 0)
    publish(batch, 0)
    publish(batch.union(spark.createDataFrame([("z", "p", False)], schema)), 1)
    assert sorted(r["session_id"] for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "kb")).collect()) == ["x", "z"]
    body = spark.createDataFrame([("k", 'data: {"candidates":[]}\n\n')], "request_id string, body string")
    assert jobs.sse_events(body).first()["event"] == "message"


def test_consumers_of_one_log(spark, tmp_path):
    """A steady, a slow and a late consumer each see every row once; one that fails sees its batch again under the same number."""
    log, made = str(tmp_path / "log"), 0
    got = {name: {} for name in ("steady", "slow", "late", "failing")}
    calls = {"failing": 0}

    def consumer(name, files=100):
        def publish(batch, number):
            calls["failing"] += name == "failing"
            rows = [r["id"] for r in batch.collect()]
            if name == "failing" and calls["failing"] == 1:
                raise ValueError("down")
            got[name][number] = rows

        return jobs.follow(spark, log, "id long", str(tmp_path / name), publish, files)

    for step in range(3):
        spark.range(made, made + 40).repartition(4).write.mode("append").parquet(log)
        made += 40
        assert consumer("steady") == 40
        if step == 1:
            assert consumer("slow", files=1) == 80
        if step == 0:
            with pytest.raises(Exception):
                consumer("failing")
    assert consumer("late") == 120 and consumer("late") == 0
    assert consumer("slow", files=3) == 40 and consumer("failing") == 120
    for name, batches in got.items():
        assert sorted(i for rows in batches.values() for i in rows) == list(range(120)), name
    assert len(got["steady"]) == 3 and max(map(len, got["slow"].values())) <= 40 and 0 in got["failing"]
