import json

import pytest

from spanmill import cli
from spanmill.operators import extract as ex

KEYED = "content_hash string, client string, role string"


def record(n, asked, system="Be brief", answer="An answer of more than twenty characters."):
    request = {"path": "/v1/messages", "body": {"model": "m", "system": system, "messages": [{"role": "user", "content": asked}]}}
    response = {"status": 200, "body": {"content": [{"type": "text", "text": answer}]}}
    return json.dumps({"turn": n, "timestamp": f"2026-08-0{n}T00:00:00Z", "request": request, "response": response})


def tables(spark, sessions):
    ids = spark.createDataFrame([(i, c) for i, c, _ in sessions], "id string, client string")
    rows = [(i, n, p) for i, _, payloads in sessions for n, p in enumerate(payloads)]
    return ids, spark.createDataFrame(rows, "session_id string, record_index long, payload string")


SESSIONS = [
    ("a", "x", [record(1, "the red door")]),
    ("b", "x", [record(2, "the red door"), "broken {"]),
    ("c", None, [record(3, "the blue door", system="Be long")]),
    ("d", "x", []),
    (None, "x", []),
]


def state(spark, folder):
    return {n: sorted(tuple(r) for r in ex.read(spark, folder, n).collect()) for n in ex.TABLES}


def test_runs_take_only_what_is_new(spark, tmp_path):
    folder = str(tmp_path / "base")
    assert ex.extract(*tables(spark, []), folder) == {"sessions": 0, "user": 0, "assistant": 0, "prompts": 0}
    assert ex.last_run(spark, folder) == -1
    assert ex.extract(*tables(spark, SESSIONS[:1]), folder) == {"sessions": 1, "user": 1, "assistant": 1, "prompts": 1}
    # The same session again, and one with the same texts: no text is new, but it is seen in two sessions.
    assert ex.extract(*tables(spark, SESSIONS), folder, limit=1) == {"sessions": 1, "user": 0, "assistant": 0, "prompts": 0}
    assert ex.extract(*tables(spark, SESSIONS), folder) == {"sessions": 2, "user": 1, "assistant": 1, "prompts": 1}
    after = state(spark, folder)
    assert ex.extract(*tables(spark, SESSIONS), folder)["sessions"] == 0 and state(spark, folder) == after
    assert [(m[1], m[2], m[3], m[8]) for m in sorted(after["messages"], key=lambda m: (m[3], m[2]))] == [
        ("x", "assistant", "a", "An answer of more than twenty characters."), ("x", "user", "a", "the red door"),
        ("unknown", "assistant", "c", "An answer of more than twenty characters."), ("unknown", "user", "c", "the blue door"),
    ]
    assert sorted((s[1], s[2], s[3]) for s in after["seen"]) == [
        ("unknown", "assistant", "c"), ("unknown", "user", "c"),
        ("x", "assistant", "a"), ("x", "assistant", "b"), ("x", "user", "a"), ("x", "user", "b"),
    ]
    assert [(s[0], s[5]) for s in after["sources"]] == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]
    assert sorted(r["session_count"] for r in ex.versions(spark, folder).collect()) == [1, 2]


@pytest.mark.parametrize("stop", ["seen", "sources"])
def test_an_interrupted_run_is_done_again(spark, tmp_path, monkeypatch, stop):
    from pyspark.sql import DataFrameWriter

    once, twice = str(tmp_path / "once"), str(tmp_path / "twice")
    for folder in (once, twice):
        ex.extract(*tables(spark, SESSIONS[:1]), folder)
    ex.extract(*tables(spark, SESSIONS), once)
    write = DataFrameWriter.parquet

    def killed(self, path, *args, **more):
        if f"/{stop}/run=1" in path:
            raise KeyboardInterrupt
        return write(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", killed)
    before = state(spark, twice)
    with pytest.raises(KeyboardInterrupt):
        ex.extract(*tables(spark, SESSIONS), twice)
    assert state(spark, twice) == before
    monkeypatch.undo()
    ex.extract(*tables(spark, SESSIONS), twice)
    assert state(spark, twice) == state(spark, once)


def test_purged_texts_stay_out(spark, tmp_path):
    folder = str(tmp_path / "base")
    ex.extract(*tables(spark, SESSIONS[:1]), folder)
    digest = ex.read(spark, folder, "messages").where("role = 'user'").first()["content_hash"]
    stones = spark.createDataFrame([(digest, "x", "user")], KEYED)
    other = str(tmp_path / "other")
    assert ex.extract(*tables(spark, SESSIONS), other, stones) == {"sessions": 4, "user": 1, "assistant": 2, "prompts": 2}
    assert ex.read(spark, other, "seen").where(f"content_hash = '{digest}'").count() == 0


def test_command(spark, tmp_path, capsys):
    base = str(tmp_path / "base")
    (tmp_path / "t1.jsonl").write_text(SESSIONS[0][2][0])
    run = lambda: cli.main(["extract", str(tmp_path / "t*.jsonl"), base, "--client", "x"], spark)
    assert run() == 0 and "sessions=1  user=1  assistant=1  prompts=1" in capsys.readouterr().out
    (tmp_path / "t2.jsonl").write_text(SESSIONS[2][2][0])
    assert run() == 0 and "sessions=1  user=1  assistant=0  prompts=1" in capsys.readouterr().out
    assert run() == 1 and ex.last_run(spark, base) == 1
