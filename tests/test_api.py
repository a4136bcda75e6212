import json

import pytest
from pyspark.sql import functions as F

from spanmill.functions import folds, record as rec, records as rc
from spanmill.operators import api, lineage as ln, retrieval as rt
from tests_support import entries, sessions


@pytest.fixture(scope="module")
def store(spark):
    rows = [{"id": i, "client": "claude" if i < "c" else "kimi", "cwd": "/x", "date_key": f"2026-08-0{n}", "status": "complete" if n < 3 else "active", "record_count": n, "updated_at": f"2026-08-0{n}T00:00:00Z", "started_at": f"2026-08-0{n}T00:00:00Z", "summary": json.dumps({"total_tokens": 5, "first_user": f"hi {i}"})} for n, i in enumerate("abcd", 1)]
    return sessions(spark, rows)


def test_sessions_view(store):
    v = api.sessions_view(store, limit=2, agent="claude-code")
    assert [r["id"] for r in v["page"].collect()] == ["b", "a"] and v["totals"] == {"sessions": 2, "records": 3, "tokens": 10, "errors": 0} and not v["has_more"]
    assert api.sessions_view(store, limit=1)["has_more"] and v["dates"].count() == 4
    with pytest.raises(ValueError):
        api.stats_view(store, "2026-08-05", "2026-08-01")
    with pytest.raises(ValueError):
        api.stats_view(store, "soon")
    assert api.stats_view(store, "2026-08-02")["totals"].first()["sessions"] == 3


def test_fates(spark, store):
    assert {r["id"]: r["fate"] for r in api.delete_view(store, ["a", "c", "b", "zz", "a", ""], live=["b"]).collect()} == {"a": "deletable", "b": "active", "c": "active", "zz": "missing"}
    live = {r["id"]: (r["record_count"], r["status"]) for r in api.with_live(store, spark.createDataFrame([("a", 9), ("d", 1)], "id string, live_count long")).collect()}
    assert live["a"] == (9, "active") and live["d"] == (4, "active") and live["b"] == (2, "complete")
    assert {r["id"]: (r["total_tokens"], r["first_user"]) for r in api.cached_summary(store).collect()}["a"] == (5, "hi a")


def test_records(spark, store):
    rows = [{"request": {"path": "/v1/messages", "headers": {"authorization": "x"}, "body": {"model": m, "messages": [{"role": "user", "content": f"q{i}"}]}}, "response": {"status": 200, "body": {"usage": {"input_tokens": 1}, "content": [{"type": "text", "text": f"a{i}"}]}}} for i, m in enumerate(["m", "n", "m"])]
    df = spark.createDataFrame([("a", i, json.dumps(r)) for i, r in enumerate(rows)], "session_id string, record_index long, payload string")
    one, page = api.session_view(store, df, "a", 1, 1)
    assert one.count() == 1 and "[REDACTED]" in page.first()["payload"]
    t = api.run_totals(rc.described(df)).first()
    assert (t["api_calls"], t["input_tokens"], t["models_used"], t["status"]) == (3, 3, {"m": 2, "n": 1}, "complete")
    fixed = {r["id"]: r for r in api.repaired_summary(api.cached_summary(store), df).collect()}
    assert (fixed["a"]["first_user"], fixed["a"]["last_response"], fixed["b"]["first_user"]) == ("q0", "a2", "hi b")


def test_memory(spark):
    rows = [(1, "deploy the red service", "s1", "c", "2026-08-01T10:00:00"), (2, "paint the fence", "s2", "c", "2026-08-02T10:00:00"), (3, "deploy blue", "s1", "d", "2026-08-03T10:00:00")]
    m = spark.createDataFrame(rows, "id long, text string, session_id string, client string, seen_at string")
    v = rt.embed(m).select("id", "embedding")
    got = api.kb_recall(m, v, "deploy red", limit=2).collect()
    assert got[0]["id"] == 1 and got[0]["source"] == "2026-08-01 10:00 · c · session s1"
    assert [r["id"] for r in api.kb_search(m, v, "deploy", group="session_id", client="d").collect()] == [3]
    assert api.kb_status(m.select(F.lit("user").alias("role"), F.lit("indexed").alias("state")))["rows"][0]["indexed"] == 3
    e = entries(spark, [{"p": ["a"], "model": "x"}, {"p": ["b"], "model": "y"}, {"p": ["c"], "model": "x"}, {"p": ["d"]}])
    assert [r["idx"] for r in api.diff_candidates(e, "s", 3).collect()] == [2, 0, 1]
    assert ln.pair_calls(spark.createDataFrame([("s", "1", 1), ("s", "1", 2)], "scope string, call_id string, at long"), spark.createDataFrame([("s", "1", 5), ("s", "9", 6)], "scope string, call_id string, at long")).count() == 3


def test_small_readers():
    assert rec.embedder_identity("/c/models--org--name/snapshots/x") == "org/name" and rec.embedder_identity("org/name") == "org/name"
    assert rec.prompt_in_payload('{"query": " find "}') == "find" and rec.prompt_in_payload("{broken") == "{broken"
    assert rec.unique_tools([{"name": "a", "n": 1}, {"name": "b"}, {"name": "a", "n": 2}]) == [{"name": "a", "n": 1}, {"name": "b"}]
    assert rec.display_name({"function": {"name": "f"}}) == "f" and rec.display_name({}) == ""
    r = {"request": {"path": "/v1/messages", "headers": {"X-Codex-App-Session-Id": "app"}, "body": {"messages": [{"role": "user", "content": "one"}, {"role": "assistant", "content": "x"}, {"role": "user", "content": [{"type": "tool_result", "content": "r"}]}]}}}
    assert rec.user_input(r) == ("one", 0, 3) and rec.user_input(r, last=False) == ("one", 0, 3) and rec.app_session(r) == "app"
    decoded = folds.decode_record({"response": {"body": 'x{"role":"assistant"}{"contentBlockIndex":0,"delta":{"text":"hi"}}{"usage":{"inputTokens":2}}{"throttlingException":{"message":"m"}}'}})
    body = decoded["response"]["body"]
    assert body["content"] == [{"type": "text", "text": "hi"}] and body["usage"]["input_tokens"] == 2 and body["error"]["message"] == "m"
    assert folds.decode_record({"response": {"body": {"a": 1}}}) == {"response": {"body": {"a": 1}}}
