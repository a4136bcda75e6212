import gzip
import json
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from spanmill.functions import expansion, records as rc
from spanmill.operators import viewer as vw


def created(i, before=None, generate=None):
    return {"type": "response.created", "response": {"id": i, "previous_response_id": before, "created_at": 10, **({} if generate is None else {"generate": generate})}}


def done(i, text=None, at=12.5, **more):
    items = [{"type": "response.output_item.done", "output_index": 0, "item": {"type": "message", "role": "assistant", "content": text}}] if text else []
    return [*items, {"type": "response.completed", "response": {"id": i, "created_at": 10, "completed_at": at, "model": "g", "output": [], "usage": {"output_tokens": 1 if text else 0}, **more}}]


USER = {"type": "message", "role": "user", "content": "ask"}
NEXT = {"type": "message", "role": "user", "content": "more"}


def test_socket_turns():
    record = {"request_id": "q", "turn": 4, "request": {"path": "/backend/responses", "ws_events": [{"input": [USER]}, {"previous_response_id": "r1", "input": [NEXT]}]}, "response": {"ws_events": [created("r1"), *done("r1", "yes"), created("r2", "r1"), *done("r2", "and"), created("r3")]}}
    turns = expansion.turns([record])
    assert [(t["request_id"], t["turn"], t["duration_ms"], t["response"]["body"]["id"]) for t in turns] == [("q:1", "4.1", 2500, "r1"), ("q:2", "4.2", 2500, "r2")]
    assert [m["content"] for m in turns[1]["request"]["body"]["input"]] == ["ask", "yes", "more"]
    hidden = {"request": {"path": "/responses", "ws_events": [{"generate": False}]}, "response": {"ws_events": [created("r0", generate=False), *done("r0", generate=False)]}}
    assert expansion.turns([hidden]) == []
    assert turns[0]["timestamp"] == "1970-01-01T00:00:10.000Z" and turns[0]["request"]["body"]["model"] == "g"


def direct(i, before, text, **more):
    return {"request": {"path": "/v1/responses", "body": {"previous_response_id": before, "input": [{**USER, "content": text}], **more}}, "response": {"body": {"id": i, "output": [{"type": "message", "role": "assistant", "content": f"answer {text}"}], "usage": {"output_tokens": 1}}}}


def test_direct_history(spark):
    records = [direct("a", None, "1"), direct("b", "a", "2"), direct("c", "b", "3"), direct("d", "lost", "4"), {"request": {"path": "/v1/messages"}}]
    records.insert(1, {"request": {"path": "/v1/responses", "body": {"generate": False, "input": []}}, "response": {"body": {"id": "p", "output": []}}})
    df = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(records)], "session_id string, record_index long, payload string")
    out = [json.loads(r["payload"]) for r in vw.turns(df).orderBy("turn_index").collect()]
    assert len(out) == 5
    assert [m["content"] for m in out[2]["request"]["body"]["input"]] == ["1", "answer 1", "2", "answer 2", "3"]
    assert [m["content"] for m in out[3]["request"]["body"]["input"]] == ["4"]
    loop = expansion.History()
    loop.add("x", "y", [USER], [])
    loop.add("y", "x", [NEXT], [])
    assert loop.up_to("x") == [NEXT, USER]


def test_filters(spark):
    rows = [
        {"turn": "2.10", "request_id": "r", "request": {"path": "/v1/messages?x", "body": {"model": "m", "messages": [{"role": "user", "content": "find NEEDLE"}]}}, "response": {"body": {"content": [{"type": "tool_use", "name": "bash", "input": {"cmd": "ls"}}]}}},
        {"turn": "2.9", "request": {"path": "/v1/messages", "body": {"messages": []}}, "response": {"body": {}}},
        {"turn": 1, "request": {"path": "/other"}, "response": {"status": 404}},
    ]
    df = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(rows)], "session_id string, record_index long, payload string")
    d = rc.described(df).join(df, ["session_id", "record_index"])
    index = lambda x: [r["record_index"] for r in x.collect()]
    assert index(vw.filter_records(d)) == [2, 1, 0]
    assert index(vw.filter_records(d, paths=["/v1/messages"])) == [1, 0]
    assert index(vw.filter_records(d, search="needle")) == [0] and index(vw.filter_records(d, search="cmd:ls")) == [0]
    assert index(vw.filter_records(d, tools=["bash", "x"])) == [0]
    assert [r["tool"] for r in vw.distinct_tools(d).collect()] == ["bash"]
    assert {r["key"] for r in vw.sidebar(d).collect()} == {"r|0", "1", "2"}
    assert [r[0] for r in d.orderBy("record_index").select(vw.is_display_turn(F.col("path"))).collect()] == [True, True, False]
    assert [r["label"] for r in vw.tasks(df).orderBy("record_index").collect()] == ["simple"] * 3
    assert vw.task_of("You are Codex. plan", ["b", "a"]) == ("You are Codex. plan|a,b", "Codex") and vw.task_of("", ["a"])[1] == "1 tools" and vw.task_of("x-anthropic-billing-header: 1\n A long line of prompt text", [])[1] == "A long line of promp"


def test_keeping(spark):
    df = spark.createDataFrame([("h", "/a/b.tgz?x", "application/gzip", "", "GET"), ("h", "/a/b.tgz", "text/html", "npm/10", "GET"), ("h", "/pkg", "application/json; x", "npm/10", "GET"), ("skip.me", "/v1/messages", "", "", "POST"), ("h", "/t:x", "", "", "POST"), ("h", "/tx", None, None, "POST")], "h string, p string, m string, u string, d string")
    got = df.select(vw.skip_record(F.col("h"), F.col("p"), F.col("m"), F.col("u"), F.col("d"), ["skip.me"], ["/t"])).collect()
    assert [r[0] for r in got] == [True, False, True, True, True, False]
    df = spark.createDataFrame([("/v1/messages", None), ("/v1/files/x", '{"messages":[]}'), ("/x", '{"request":{"contents":[]}}'), ("/v1internal:generateContent", None), ("/x", "{}"), (None, None)], "p string, b string")
    assert [r[0] for r in df.select(vw.capture_only(F.col("p"), F.col("b"))).collect()] == [True, False, True, True, False, False]
    body = spark.createDataFrame([('{"previous_response_id":"r","input":[{"type":"function_call_output"}]}',), ('{"previous_response_id":"r","input":[{"role":"user"}]}',)], "b string")
    assert [r[0] is None for r in body.select(vw.continues(F.col("b"))).collect()] == [False, True]


@pytest.mark.parametrize(("pack", "name"), [(gzip.compress, "gzip"), (zlib.compress, "deflate"), (lambda b: zstandard.ZstdCompressor().compress(b), "ZSTD"), (lambda b: b, None)])
def test_bodies(pack, name):
    assert vw.unpack(pack(b"hello"), name) == b"hello"
    assert vw.unpack(b"broken", "gzip") == b"broken"
    assert vw.read_body(b'"{\\"a\\":1}"') == {"a": 1} and vw.read_body(b'"[1]"') == "[1]" and vw.read_body(b"x\xff") == "x�"


def test_images(spark):
    content = [{"type": "text", "text": "look  here"}, {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "AAA"}}]
    rows = [{"request": {"path": "/v1/messages", "body": {"messages": [{"role": "user", "content": content}]}}}] * 2
    df = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(rows)], "session_id string, record_index long, payload string")
    assert [tuple(r) for r in vw.image_registry(df).collect()] == [("s", "look here", ["data:image/png;base64,AAA"])]


def test_prompt_bearing(spark):
    from pyspark.sql import functions as F

    from spanmill.operators import viewer as vw

    yes = ['{"input":"hi"}', '{"input":["hi"]}', '{"input":[{"role":"developer"}]}', '{"input":[{"type":"message","content":null}]}', '{"request":{"messages":[1]}}', '{"system":"false"}', '{"input":[1,{"text":"x"}]}']
    no = [None, "", "broken {", "[]", '"text"', "{}", '{"input":" "}', '{"input":[]}', '{"input":[" ",3,null]}', '{"messages":[]}', '{"system":null}', '{"prompt":"alone"}', '{"input":[{"type":"function_call_output","role":"user"}]}', '{"type":"response.cancel"}']
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(yes + no)], "i int, body string")
    got = [r[0] for r in rows.orderBy("i").select(vw.prompt_bearing(F.col("body"))).collect()]
    assert got == [True] * len(yes) + [False] * len(no)
