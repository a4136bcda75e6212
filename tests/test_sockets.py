import json
import random
from datetime import datetime, timedelta

from spanmill.sources import sockets


def frames_of(rng, connection, sent):
    """Frames of messages (sender, text), cut at random bytes, with pings between the parts."""
    out = []
    for sender, text in sent:
        data, at = text.encode(), 0
        while True:
            n = rng.randint(1, 40)
            piece, end = data[at : at + n], at + n >= len(data)
            out.append((connection, len(out), sender, 1 if at == 0 else 0, end, piece))
            at += n
            if end:
                break
            if rng.random() < 0.3:
                out.append((connection, len(out), rng.choice(["client", "server"]), 9, True, b"ping"))
    return out


def ask(text):
    return ("client", json.dumps({"type": "response.create", "input": [{"role": "user", "content": text}]}, ensure_ascii=False))


def tell(kind, rid=None, **more):
    return ("server", json.dumps({"type": kind, **({"response": {"id": rid, **more}} if rid else {})}, ensure_ascii=False))


SENT = [
    ask("grün 日本 🙂"), tell("response.created", "a"), tell("response.completed", "a", output=[]),
    ask("waits"), tell("response.completed", "a", output=[]), tell("note"), tell("response.done", "a"), tell("response.done", "b"),
    ("server", "no json"), ("client", "[1]"), tell("response.completed"), tell("response.completed"), ask("left over"),
]
WANT = [
    (1, [SENT[0]], [SENT[1], SENT[2]]),
    (2, [], [SENT[5]]),
    (3, [SENT[3]], [SENT[7]]),
    (4, [SENT[9]], [SENT[8], SENT[10]]),
    (5, [SENT[12]], []),
]


def read(rows):
    return sorted((r["connection"], r["number"], r["payload"]) for r in rows)


def want(connection):
    return [(connection, n, sockets.record(connection, n, [t for _, t in asked], [t for _, t in told])) for n, asked, told in WANT]


def table(spark, rows, start=datetime(2026, 8, 4)):
    timed = [(c, n, start + timedelta(seconds=n or 0), *rest) for c, n, *rest in rows]
    return spark.createDataFrame(timed, sockets.FRAMES)


def test_frames_cut_anywhere_give_the_records(spark):
    rng = random.Random(5)
    rows = [f for c in ("x", "y", "z") for f in frames_of(rng, c, SENT)]
    mixed = rows + rng.sample(rows, 40)  # some frames twice
    rng.shuffle(mixed)
    for span in (7, sockets.SPAN):  # a connection over many spans, and in one
        assert read(sockets.records(table(spark, mixed), span=span).collect()) == want("x") + want("y") + want("z")


def test_record_folds_its_messages():
    first = json.loads(want("x")[0][2])
    assert first["request_id"] == "x" and first["turn"] == 1 and first["request"]["body"]["input"][0]["content"] == "grün 日本 🙂"
    assert first["response"]["body"]["id"] == "a" and len(first["response"]["ws_events"]) == 2
    fourth = json.loads(want("x")[3][2])
    assert fourth["request_id"] == "x_4" and fourth["turn"] == "1.4" and fourth["response"]["ws_events"][0] == {"raw": "no json"}
    assert fourth["request"]["ws_events"] == [{"raw": [1]}]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(6)
    rows = [f for c in ("x", "y") for f in frames_of(rng, c, SENT)]
    rows.append(("x", 1000, "client", 8, True, b""))  # y is not closed, but quiet for long
    rows.append(("z", 9000, "client", 1, True, b"{}"))
    source, out, marks = (str(tmp_path / n) for n in ("frames", "records", "marks"))
    cutoff = [0, 9, 30, 31, 5000, 9001]
    for low, high in zip(cutoff, cutoff[1:]):  # growing input: a message may lie in several files
        table(spark, [f for f in rows if low <= f[1] < high]).coalesce(1).write.mode("append").parquet(source)
        stream = sockets.record_stream(spark.readStream.schema(sockets.FRAMES).parquet(source))
        stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()
    assert read(spark.read.parquet(out).collect()) == want("x") + want("y")


def test_odd_frames(spark):
    done = tell("response.completed", "r")[1].encode()
    rows = [
        (None, 0, "server", 1, True, done), ("c", None, "server", 1, True, done), ("c", 1, None, 1, True, done),
        ("c", 2, "server", None, True, done), ("c", 3, "other", 1, True, done),
        ("c", 4, "server", 0, True, done),  # a part of no message
        ("c", 5, "server", 2, True, done),  # binary
        ("c", 6, "client", 1, None, None),  # empty, and final
        ("c", 7, "client", 1, True, b"\xff\xfe"),
        ("c", 8, "server", 1, None, done), ("c", 9, "server", 0, True, b"after the end"),
        ("c", 10, "client", 1, False, b"never ends"),
    ]
    got = sockets.records(table(spark, rows)).collect()
    assert [(r["connection"], r["number"]) for r in got] == [("c", 1)]
    payload = json.loads(got[0]["payload"])
    assert payload["request"]["ws_events"] == [{"raw": ""}, {"raw": "��"}] and payload["request"]["body"] == {"raw": "��"}
    assert len(payload["response"]["ws_events"]) == 1
    assert sockets.records(table(spark, [])).count() == 0
