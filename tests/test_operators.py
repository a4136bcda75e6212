import json

import pytest
from pyspark.sql import functions as F

from spanmill.functions import record as rec
from spanmill.functions import records as rc
from spanmill.operators import blobs, index as ix, knowledge as kb, lineage as ln, retrieval as rt, sessions as ss, stats as st
from spanmill.schemas import MESSAGES
from tests_support import entries, sessions


@pytest.fixture(scope="module")
def seed(spark):
    """Three sessions in both shapes of summary."""
    return sessions(
        spark,
        [
            {"id": "a", "client": "codex", "cwd": "/home/ana", "date_key": "2026-03-10", "status": "complete", "record_count": 5, "updated_at": "2026-03-10T23:30:00+05:00", "started_at": "2026-03-10T08:00:00Z", "summary": json.dumps({"input_tokens": 40, "output_tokens": 12, "cache_read_tokens": 7, "models_used": {"o-x": 5}})},
            {"id": "b", "client": "qoder", "cwd": "/home/bo", "date_key": "2026-03-11", "status": "complete", "record_count": 2, "updated_at": "2026-03-10T19:00:00Z", "started_at": "2026-03-10T18:00:00Z", "summary": json.dumps({"input_tokens": 9, "output_tokens": 4, "model": "q1", "has_error": True})},
            {"id": "c", "client": "codex", "cwd": None, "date_key": "2026-03-11", "status": "active", "record_count": 0, "updated_at": "never", "started_at": None, "summary": "not json"},
        ],
    )


def test_stats(spark, seed):
    s = st.with_summary(seed)
    t = st.totals(s).first().asDict()
    assert (t["sessions"], t["records"], t["input_tokens"], t["output_tokens"], t["cache_read_tokens"], t["errors"]) == (3, 7, 49, 16, 7, 1)
    assert [tuple(r) for r in st.by_day(s).collect()] == [("2026-03-10", 1, 59), ("2026-03-11", 2, 13)]
    assert [tuple(r) for r in st.by(s, "client", "client").collect()] == [("codex", 2, 59), ("qoder", 1, 13)]
    assert ("", 1, 0) in [tuple(r) for r in st.by(s, "cwd", "project").collect()]
    assert [tuple(r)[::2] for r in st.by_model(s).collect()] == [("o-x", 59), ("q1", 13)]
    assert [st.in_dates(s, a, b).count() for a, b in (("2026-03-10", "2026-03-10"), ("2026-03-11", None), (None, "2026-03-10"))] == [1, 2, 1]
    empty = st.totals(s.where("false")).first()
    assert empty["sessions"] == 0 and empty["input_tokens"] == 0


def test_listing(spark, seed):
    assert [r["id"] for r in ss.page(seed).collect()] == ["b", "a", "c"]
    assert [r["id"] for r in ss.page(seed, 1, 1).collect()] == ["a"]
    assert ss.clamp_page("x", -3) == (100, 0) and ss.clamp_page(9999, "2") == (500, 2) and ss.clamp_page(0) == (1, 0)
    assert ss.filter_sessions(seed, ss.build_query(date="nonsense", status="odd")).count() == 3
    assert [r["id"] for r in ss.filter_sessions(seed, ss.build_query(search="Q1")).collect()] == ["b"]
    assert {r["id"] for r in ss.filter_sessions(seed, ss.build_query(agent="codex")).collect()} == {"a", "c"}
    assert ss.resolve_agent("blue-bird", ["Blue Bird"]) == (("Blue Bird",), ("Blue Bird",)) and ss.resolve_agent("all") == ((), ())
    assert [tuple(r) for r in st.fold_buckets(st.agent_buckets(seed), rec.CLIENT_LABELS).orderBy("key").collect()] == [("codex", "Codex", 2), ("qoder", "Qoder", 1)]


def test_liveness(spark, seed):
    as_of = F.lit("2026-03-10T20:00:00Z").cast("timestamp")
    status = lambda df: {r["id"]: r["status"] for r in df.collect()}
    assert status(ss.finalize_stale(seed, as_of))["c"] == "empty"
    assert status(ss.finalize_stale(seed, as_of, protected=["c"]))["c"] == "active"
    fresh = seed.withColumn("status", F.lit("active")).withColumn("record_count", F.lit(1))
    assert status(ss.finalize_stale(fresh, as_of)) == {"a": "active", "b": "active", "c": "complete"}
    assert {r["id"] for r in ss.retention_victims(seed, 1, as_of).collect()} == {"a", "c"}
    left, _, report = ss.delete_sessions(seed, spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert left.count() == 2 and {tuple(r) for r in report.collect()} == {("a", True), ("zz", False)}
    assert {r["id"]: r["change"] for r in ss.changes(ss.snapshot(seed.where("id <> 'a'")), ss.snapshot(seed.where("id <> 'b'"))).collect()} == {"a": "added", "b": "removed"}


MESSAGE = MESSAGES + ", seen_at long"


def messages(spark, rows):
    return spark.createDataFrame([(s, 0, 0, c, "m", role, None, h, h, t) for s, c, role, h, t in rows], MESSAGE)


def test_messages(spark):
    m = messages(spark, [("s1", "c", "user", "h", 5), ("s2", "c", "user", "h", 7), ("s3", "c", "user", "h", 6), ("s1", "d", "user", "h", 1), ("s2", "c", "user", "g", 9)])
    unique, seen = kb.unique_messages(m, ["seen_at"]), kb.occurrences(m)
    assert {(r["content_hash"], r["client"], r["session_id"], r["last_seen"]) for r in unique.collect()} == {("h", "c", "s1", 7), ("h", "d", "s1", 1), ("g", "c", "s2", 9)}
    kept, left = kb.delete_session(unique, seen, spark.createDataFrame([("s1",)], "session_id string"))
    assert {(r["content_hash"], r["client"], r["session_id"]) for r in kept.collect()} == {("h", "c", "s3"), ("g", "c", "s2")}
    assert left.count() == 3
    purged = spark.createDataFrame([], "content_hash string, client string, role string")
    after, stones = kb.purge(m, purged, "h")
    assert after.count() == 1 and stones.count() == 2
    assert kb.purge(m, purged, "unseen", "c", "user")[1].count() == 1
    assert kb.unpurge(stones, "h").count() == 0
    last = kb.last_messages(m.where("client = 'c'"), 1).collect()
    assert {(r["session_id"], r["content_hash"]) for r in last} == {("s1", "h"), ("s2", "g"), ("s3", "h")}
    over = kb.recent_overview(m, m, 2, 2).collect()
    assert [r["session_id"] for r in over] == ["s2", "s3"] and [x["text"] for x in over[0]["messages"]] == ["h", "g"]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "river delta gauge station"), (2, "paint quiet rooms"), (3, "Delta élan oooo green_house"), (4, None)], "id long, text string")
    assert rt.match_expression('如何更新 "index" (每日备份)!') == "如何更新 OR index OR 每日备份" and rt.match_expression("?? --") == ""
    assert {r["id"] for r in rt.bm25_words(docs, "delta river").collect()} == {1, 3}
    assert rt.bm25_words(docs, "green_house").count() == 1 and rt.bm25_words(docs, "elan").count() == 1 and rt.bm25_words(docs, "élan").count() == 0
    assert rt.bm25_trigrams(docs, "elan").count() == 0 and rt.bm25_trigrams(docs, "de").count() == 0 and rt.bm25_trigrams(docs, "elta").count() == 2
    assert rt.bm25_words(docs, "delta AND quiet").count() == 0 and rt.bm25_words(docs, "delta and").count() == 2
    overlapping = rt.bm25_trigrams(docs, "ooo").first()["score"]
    n, dl, avg, tf = 4, 25, (23 + 15 + 25 + 0) / 4, 2
    import math

    assert overlapping == pytest.approx(math.log((n - 1 + 0.5) / 1.5) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)))
    a, b = (spark.createDataFrame(x, "id long, rank int") for x in ([(1, 1), (2, 2)], [(2, 1), (3, 2)]))
    assert [r["id"] for r in rt.rrf([("a", a, 1.0), ("b", b, 1.0)]).collect()] == [2, 1, 3]
    assert [r["id"] for r in rt.rrf([("a", a, 0.0), ("b", b, 1.0)]).collect()] == [2, 3]
    assert rt.parse_weights("1,2,0") == (1, 2, 0) and rt.parse_weights("1,-2,0") == (1, 1, 1) and rt.parse_weights(None) == (1, 1, 1)
    vectors = rt.embed(docs.fillna("")).select("id", "embedding")
    probe = rt.hash_embedder(["delta river"])[0].tolist()
    assert rt.vector_topk(vectors, probe).first()["id"] == 1
    found = rt.search(docs.withColumn("client", F.lit("x")), vectors, "delta river", probe, "client").collect()
    assert found[0]["id"] == 1 and found[0]["score"] > 0.5 and found[0]["reranked"]

    def broken(query, texts):
        raise RuntimeError("no model")

    assert not rt.search(docs.withColumn("client", F.lit("x")), vectors, "delta", probe, "client", reranker=broken).first()["reranked"]
    assert rt.search(docs.withColumn("client", F.lit("x")), vectors, "  ", probe, "client").count() == 0
    assert rt.embed(docs, embedder=broken.__get__(1)).where("state = 'failed'").count() == 4
    with pytest.raises(ValueError):
        rt.check_identity(("a", 16), ("b", 16))
    hits = spark.createDataFrame([(1, "k", "t", "x", 0.9, 1, 2), (2, "k", "t", "x", 0.5, 9, 3), (3, "k", "t", "y", 0.1, 1, 1)], "id long, kind string, title string, text string, score double, last_seen long, session_count long")
    assert {(r["id"], r["session_count"]) for r in rt.merge_across(hits).collect()} == {(1, 5), (3, 1)}
    assert [r["id"] for r in rt.relative_floor(hits, 0.3).collect()] == [1]


def test_search_folds_and_floors(spark):
    """Equal chunks of several versions are one hit, whose group counts the others' sessions; each kind of score has its floor."""
    rows = [
        (1, "amber gate", "v1", "k", "T", 5, 3), (2, "amber gate", "v2", "k", "T", 9, 4), (3, "amber", "v2", "k", "U", 9, 4),
        (4, "gate of stone", "v3", "k", "V", 1, 2), (5, "unrelated words", "v4", "k", "W", 1, 1),
    ]
    docs = spark.createDataFrame(rows, "id long, text string, version string, kind string, title string, last_seen long, session_count long")
    vectors = rt.embed(docs).select("id", "embedding")
    probe = rt.hash_embedder(["amber gate"])[0].tolist()
    found = {r["id"]: r for r in rt.search(docs, vectors, "amber gate", probe, "version", min_score=0.5).collect()}
    assert set(found) == {2} and found[2]["session_count"] == 4 + 3 and found[2]["reranked"]  # 0.5 itself does not exceed the floor
    found = {r["id"]: r for r in rt.search(docs, vectors, "amber gate", probe, "version", min_score=0.4).collect()}
    assert set(found) == {2, 3, 4} and found[3]["session_count"] == 7 and found[4]["session_count"] == 2
    assert {r["id"] for r in rt.search(docs, vectors, "amber gate", probe, "version", min_score=0.4, fold=False).collect()} == {1, 2, 3, 4}

    def broken(query, texts):
        raise RuntimeError("no model")

    for reranker in (None, broken):
        found = rt.search(docs, vectors, "amber gate", probe, "version", reranker=reranker).collect()
        assert {r["id"] for r in found} == {2} and not found[0]["reranked"]
        assert len(rt.search(docs, vectors, "amber gate", probe, "version", reranker=reranker, delta=1.0).collect()) >= 3
    one = rt.search(docs, vectors, "amber gate", probe, "version", min_score=0.4, within=F.col("version") == "v1").collect()
    assert [r["id"] for r in one] == [1]


def test_stored_index_agrees_with_the_scan(spark, tmp_path):
    texts = ["Thin ice, thin_ice", "thick ice aaaa", None, "", "the ice is thin; ICE thin ice", "élan ice", "aaa"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = ix.build_index(docs, str(tmp_path / "index"))
    near = lambda frame: sorted((r["id"], round(r["score"], 9)) for r in frame.collect())
    for q in ("thin ice", "thin_ice aaa", "elan", "zzz", "", "ice AND thin", "aaaa"):
        assert near(rt.indexed_words(index, q)) == near(rt.bm25_words(docs, q)), q
        assert near(rt.indexed_trigrams(index, q)) == near(rt.bm25_trigrams(docs, q)), q


def brute_prefix(rows):
    out = {}
    for i, r in enumerate(rows):
        fits = [(len(q["p"]), j) for j, q in enumerate(rows[:i]) if q["p"] and r["p"][: len(q["p"])] == q["p"]]
        if fits:
            out[i] = max(fits)[1]
    return out


def test_prefixes_of_all_records(spark, tmp_path):
    from datetime import datetime, timedelta

    from spanmill.plans import catalogue

    n = 90
    made = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), 1, "view", 1.5, '{"k": 1}') for i in range(n)]
    spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    p = [[0 if k == 0 else (k * 7 + i // 8) % 3 for k in range(i % 4 + 1)] for i in range(n)]
    parent, child = {}, {}
    for i in range(n):
        before = [(len(p[j]), j) for j in range(i) if p[i][: len(p[j])] == p[j]]
        after = [(len(p[j]), j) for j in range(i + 1, n) if p[j][: len(p[i])] == p[i]]
        parent |= {i: max(before)[1]} if before else {}
        child |= {i: min(after)[1]} if after else {}
    assert {r["idx"]: r["parent"] for r in catalogue.QUERIES["prefix_parent"](spark, str(tmp_path)).collect()} == parent
    assert {r["idx"]: r["child"] for r in catalogue.QUERIES["prefix_child"](spark, str(tmp_path)).collect()} == child


def test_indexed_answers_keeps_long_ones(spark, tmp_path):
    from spanmill.plans import catalogue

    long = "A sentence of a long answer, number. " * 200
    spark.createDataFrame([(1, 0, "user", "what is it?"), (1, 1, "assistant", long), (1, 2, "assistant", long[:100])], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalogue.QUERIES["indexed_answers"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("1", 1, "assistant"), ("1", 2, "assistant")]


def test_lineage(spark):
    rows = [{"p": ["a"]}, {"p": ["a", "b"]}, {"p": ["x"]}, {"p": ["a", "b", "c"]}, {"p": ["a", "b"]}, {"p": []}, {"p": ["x", "y"], "prev": "r1", "rid": "r2"}, {"p": ["q"], "thread": "t"}, {"p": ["z"], "thread": "t", "model": "n"}, {"p": ["only"], "model": "k"}]
    e = entries(spark, rows)
    assert {r["idx"]: r["parent"] for r in ln.prefix_parent(e).collect()} == brute_prefix(rows)
    child = {}
    for i, r in enumerate(rows):
        fits = [(len(q["p"]), j) for j, q in enumerate(rows) if j > i and r["p"] and q["p"][: len(r["p"])] == r["p"]]
        if fits:
            child[i] = min(fits)[1]
    assert {r["idx"]: r["child"] for r in ln.prefix_child(e).collect()} == child
    got = {r["idx"]: (r["parent"], r["how"]) for r in ln.parents(e).collect()}
    assert got[8] == (7, "thread") and got[3] == (1, "prefix") and got[2] == (1, "model") and got[9] == (None, None) and got[0] == (None, None)
    linked = entries(spark, [{"p": ["a"], "rid": "r1"}, {"p": ["a"], "rid": "r1"}, {"p": ["b"], "prev": "r1"}])
    assert {r["idx"]: r["parent"] for r in ln.by_response(linked).collect()} == {2: 1}


@pytest.mark.parametrize("shape", ["text", "blocks", "parts"])
def test_parents_compare_messages_to_their_end(spark, monkeypatch, shape):
    """FINDINGS_r04 F1: messages were compared by their first 500 characters."""
    from spanmill.plans import catalogue, traffic

    long = "A paragraph that all requests begin with. " * 50
    said = [[long + "a"], [long + "b"], [long + "a", "yes", "go on"], [long + "c", "no", "why"], [long + "b", "yes \ud83d", "go on"]]
    made = {
        "text": lambda x, last: {"role": "user", "content": x},
        "blocks": lambda x, last: {"role": "user", "content": [{"type": "text", "text": x} | ({"cache_control": {"type": "ephemeral"}} if last else {})]},
        "parts": lambda x, last: {"role": "user", "parts": [{"text": x}]},
    }[shape]
    body = lambda texts: {"model": "m", "contents" if shape == "parts" else "messages": [made(x, i == len(texts) - 1) for i, x in enumerate(texts)]}
    rows = [("s", i, json.dumps({"request": {"body": body(texts)}})) for i, texts in enumerate(said)]
    monkeypatch.setattr(traffic, "traffic", lambda *_: spark.createDataFrame(rows, "session_id string, record_index long, payload string"))
    got = {r["idx"]: (r["parent"], r["how"]) for r in catalogue.QUERIES["parent_ladder"](spark, "").collect()}
    assert got == {0: (None, None), 1: (0, "model"), 2: (0, "prefix"), 3: (2, "model"), 4: (1, "prefix")}


def test_chains(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 7), (7, 6)], "id long, parent long")
    assert {r["id"]: (r["root"], r["depth"]) for r in ln.chains(links).collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (5, 0), 6: (None, None), 7: (None, None)}


def test_groups(spark):
    rows = [("s", 0, "hi", 0, 1, False, ""), ("s", 1, "", -1, 3, False, ""), ("s", 2, "hi", 0, 5, False, ""), ("s", 3, "title", 0, 1, True, ""), ("s", 4, "new", 0, 1, False, ""), ("s", 5, "x", 0, 1, False, "app"), ("s", 6, "y", 0, 1, False, ""), ("s", 7, "z", 0, 1, False, "app")]
    df = spark.createDataFrame(rows, "scope string, idx long, user_text string, user_at int, messages int, is_title boolean, app_key string")
    assert {r["idx"]: r["group"] for r in ln.session_groups(df).collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 4, 7: 3}
    marks = spark.createDataFrame([("s", i, k) for i, k in enumerate(["a", "a", None, "b", "a"])], "scope string, idx long, k string")
    assert [r["group"] for r in ln.islands(marks, "k").orderBy("idx").collect()] == [1, 1, 1, 2, 3]


def test_diffs():
    a = {"system": "s", "messages": [{"role": "user", "content": "1"}, {"role": "assistant", "content": "2"}, {"role": "user", "content": "3"}], "tools": [{"name": "x"}], "temperature": 1}
    b = {"system": "t", "messages": [{"role": "user", "content": "1"}, {"role": "assistant", "content": "two"}, {"role": "user", "content": "3"}, {"role": "user", "content": "4"}], "tools": [{"name": "y"}], "temperature": 2}
    d = ln.diff_requests(a, b)
    assert (d["kept"], d["changed"], d["added"], d["dropped"]) == (1, 1, 1, 0)
    assert d["system_changed"] and d["tools_added"] == ["y"] and d["tools_removed"] == ["x"] and d["fields"] == ["temperature"]
    assert ln.diff_lines("a\nb\nc", "a\nX\nc") == [(" ", "a"), ("-", "b"), ("+", "X"), (" ", "c")]
    assert ln.diff_lines("\n".join("abcdefg") + "\n1", "\n".join("abcdefg") + "\n2")[0] == ("…", "3")
    assert ln.diff_characters("hello", "help") == ("hel", "lo", "p", "")


def big_records(n, items):
    common = {"instructions": "same words " * 2000, "tools": [{"name": f"t{i}", "description": "d" * 400} for i in range(4)]}
    return [{"turn": i, "request": {"body": {**common, "input": [{"role": "user", "content": f"{j} " + "z" * 600} for j in items(i)]}}, "response": {"body": {}}} for i in range(n)]


def test_compaction(spark):
    records = big_records(40, lambda i: [])
    raw = [json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in records]
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate(raw)], "session_id string, record_index long, payload string")
    small, held = blobs.compact_records(df)
    assert held.count() == 2
    size = small.agg(F.sum(F.length("payload"))).first()[0] + held.agg(F.sum("size_bytes")).first()[0]
    assert size < 0.15 * sum(map(len, raw))
    back = {r["record_index"]: r["payload"] for r in blobs.resolve_records(small, held).collect()}
    assert back == dict(enumerate(raw))
    turning = big_records(30, lambda i: [(i + k) % 20 for k in range(14)])
    df = spark.createDataFrame([("s", i, json.dumps(r, separators=(",", ":"))) for i, r in enumerate(turning)], "session_id string, record_index long, payload string")
    small, held = blobs.compact_records(df)
    assert held.count() == 22
    lost = blobs.resolve_records(small, held.orderBy("hash").limit(21))
    assert lost.count() < 30 and blobs.resolve_records(small, held).count() == 30


def test_references_in_user_data(spark):
    fake = {"__x_blob_ref__": {"version": 1, "kind": "json", "hash": "sha256:0", "bytes": 1}}
    record = {"request": {"body": {"instructions": "w " * 400, "input": [fake]}}}
    store = {}
    packed = blobs.compact(record, lambda h, t, n: store.setdefault(h, json.loads(t)))
    assert blobs.materialize(packed, store.__getitem__) == record and blobs.is_ref(fake)
    assert blobs.from_pointer(blobs.pointer(("a/b", "c~d", 3))) == ["a/b", "c~d", 3]
    assert blobs.replaced({"a": [1]}, ["a", 5], 2) == {"a": [1]}


def test_described_sessions(spark):
    rows = [
        {"turn": 1, "timestamp": "2026-01-01T00:00:00Z", "duration_ms": 5, "request": {"path": "/v1/messages", "body": {"model": "a", "messages": [{"role": "user", "content": "ask"}]}}, "response": {"status": 200, "body": {"content": [{"type": "text", "text": "yes"}], "usage": {"input_tokens": 2, "output_tokens": 1}}}},
        {"turn": 2, "timestamp": "2026-01-01T00:01:00Z", "request": {"path": "/v1/messages", "body": {"model": "b", "messages": [{"role": "user", "content": "more"}]}}, "response": {"status": 200, "body": {"usage": {"input_tokens": 3}}}},
        {"turn": "2.1", "timestamp": "2026-01-01T00:02:00Z", "request": {"path": "/v1/models"}, "response": {"status": 500}},
    ]
    df = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(rows)], "session_id string, record_index long, payload string")
    s = st.session_summaries(rc.described(df)).first()
    assert (s["record_count"], s["turn_count"], s["input_tokens"], s["total_tokens"], s["model"], s["model_last"], s["status"], s["first_user"], s["last_response"], s["duration_ms"]) == (3, 2, 5, 6, "a", "b", "complete", "ask", "yes", 5)
    shown = rc.snapshots(df).first()
    assert shown["model"] == "a"
    assert rc.messages(df).where("role = 'user'").count() == 2


def test_appends_and_lookups(spark, seed):
    from spanmill.sources.sinks import log_lines

    records = spark.createDataFrame([("a", 0, None, "t0", "first needle"), ("a", 1, None, "t1", "second"), ("b", 0, None, "t0", "only")], "session_id string, record_index long, turn long, timestamp string, payload string")
    fresh = spark.createDataFrame([("a", "t3", "third"), ("a", "t2", "next"), ("new", "t1", "zero")], "session_id string, timestamp string, payload string")
    grown = {(r["session_id"], r["record_index"]): r["payload"] for r in ss.append_records(records, fresh).collect()}
    assert grown[("a", 2)] == "next" and grown[("a", 3)] == "third" and grown[("new", 0)] == "zero" and len(grown) == 6
    assert {r["session_id"]: (r["first_payload"], r["last_payload"]) for r in ss.boundaries(records).collect()} == {"a": ("first needle", "second"), "b": ("only", None)}
    assert ss.find_app_session(seed.withColumn("client", F.lit("codexapp")), records, "needle").first()["id"] == "a"
    assert [r["record_index"] for r in ss.record_page(records, "a", 1, 1).collect()] == [1]
    with pytest.raises(ValueError):
        ss.records_of_date(records, seed, "yesterday")
    assert ss.records_of_date(records, seed, "2026-03-10").count() == 2
    assert ss.non_partial(spark.createDataFrame([("xcodexZappYpartialx",), ("fine",), (None,)], "payload string")).count() == 1
    logs = spark.createDataFrame([("a", 1, "t", "i", "x")], "session_id string, line_no long, logged_at string, level string, message string")
    more = log_lines(logs, spark.createDataFrame([("a", "u", "i", "y")], "session_id string, logged_at string, level string, message string"))
    assert [(r["line_no"], r["message"]) for r in ss.logs_of(more, "a").collect()] == [(1, "x"), (2, "y")]
    assert st.match_address(st.match_counts(spark.createDataFrame([(1, "aXa"), (2, "b"), (3, "a")], "id long, text string"), ["A"]), 2, "id").first()["id"] == 3


def plain_groups(rows):
    """Groups by walking through one run, entry by entry."""
    rows = sorted(rows, key=lambda r: r[1])
    groups, apps, last, starts = {}, {}, None, []
    for at, (_, idx, text, place, messages, title, app) in enumerate(rows):
        if title:
            continue
        if app:
            g = apps.setdefault(app, at)
        elif last and (not text or (text == last[1] and messages > 1 and place == last[2])):
            g = last[0]
        else:
            g = at
        groups[idx] = g
        last = (g, text, place) if text or last is None else (g, last[1], last[2])
        starts += [g] if g not in starts else []
    for at, r in enumerate(rows):
        if r[5]:
            near = [(abs(s - at) + (0.25 if s > at else 0), s) for s in starts if abs(s - at) <= 2]
            groups[r[1]] = min(near)[1] if near else at
    number = {g: n for n, g in enumerate(sorted(set(groups.values())), 1)}
    return {idx: number[g] for idx, g in groups.items()}


def test_groups_against_a_walk(spark):
    import random

    r = random.Random(4)
    rows = [(f"s{s}", i * 3, r.choice(("", "a", "b", None)), r.choice((0, 0, 1, None)), r.choice((1, 2, 5)), r.random() < 0.25, r.choice(("", "", "", "x", "y", None))) for s in range(12) for i in range(r.choice((1, 2, 40)))]
    df = spark.createDataFrame(rows, "scope string, idx long, user_text string, user_at int, messages int, is_title boolean, app_key string").repartition(5)
    got = {(x["scope"], x["idx"]): x["group"] for x in ln.session_groups(df).collect()}
    want = {(s, i): g for s in {x[0] for x in rows} for i, g in plain_groups([x for x in rows if x[0] == s]).items()}
    assert got == want


def test_titles_before_between_and_after(spark):
    titles = spark.createDataFrame([("s", 0), ("s", 5), ("s", 9), ("s", 20)], "scope string, at long")
    starts = spark.createDataFrame([("s", 1), ("s", 3), ("s", 7), ("t", 20)], "scope string, start long")
    got = {x["at"]: x["start"] for x in ln.title_groups(titles, starts).collect()}
    assert got == {0: 1, 5: 3, 9: 7}  # 5 is as far from 3 as from 7, which begins later


def test_blob_closure(spark):
    ref = lambda *hashes, mark="__any_blob_ref__": json.dumps({"x": [{mark: {"version": 1, "kind": "json", "hash": h, "bytes": 9}} for h in hashes], "hash": "no"})
    stored = spark.createDataFrame([("s", "a", ref("b", "c")), ("s", "b", ref("d")), ("s", "c", ref("a")), ("s", "d", "{}"), ("s", "e", ref("e")), ("t", "a", ref("z")), ("s", "n", None)], "session_id string, hash string, payload string")
    records = spark.createDataFrame([("s", 1, ref("a")), ("s", 2, ref("d", "d")), ("t", 1, ref("a")), ("t", 2, "broken {"), ("t", 3, None)], "session_id string, record_index long, payload string")
    got = sorted(tuple(x) for x in blobs.reached_blobs(records, stored).collect())
    assert got == [("s", 1, "a", 1), ("s", 1, "b", 2), ("s", 1, "c", 2), ("s", 1, "d", 3), ("s", 2, "d", 1), ("t", 1, "a", 1), ("t", 1, "z", 2)]
    assert sorted(tuple(x)[:2] for x in blobs.orphan_blobs(records, stored).collect()) == [("s", "e"), ("s", "n")]
    assert blobs.reached_blobs(records.limit(0), stored).count() == 0


def test_vector_lists(spark, tmp_path):
    """Exact search by the reach of lists, and the recall of a few probes, against all vectors; nulls, zeros, ties and few rows."""
    import numpy as np

    from spanmill.operators import vectors as vx

    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    made = [(i, (centres[i % 12] + 0.35 * r.normal(size=16)).tolist()) for i in range(900)] + [(900, None), (901, [0.0] * 16), (3, centres[3].tolist())]
    df = spark.createDataFrame(made, "id long, embedding array<float>")
    folder = str(tmp_path / "lists")
    vx.build_lists(df, folder)
    queries = [made[i][1] for i in range(0, 900, 150)] + [r.normal(size=16).tolist()]
    for q in queries:
        want = [tuple(x) for x in rt.vector_topk(df, q, 15).collect()]
        assert [tuple(x) for x in vx.search_lists(spark, folder, q, 15).collect()] == want
    assert vx.recall(spark, folder, df, queries[:-1], probes=3, k=10) >= 0.9
    few = str(tmp_path / "few")
    vx.build_lists(df.limit(3), few)
    assert vx.search_lists(spark, few, queries[0]).count() == rt.vector_topk(df.limit(3), queries[0]).count()
    none = str(tmp_path / "none")
    vx.build_lists(df.limit(0), none)
    assert vx.search_lists(spark, none, queries[0]).count() == 0


def test_rerank_leaves_the_search_for_its_rows_in_parallel(spark):
    """One task scores the few rows, but does not find them (F8, F9)."""
    top = spark.range(8, numPartitions=4).select("id", F.lit("alpha beta").alias("text"), F.lit(0.5).alias("cosine"), F.spark_partition_id().alias("found_in"))
    assert {r["found_in"] for r in rt.rerank(top, "alpha").collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("name", ["dialect_messages", "extracted_base", "extracted_messages"])
def test_long_messages_stay_whole_in_queries(spark, tmp_path, name):
    """As the SQL has them (F5, F6, F7)."""
    from spanmill.plans import catalogue, traffic, works  # noqa: F401  they add their queries

    asked, said = "What about paragraph? \n\n" * 150 + "end", "A sentence of a long answer. " * 150 + "end"
    spark.createDataFrame([(1, 0, "user", asked), (1, 1, "assistant", said)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(r["text"] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()) == sorted([asked, said])
