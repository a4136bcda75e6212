"""The jobs over copies of tables that grow, change and shrink, and what they are made of."""

import datetime as dt
import glob
import json
import os
import random
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import search_index, usage_ledger
from spanmill.functions import text as tx
from spanmill.operators import index, ledger
from spanmill.operators import retrieval as rt

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
EVENTS = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string"


def traffic(seed, n, first=0, days=4):
    r = random.Random(seed)
    begin = dt.datetime(2031, 3, 1)
    kinds = ("view", "click", "purchase", "signup", "error", None)
    return [(first + i, r.choice((1, 2, 3, 9)), None if r.random() < 0.05 else begin + dt.timedelta(minutes=r.randrange(days * 1440)), r.choice(kinds), r.choice((None, r.random() * 100)), "{}") for i in range(n)]


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def ledger_rows(spark, folder):
    return sorted(map(tuple, ledger.read_ledger(spark, folder).collect()), key=repr)


def of_all(spark, events):
    rows = usage_ledger.records(spark.createDataFrame(events, EVENTS))
    return sorted(map(tuple, ledger.summaries(ledger.merged(ledger.partial(rows))).collect()), key=repr)


def brute_ledger(events):
    days = {}
    for e in events:
        days.setdefault(("undated" if e[2] is None else str(e[2].date()), str(e[1])), []).append(e)
    out = {}
    for key, rows in days.items():
        total = sum(int(e[4] or 0) for e in rows if e[3] in usage_ledger.COUNTED.values())
        out[key] = (len(rows), total, sum(e[3] == "error" for e in rows))
    return out


def test_ledger_takes_only_what_is_new(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    first, later = traffic(1, 120), traffic(2, 60, 1000, days=2)
    spark.createDataFrame(first, EVENTS).repartition(3).write.parquet(str(source))
    assert usage_ledger.run(spark, f"{source}/*.parquet", out)["read"] == 120
    assert ledger_rows(spark, out) == of_all(spark, first)
    before = files(out)
    assert usage_ledger.run(spark, f"{source}/*.parquet", out) == {"batches": [], "read": 0}  # nothing new, nothing written
    assert files(out) == before

    spark.createDataFrame(later, EVENTS).coalesce(1).write.mode("append").parquet(str(source))
    done = usage_ledger.run(spark, f"{source}/*.parquet", out)
    assert done["read"] == 60
    assert ledger_rows(spark, out) == of_all(spark, first + later)
    assert {(r["date"], r["session_id"]): (r["records"], r["total_tokens"], r["errors"]) for r in ledger.read_ledger(spark, out).collect()} == brute_ledger(first + later)
    untouched = {f for f in before if "/ledger/date=" in f} & set(files(out))
    assert {f.split("date=")[1][:10] for f in untouched} == {"2031-03-03", "2031-03-04"}  # days without new records stay as they are
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_ledger_of_any_split_and_replay(spark, tmp_path):
    """Batches in any number, one of them run again after it had written, give the states of all records at once."""
    events = traffic(5, 90)
    for parts in (1, 2, 7):
        out = str(tmp_path / f"out{parts}")
        for number in range(parts):
            batch = usage_ledger.records(spark.createDataFrame(events[number::parts], EVENTS))
            ledger.merge_batch(batch, number, out)
            if number == parts // 2:
                ledger.merge_batch(batch, number, out)
        assert ledger_rows(spark, out) == of_all(spark, events)


def test_ledger_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    """A call that dies between its two writes is gone on with by the next: same batch, same result."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    events = traffic(7, 50)
    spark.createDataFrame(events, EVENTS).write.parquet(str(source))
    monkeypatch.setattr(ledger, "summaries", lambda states: 1 / 0)
    with pytest.raises(Exception):
        usage_ledger.run(spark, f"{source}/*.parquet", out)
    monkeypatch.undo()
    assert usage_ledger.run(spark, f"{source}/*.parquet", out)["read"] == 50
    assert ledger_rows(spark, out) == of_all(spark, events)


def texts(seed, ids):
    r = random.Random(seed)
    words = ["alpha", "Beta", "ümlaut", "snake_case", "x", "gamma-ray", "Été", "😀smile", "naïve"]
    return [(i, " ".join(r.choice(words) for _ in range(r.choice((0, 1, 4, 30))))) for i in ids]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, places int" if rows and len(rows[0]) == 4 else "doc_id long, text string")


def scores(found):
    return sorted((repr(r["id"]), round(r["score"], 9)) for r in found.collect())


QUERIES = ("alpha ümlaut snake_case", "alpha alp mla 😀smile été nothing")


def same_as_scan(spark, folder, rows):
    docs = docs_of(spark, rows).withColumnRenamed("doc_id", "id")
    stored = index.Index(folder, spark)
    assert stored.totals["documents"] == len(rows)
    for q, unicode_words in zip(QUERIES, (False, True)):
        assert scores(rt.indexed_words(stored, q, unicode_words)) == scores(rt.bm25_words(docs, q, unicode_words)), q
        assert scores(rt.indexed_trigrams(stored, q, unicode_words)) == scores(rt.bm25_trigrams(docs, q, unicode_words)), q


def segments(spark, folder):
    return {s["segment"]: s["documents"] for s in index.last_run(spark, folder)["segments"]}


def test_index_upkeep(spark, tmp_path):
    """Documents added, changed and gone: after each run the index finds what a scan finds, and only new segments are written."""
    source, out = str(tmp_path / "docs"), str(tmp_path / "index")
    rows = [*texts(1, range(60)), (7, "alpha alpha of the same id"), (None, "beta without an id"), (61, None), (62, "")]

    def call():
        docs_of(spark, rows).repartition(3).write.mode("overwrite").parquet(source)
        return search_index.run(spark, source, out)

    done = call()
    assert (done["new"], done["written"]) == (64, True)
    same_as_scan(spark, out, rows)
    first = files(out)
    assert not call()["written"] and files(out) == first

    rows += texts(2, range(100, 110))  # added
    rows[3] = (3, "changed alpha gamma-ray")
    done = call()
    assert (done["new"], done["gone"], done["folded"]) == (11, 1, [])
    same_as_scan(spark, out, rows)
    assert {f: t for f, t in files(f"{out}/postings").items() if "segment=0" in f} == {f: t for f, t in first.items() if "postings/segment=0" in f}  # as it was
    assert segments(spark, out) == {0: 63, 1: 11}

    del rows[10:20]  # gone
    done = call()
    assert (done["new"], done["gone"]) == (0, 10)
    same_as_scan(spark, out, rows)

    rows += texts(3, range(200, 215))  # segments that are no larger are folded in
    rows.append(rows[0])  # and an equal row is counted
    done = call()
    assert (done["new"], done["folded"], done["recounted"]) == (15, [1], 1)
    same_as_scan(spark, out, rows)
    assert segments(spark, out) == {0: 53, 3: 26}

    rows[:] = [(1, "alpha")]
    call()
    same_as_scan(spark, out, rows)
    rows.clear()
    call()
    same_as_scan(spark, out, [])


def test_packed_postings_are_small(spark, tmp_path):
    """Packed values come back, and an index of words and trigrams takes less than three bytes a character (F1 to F4)."""
    r = random.Random(7)
    values = np.array([r.choice((0, 127, 128, 16_383, 16_384, 1 << 21, (1 << 28) + 5, r.randrange(1 << 31))) for _ in range(300)])
    begins = np.array([0, 1, 50, 299])
    back, counts = index.unpack(index.pack(values, begins).slice(1))
    assert back.tolist() == values[1:].tolist() and counts.tolist() == [49, 249, 1]

    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.choice((2, 4, 7)))) for _ in range(2000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(400))) for i in range(300)]
    docs_of(spark, rows).coalesce(1).write.parquet(str(tmp_path / "docs"))
    search_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "index"))
    held = sum(f.stat().st_size for f in (tmp_path / "index" / "postings").rglob("*.parquet"))
    assert held < 3 * sum(len(t) for _, t in rows)


def test_words_of_an_index(spark, tmp_path, monkeypatch):
    """words are cut where texts are indexed, as token_words cuts them, whatever the characters; their places are read without
    lists; and texts that are all new are not joined with the list of new ones."""
    chars = [chr(c) for c in range(1, 0x11000, 7) if not 0xD7FF < c < 0xE000] + [chr(c) for c in range(0x1D400, 0x1D800, 5)] + ["e\u0301", "İ", "ÀÉß", "\U0001F600"]
    rows = [(i, "".join(r.choice(chars) * r.choice((1, 1, 2)) for _ in range(300))) for i in range(6) for r in [random.Random(i)]] + [(7, "end"), (8, "start one end"), (9, ""), (10, None), (11, "..")]
    docs, out, asked = docs_of(spark, rows).withColumnRenamed("doc_id", "id"), str(tmp_path / "index"), []
    once = index._once
    monkeypatch.setattr(index, "_once", lambda keyed, fresh, whole: asked.append(whole) or once(keyed, fresh, whole))
    index.upsert(docs.where("id < 3"), out)
    index.upsert(docs.where("id >= 3"), out)
    index.upsert(docs.where("id < 3").unionByName(docs.sparkSession.createDataFrame([(20, "new")], docs.schema)), out)
    assert asked == [True, True, False]
    stored = index.Index(out, spark)
    found = stored.occurrences("words").join(stored.lengths.select("block", "slot", "id", "words", "trigrams"), ["block", "slot"])
    want = {}
    for r in docs.select("id", tx.token_words(F.coalesce("text", F.lit(""))).alias("w")).collect():
        for place, w in enumerate(r["w"]):
            want.setdefault((r["id"], w, len(r["w"])), []).append(place)
    want[(20, "new", 1)] = [0]
    assert {(r["id"], r["term"], r["words"]): (r["tf"], r["first_place"], r["last_place"]) for r in found.collect()} == {k: (len(v), v[0], v[-1]) for k, v in want.items()}


def test_index_by_upserts(spark, tmp_path):
    """Only the changes are handed over."""
    out, held = str(tmp_path / "index"), {}
    r = random.Random(3)
    for step in range(6):
        added = dict(texts(step, r.sample(range(40), 8)))
        removed = r.sample(sorted(set(held) - set(added)), min(2, len(set(held) - set(added))))
        index.upsert(docs_of(spark, list(added.items())).withColumnRenamed("doc_id", "id"), out, spark.createDataFrame([(i,) for i in removed], "id long"))
        held = {k: v for k, v in (held | added).items() if k not in removed}
        if step in (1, 5):
            same_as_scan(spark, out, list(held.items()))
    assert len(segments(spark, out)) <= 3


def test_index_after_an_interrupted_run(spark, tmp_path):
    """What a run leaves behind before its last write counts for nothing, and is overwritten."""
    source, out = str(tmp_path / "docs"), str(tmp_path / "index")
    rows = texts(4, range(30))
    docs_of(spark, rows).write.parquet(source)
    search_index.run(spark, source, out)
    more = rows + texts(5, range(50, 60))
    docs_of(spark, more).write.mode("overwrite").parquet(source)
    search_index.run(spark, source, out)
    shutil.rmtree(f"{out}/runs/run=1")  # as if it had died before it
    same_as_scan(spark, out, rows)
    assert search_index.run(spark, source, out)["run"] == 1
    same_as_scan(spark, out, more)


def test_command_lines(tmp_path):
    """Each job by its command line, in a process of its own, twice."""
    r = random.Random(1)
    made = f"""
import sys; sys.path.insert(0, {ROOT!r})
from spanmill.session import build_session
s = build_session("make", "local[2]")
s.range(20).selectExpr("id as event_id", "id % 3 as user_id", "timestamp_ntz'2031-03-01 10:00:00' as ts", "'view' as event_type", "cast({r.randrange(9)} as double) as value").coalesce(1).write.parquet({str(tmp_path / "events.parquet")!r})
s.range(9).selectExpr("id as doc_id", "concat('alpha beta ', id) as text").coalesce(1).write.parquet({str(tmp_path / "docs.parquet")!r})
"""
    subprocess.run([sys.executable, "-c", made], check=True, capture_output=True)
    for job, source, kinds in (("usage_ledger", "events*.parquet", None), ("search_index", "docs.parquet", ["words"])):
        config = {"source": "elsewhere", "output": str(tmp_path / job), "master": "local[2]", "id_column": "doc_id", "text_column": "text", "kinds": kinds}
        (tmp_path / f"{job}.json").write_text(json.dumps(config))
        for said in (("20 records read", "9 new texts"), ("0 records read", "written: False")):
            out = subprocess.run([sys.executable, f"{ROOT}/jobs/{job}.py", "--config", str(tmp_path / f"{job}.json"), "--source", str(tmp_path / source)], check=True, capture_output=True, text=True)
            assert any(x in out.stderr for x in said), out.stderr[-2000:]
