"""The pipeline stage by stage against plain Python, and on tables of odd shapes."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest

import corpus_pipeline
from spanmill.llm import bpe
from spanmill.session import cut
from test_phrases_join import brute_join, brute_phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def write(spark, path, rows):
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def documents(seed=8):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(r.choice((10, 60, 90, 150)))), "en", f"s{r.randrange(3)}") for i in range(150)]
    for k in range(30):
        i, text, lang, source = r.choice(rows[:150])
        rows.append((150 + k, text if k % 2 else text.replace(" ", "  "), lang, source))
    for k in range(20):
        words = r.choice([t for _, t, *_ in rows[:150] if len(t.split()) >= 90]).split()
        words[len(words) // 2] = word()
        rows.append((180 + k, " ".join(words), "en", "s0"))
    return rows + [(200, None, None, None), (201, "", "en", "s1"), (202, "spam " * 80, "en", "s1")]


def similar(a, b):
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (SPACE.findall(a), SPACE.findall(b))]
    both = sum((bags[0] & bags[1]).values())
    return both / (sum(bags[0].values()) + sum(bags[1].values()) - both) >= 0.8


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = documents()
    folder = write(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs)
        assert name == corpus_pipeline.STAGES[i][0] and (i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns)
    text = {i: t or "" for i, t, *_ in rows}
    ids = [sorted(r["doc_id"] for r in d.collect()) for d in seen]
    good = [i for i, t in text.items() if len(SPACE.findall(t)) >= 50 and i != 202]
    assert ids[0] == sorted(good)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for i in sorted(good):
        first.setdefault(norm(text[i]), i)
    assert ids[1] == sorted(first.values())
    kept = []
    root = {}
    for i in ids[1]:  # chains are short here: the first similar document leads
        lead = next((j for j in ids[1] if j < i and similar(text[i], text[j])), i)
        root[i] = root.get(lead, lead)
        kept += [i] if root[i] == i else []
    assert ids[2] == kept
    size = {i: len(SPACE.findall(text[i])) for i in kept}
    copies = collections.Counter(ids[3])
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    assert abs(sum(size[i] * n for i, n in copies.items()) - sum(size.values())) <= 3 * 150
    tokenizer = Tokenizer.from_file(bpe.default_path())
    got = collections.Counter((r["doc_id"], r["ids_sha256"]) for r in seen[4].collect())
    want = collections.Counter()
    for i, n in copies.items():
        want[i, hashlib.sha256(np.array(tokenizer.encode(text[i], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()] += n
    assert got == want
    whole = corpus_pipeline.run(spark, folder)
    assert collections.Counter((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == want


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "a b", "en", "s")] * 3])
def test_small_tables(spark, tmp_path, rows):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, rows)).count() == 0


def test_queries_run_on_odd_tables(spark, tmp_path):
    from spanmill.llm import queries

    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "no id", "xx", "b"), (3, "tie tie tie", "en", "a"), (4, "tie tie tie", "en", None), (5, long, "en", "a"), (6, "\x00\x01 \U0001f600 ſ", "de", "a")]
    folder = write(spark, tmp_path, rows)
    spark.createDataFrame([(1, None, None), (5, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, None, None), (1, "x", "<p>a"), (1, "x", "<p>a")], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    got = {}
    for name, query in queries.QUERIES.items():
        got[name] = query(spark, folder).collect()
        assert name == "op11_phrases" or len(got[name]) == (3 if name == "op9_html" else len(rows)), name
    empty = hashlib.sha256(b"").hexdigest()

    def by(name, *fields):
        return sorted(([r["doc_id"], *(r[f] for f in fields)] for r in got[name]), key=repr)

    key = lambda rows_: sorted(rows_, key=repr)
    assert by("op1_mix", "size") == key([[1, 0], [2, 0], [2, 0], [None, 2], [3, 3], [4, 3], [5, 60_000], [6, 3]])
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got["op1_mix"])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got["op2_toxicity"])
    assert by("op3_licenses", "n_words", "n_base", "base_labels") == key([[1, 0, 0, ""], [2, 0, 0, ""], [2, 0, 0, ""], [None, 2, 0, ""], [3, 3, 0, ""], [4, 3, 0, ""], [5, 60_000, 0, ""], [6, 2, 0, ""]])
    assert by("op4_exact_dedup", "keep_id", "group_size", "kept") == key([[1, 1, 3, True], [2, 1, 3, False], [2, 1, 3, False], [None, None, 1, True], [3, 3, 2, True], [4, 3, 2, False], [5, 5, 1, True], [6, 6, 1, True]])
    assert by("op5_minhash", "class_id", "kept") == key([[1, 1, True], [2, 2, True], [2, 2, True], [None, None, True], [3, 3, True], [4, 3, False], [5, 5, True], [6, 6, True]])
    size = {i: len((t or "").encode()) for i, t, *_ in rows}
    assert by("op6_suffix_dedup", "n_bytes", "n_removed", "n_spans") == key([[i, size[i], *((size[i], 1) if i == 5 else (0, 0))] for i, *_ in rows])
    assert all(r["base_failed"] and not r["kept"] for r in got["op7_quality"])
    assert by("op7_quality", "n_words", "n_repeat_words", "n_dup_lines") == key([[1, 0, 0, 0], [2, 0, 0, 0], [2, 0, 0, 0], [None, 2, 0, 0], [3, 3, 0, 0], [4, 3, 0, 0], [5, 60_000, 60_000, 0], [6, 3, 0, 0]])
    assert by("op8_bpe", "decoded_sha256") == key([[i, hashlib.sha256((t or "").encode()).hexdigest()] for i, t, *_ in rows])
    assert all((r["n_tokens"] == 0) == (not r["doc_id"] or r["doc_id"] < 3) or r["doc_id"] is None for r in got["op8_bpe"])
    assert sorted((r["text"], r["n_chars"]) for r in got["op9_html"]) == [("", 0), ("a", 1), ("a", 1)]
    assert all((r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) == (0, 0, 0, empty, "") for r in got["op10_secrets"])
    plain = [r[:3] for r in rows]
    assert sorted(map(tuple, got["op11_phrases"])) == brute_phrases(plain, 10, 3, 2000) and got["op11_phrases"]
    assert sorted(map(tuple, got["op12_ngram_join"]), key=repr) == brute_join(plain)


def test_stages_keep_rows_of_shared_ids(spark, tmp_path):
    """Null and repeated ids, clashing texts and repeated rows go through every stage each on its own."""
    r = random.Random(3)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(90))
    a, b, c, d = (text() for _ in range(4))
    near = a.rsplit(" ", 1)[0] + " last"
    rows = [(7, a, "en", "s"), (7, b, "en", "s"), (9, near, "en", "s"), (None, c, "en", "s"), (None, d, "en", "s"), (None, "short", "en", "s"), (9, b, "en", "s"), (7, a, "en", "s")]
    folder = write(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder).checkpoint()
        seen.append(sorted((str(x["doc_id"]), x["text"]) for x in docs.collect()))
    good = [(str(i), t) for i, t, *_ in rows if t != "short"]
    assert seen[0] == sorted(good)
    once = [("7", a), ("7", b), ("9", near), ("None", c), ("None", d)]
    assert seen[1] == sorted(once)
    assert seen[2] == sorted(x for x in once if x[1] != near)


def test_stages_keep_columns_of_clashing_names(spark):
    """Columns that are named as an operator's own come out as they went in."""
    names = ("_row_key", "_row_id", "_row_sha", "_norm", "_k_text", "words", "kept", "_n")
    rows = [(i, t, la, so, n, *[f"{c}{i}" for c in names]) for i, (i_, t, la, so) in enumerate(documents()) for n in [len(t or "")]]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names), name


def test_shuffles_go_with_their_checkpoint(spark):
    """Shuffle files of a step are dropped when it has been kept, not when the driver collects its garbage."""
    held = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, setting = held(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    counted = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    kept = cut(counted)
    end = time.time() + 20
    while (left := held() - before) and time.time() < end:  # files are removed behind the step
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, counted.collect()))
