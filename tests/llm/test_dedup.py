"""Copies: exact, near and byte strings, against brute force on small tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.llm import exact_dedup, minhash, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _norm string, keep_id int"


def table(spark, texts, ids=None):
    """Documents with columns whose names an operator might use itself."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 7) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    texts = [" ".join(word() for _ in range(r.choice((0, 1, 3, 30, 80, 200)))) for _ in range(n)]
    for _ in range(n // 3):
        words = r.choice(texts).split()
        for _ in range(r.choice((0, 1, 2, 5))):
            if words:
                words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    passage = " ".join(word() for _ in range(60))
    texts += [f"{word()} {word()} {passage} {word()}" for _ in range(8)] + [passage + " " + passage, "ab" * 300, "é" * 150 + " " + passage[:230]]
    return texts + ["", None, " \t\n", "one\x0btwo", "one  two", "one two "]


def test_exact(spark):
    texts = corpus()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = collections.defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    want = {i: (groups[t][0], len(groups[t]), i == groups[t][0], hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}
    for options in ({}, {"salts": 3}, {"digest": lambda c: F.substring(F.sha2(c, 256), 1, 1), "salts": 1}):
        got = exact_dedup.dedup_exact(table(spark, texts).repartition(5), **options).collect()
        assert len(got) == len(texts)
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want
    kept = exact_dedup.keep_first(table(spark, texts))
    assert kept.columns == table(spark, []).columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if w[2]}


def test_exact_odd_rows(spark):
    got = exact_dedup.dedup_exact(table(spark, ["a", "a", "a", "b"], [None, 5, 5, None])).collect()
    assert sorted((r["doc_id"] is None, r["keep_id"], r["group_size"], r["kept"]) for r in got if r["keep_id"] or r["group_size"] > 1) == [(False, 5, 3, True), (False, 5, 3, True), (True, 5, 3, False)]
    assert exact_dedup.dedup_exact(table(spark, [])).count() == 0


def test_keep_first_drops_rows_not_ids(spark):
    ids, texts = [None, None, None, 3, 5, 5, 7, 7, None], ["a", "own", "other", "a", "a", "b", "c", "c", "other"]
    kept = exact_dedup.keep_first(table(spark, texts, ids))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("3", "a"), ("5", "b"), ("7", "c"), ("None", "other"), ("None", "own")]


def bag(text):
    w = WORDS.findall(text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute_classes(texts):
    bags = {i: b for i, t in enumerate(texts) if (b := bag(t))}
    root = {i: i for i in range(len(texts))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(bags, 2):
        both = sum((bags[a] & bags[b]).values())
        if both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= 0.8:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def chain(r, steps):
    """Texts of which each is similar to the next, but the first not to the last."""
    words = [f"w{r.randrange(10**6)}" for _ in range(150)]
    out = []
    for _ in range(steps):
        out.append(" ".join(words))
        words = list(words)
        words[r.randrange(150)] = f"w{r.randrange(10**6)}"
        words[r.randrange(150)] = f"w{r.randrange(10**6)}"
    return out


def test_near(spark):
    texts = corpus(2) + chain(random.Random(5), 12)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, texts)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == brute_classes(texts)
    assert all(r["kept"] == (r["class_id"] == i) for i, r in got.items())
    kept = minhash.keep_one(table(spark, texts))
    assert kept.columns == table(spark, []).columns and kept.count() == len({r["class_id"] for r in got.values()})


def test_near_odd_rows(spark):
    got = minhash.near_duplicates(table(spark, ["a b c d e f", "a b c d e f", None, "q"], [3, 3, 4, None])).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (3, 3, True), (3, 3, True), (4, 4, True)]
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_near_repeated_ids(spark):
    """An id with two texts links by each of them; rows without an id and ids of another type join classes too."""
    r = random.Random(8)
    a, b, c = (" ".join(f"w{r.randrange(10**6)}" for _ in range(120)) for _ in range(3))
    near = a.rsplit(" ", 1)[0] + " changed"
    texts, ids = [b, a, near, c, c + " end", near + " too", a], [7, 7, 9, None, None, None, 7]
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["kept"]) for r in minhash.near_duplicates(table(spark, texts, ids)).collect())
    assert got == sorted([("7", "7", True), ("7", "7", True), ("9", "7", False), ("None", "None", True), ("None", "None", False), ("None", "7", False), ("7", "7", True)]) or got == sorted([("7", "7", True), ("7", "7", True), ("9", "7", False), ("None", "None", False), ("None", "None", True), ("None", "7", False), ("7", "7", True)])
    kept = sorted((str(r["doc_id"]), r["text"]) for r in minhash.keep_one(table(spark, texts, ids)).collect())
    assert [x for x in kept if x[0] != "None"] == sorted([("7", a), ("7", b)]) and len(kept) == 3
    named = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(named).collect()} == {"id0": "id0", "id1": "id1", "id2": "id1", "id3": "id3", "id4": "id3", "id5": "id1", "id6": "id1"}


def test_signatures_are_unbiased():
    r, errors = random.Random(3), []
    for _ in range(40):
        keys = [r.getrandbits(52) << 12 for _ in range(r.choice((4, 40, 200)))]
        a = {k: r.choice((1, 1, 2, 5, 9)) for k in keys}
        b = {k: (w if r.random() < 0.6 else r.choice((1, 3, 4, 17))) for k, w in a.items() if r.random() < 0.9}
        if not b:
            continue
        j = sum(min(a[k], b[k]) for k in b) / sum(max(a[k], b.get(k, 0)) for k in a)
        sig = [minhash.bag_minhash(np.zeros(len(d), dtype=np.int64), np.array(sorted(d), dtype=np.uint64), np.array([d[k] for k in sorted(d)]), 1, 1024)[0] for d in (a, b)]
        errors.append((sig[0] == sig[1]).mean() - j)
    assert abs(np.mean(errors)) < 0.006 and np.std(errors) < 0.03


def test_block_links():
    known = minhash.WordHashes()
    texts = corpus(4, 40)
    texts = [t for t in texts if bag(t)]
    tokens = [minhash.tokens_of(t, known) for t in texts]
    labels = np.arange(len(texts))
    found = {(min(i, j), max(i, j)) for i, j, _ in minhash.block_links(tokens, tokens, labels, labels, 0.8)}
    bags = [bag(t) for t in texts]
    want = set()
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = sum((bags[a] & bags[b]).values())
        if both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= 0.8:
            want.add((a, b))
    assert found == want and want


def brute_repeats(raws, length=200):
    seen = collections.Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        mark = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                mark[p : p + length] = b"\x01" * length
        runs = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out.append((len(r), sum(mark), runs, hashlib.sha256(bytes(b for b, m in zip(r, mark) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize(("batch", "hot"), [(2048, 50_000), (3, 50_000), (3, 3)])
def test_repeats(spark, monkeypatch, batch, hot):
    texts = corpus(6)
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(table(spark, texts)).collect()}
    assert got == dict(enumerate(brute_repeats([(t or "").encode() for t in texts])))


def test_repeats_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdef") for _ in range(250))
    got = suffix_dedup.remove_repeats(table(spark, [long, long, "short", None], [1, 1, None, None])).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got) == [(0, 0, 0), (0, 5, 0), (1, 250, 250), (1, 250, 250)]
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_index_family_is_exact():
    r = random.Random(9)
    passage = bytes(r.choice(b"abcd") for _ in range(400))
    lefts, rights = [], []
    for k in range(150):
        a, b, p = r.randint(0, 150), r.randint(50, 200), bytes([65 + k % 3]) * 50 + passage[200:350] if k % 4 else passage[150:350]
        lefts.append((passage[150 - a : 150][::-1] + bytes(r.choice(b"xyz\0") for _ in range(150)))[: 150 if r.random() < 0.8 else a])
        rights.append((p[:b] + bytes(r.choice(b"xyz\0") for _ in range(200)))[: 200 if r.random() < 0.8 else b])

    def common(x, y):
        return next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))

    want = []
    for i in range(150):
        reach = [(common(lefts[i], lefts[j]), common(rights[i], rights[j])) for j in range(150) if j != i]
        reach = [x for x in reach if sum(x) >= 200]
        want.append((max(a for a, _ in reach), max(b for _, b in reach)) if reach else (-1, -1))
    for batch in (150, 16, 1):
        family = suffix_dedup.IndexFamily()
        for i in range(0, 150, batch):
            before, after = (np.array([list(x.ljust(w, b"\0")) for x in xs[i : i + batch]], dtype=np.uint8) for xs, w in ((lefts, 150), (rights, 200)))
            family.add(before, after, np.array([len(x) for x in lefts[i : i + batch]]), np.array([len(x) for x in rights[i : i + batch]]))
            sizes = [len(x) for x in family.levels]
            assert all(a > b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == min(150, i + batch)
            assert all((level.keys[1:] >= level.keys[:-1]).all() for level in family.levels)
        assert family.reach() == want
    assert sum(a >= 0 for a, _ in want) > 20


def test_repeats_of_repeated_rows(spark):
    """Rows of one id and text many times, of one id and several texts, and of textual ids."""
    long = "".join(random.Random(1).choice("abcdef") for _ in range(600))
    rows = [("a", long), ("a", long), ("a", "x" + long[:300]), (None, "y" * 30 + long[100:420]), ("b", "short"), (None, "z" * 199)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    want = brute_repeats([t.encode() for _, t in rows])
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))
