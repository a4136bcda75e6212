"""Collocations and the n-gram join against brute force on small tables."""

import collections
import itertools
import random
import re

import pytest

from spanmill.llm import ngram_join, phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, head string, node int, label string"


def table(spark, rows):
    """Documents (id, text, lang) with columns whose names an operator might use itself."""
    return spark.createDataFrame([(*r, "s", 0, "x", 7, "y") for r in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_phrases(rows, least, longest, top, inside=50):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= inside * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def prose(seed=3, n=40):
    r = random.Random(seed)
    words = ["a", "B", "b", "é", "und", "x\x01y", "the", "The", "\x1fz", "10%"]
    fixed = ["new York city", "of the", "a b a b a"]
    make = lambda: "".join(r.choice(fixed if r.random() < 0.3 else words) + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r"]) for _ in range(r.choice((0, 1, 5, 60))))
    rows = [(r.choice((None, i)), make(), r.choice(("en", "de", None, "und"))) for i in range(n)]
    return [*rows, *rows[:5], (7, None, "en"), (8, "", None), (9, " \t\n.", "fr"), (7, "q w " * 3000, "en")]


@pytest.mark.parametrize("least, longest, top", [(3, 3, 2000), (2, 4, 20), (2, 2, 7), (5, 5, 2000)])
def test_phrases(spark, monkeypatch, least, longest, top):
    monkeypatch.setattr(phrases, "HELD_WORDS", 50)
    monkeypatch.setattr(phrases, "STEP_WORDS", 17)
    monkeypatch.setattr(phrases, "PART_CHARS", 300)
    monkeypatch.setattr(phrases, "HELD_ROWS", 40)
    rows = prose()
    got = phrases.collocations(table(spark, rows).repartition(5), least=least, max_words=longest, top=top, salts=3).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, least, longest, top)


def test_phrases_of_production_parameters(spark):
    rows = prose(5, 300)
    assert sorted(map(tuple, phrases.collocations(table(spark, rows)).collect())) == brute_phrases(rows, 10, 3, 2000)


def test_growth_over_batches(spark):
    """Counts of a prefix go on over Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = prose(8, 15)
        got = phrases.collocations(table(spark, rows).coalesce(1), least=2, top=50)
        assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 2, 3, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_counts_beyond_64_bits(spark):
    big = 10**13
    made = spark.createDataFrame([("en", "", 0, 9 * big), ("en", "p q", 2, big - 1), ("en", "p", 1, big), ("en", "q", 1, big + 7)], "lang string, phrase string, words int, f long")
    patched, phrases.frequent_phrases = phrases.frequent_phrases, lambda *a: made
    try:
        got = phrases.collocations(made).collect()
    finally:
        phrases.frequent_phrases = patched
    a = big - 1
    assert [tuple(r) for r in got] == [("en", 1, "p q", a, big, big + 7, 9 * big, 10**6 * a * a // (big * (big + 7)))]


def test_phrases_of_no_rows(spark):
    assert phrases.collocations(table(spark, [])).count() == 0


def sets_of(rows, width=4):
    out = []
    for _, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        out.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def brute_join(rows, percent=85):
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    members = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            members[find(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), min(members[find(i)], default=None)) for i, r in enumerate(rows)), key=repr)


def near(seed=1):
    """Chains of similar documents, groups around a template, a passage and a line that many share, equal sets in another order."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**5)}"
    passage, line = [word() for _ in range(30)], [word() for _ in range(6)]
    texts = []
    for size in (4, 20, 60, 150):
        base = [word() for _ in range(size)]
        for _ in range(12):
            texts.append(list(base))
            base = list(base)
            for _ in range(r.choice((1, 1, 2, 6))):
                base[r.randrange(size)] = word()
    template = [word() for _ in range(100)]
    for _ in range(30):
        own = list(template)
        for _ in range(r.randrange(5)):
            own[r.randrange(100)] = word()
        texts.append(own)
    for _ in range(15):
        texts.append([word() for _ in range(40)] + passage)
        texts.append(line + [word() for _ in range(r.choice((0, 1, 30)))] + line)
    texts.append(passage * 3)
    texts.append((passage * 3)[1:])
    rows = [(i, " ".join(t), "en") for i, t in enumerate(texts)]
    rows += [(r.choice((None, 3)), x[1].upper(), None) for x in rows[::7]]
    return rows + [(900, None, None), (901, "", "en"), (902, "\t \x0b", "en"), (903, "one", "en"), (904, "One", "en"), (905, "é É", "en"), (None, "own words", "en"), (907, "q " * 9, "en"), (906, "q " * 5000, "en")]


@pytest.mark.parametrize("hot, block, listed", [(50, 1000, 10**6), (3, 4, 10**6), (3, 4, 0), (1, 1000, 10**6), (10**9, 5, 10**6)])
def test_join(spark, monkeypatch, hot, block, listed):
    monkeypatch.setattr(ngram_join, "MOST_LISTED", listed)
    rows = near()
    got = ngram_join.similar_sets(table(spark, rows).repartition(4), hot_rows=hot, block_rows=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_join(rows)


def test_join_at_the_bound(spark):
    """17 of 20 n-grams are 85 percent; 16 of 19 are not."""
    base = [f"w{i}" for i in range(23)]
    rows = [(1, " ".join(base), "en"), (2, " ".join(base[:20]), "en"), (3, " ".join([*base[:19], "x"]), "en")]
    assert [len(s) for s in sets_of(rows)] == [20, 17, 17]
    assert sorted(map(tuple, ngram_join.similar_sets(table(spark, rows)).collect())) == brute_join(rows) == [(1, 20, 1), (2, 17, 1), (3, 17, 1)]
    rows = rows[::2]
    assert sorted(map(tuple, ngram_join.similar_sets(table(spark, rows)).collect())) == brute_join(rows) == [(1, 20, 1), (3, 17, 3)]


def test_join_of_ids_that_clash_in_half_a_digest(spark):
    """Nodes stay apart where digests share their first half."""
    made = spark.createDataFrame([(bytearray([1] * 8 + [i] * 8), "k", 5, 1, [i]) for i in range(3)], "set binary, row_key string, node long, size long, cols array<long>")
    assert sorted(r["node"] for r in ngram_join.distinct_rows(made).collect()) == [5, 6, 7]


def test_join_of_no_rows(spark):
    assert ngram_join.similar_sets(table(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.similar_sets(table(spark, [(4, None, None)])).collect()] == [(4, 0, 4)]
