r"""Phrase collocations by contiguous pattern growth.

Texts are lower-cased (A-Z only) and split at [.,;:!?\x0A-\x0D] into pieces, pieces into words [^\x20\x09]+; a phrase is a run of
words of a piece. As in PrefixSpan every frequent prefix has a projection: what follows each of its occurrences, as far as the
longest phrase reaches. Occurrences are projected where a text is read, and equal ones counted there, so a prefix of very many
occurrences leaves a task as its different continuations, packed by columns. All that belongs to a prefix of two words is in one
part, and parts are dealt out over tasks. There patterns grow to the right: a prefix is counted, and only if it is frequent its
projection is extended by the next word, down to the longest phrase, before the task goes on to its next part. A worker holds one
part at a time; parts are made in proportion to the texts.

Counts of single words and of all words travel in the same way, as projections without continuation. Everything is per language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.session import cut, text_batches

PIECES = re.compile(r"[.,;:!?\x0A-\x0D]")
LEAST, MAX_WORDS, TOP, INSIDE_PERCENT = 10, 3, 2000, 50
#: Words that a task counts before it hands its counts on, and words looked at in one step.
HELD_WORDS, STEP_WORDS = 400_000, 100_000
#: Code points of texts whose occurrences make a part, about, and rows that a worker holds before it adds up equal ones.
PART_CHARS, HELD_ROWS = 6_000_000, 2_000_000
#: Sub-groups in which the best of a language are chosen before the last choice.
SALTS = 64


def words_of(text: str | None) -> list[str]:
    """Words in order; a line break stands between pieces."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes, so A-Z only
    return [w for w in PIECES.sub(" \n ", low).replace("\t", " ").split(" ") if w]


class _Numbers(dict):
    """Word -> its number in a task's vocabulary; 0 stands between pieces."""

    def __init__(self):
        self["\n"] = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(lang: str, numbers: np.ndarray, begins: np.ndarray, words: np.ndarray, hashes: np.ndarray, max_words: int, parts: int) -> pa.RecordBatch:
    """Rows of project() for occurrences of one language: numbered words with a 0 behind each piece, and which of them begin a
    run. The columns of a row are its words, a line each, and behind a piece's end empty lines."""
    starts = np.flatnonzero(begins & (numbers > 0))
    columns, code = [numbers[starts]], numbers[starts]
    for k in range(1, max_words):
        columns.append(np.where(columns[-1] > 0, numbers[starts + k], 0))
        code = (code if k < 3 else np.unique(code, return_inverse=True)[1]) * len(words) + columns[-1]
    first, counts = np.unique(code, return_index=True, return_counts=True)[1:]
    longer = columns[1][first] > 0 if max_words > 1 else np.zeros(len(first), dtype=bool)
    single, times = np.unique(columns[0], return_counts=True)
    none = np.zeros(len(single) + 1, dtype=np.int64)
    columns = [np.concatenate([c[first][longer], none if k else np.append(single, 0)]) for k, c in enumerate(columns)]
    counts = np.concatenate([counts[longer], times, [len(starts)]])  # occurrences, those of single words, all words
    part = (hashes[columns[0]] * 31 + hashes[columns[1]]) % parts
    order = np.argsort(part, kind="stable")
    own, at = np.unique(part[order], return_index=True)
    ends = [*at[1:].tolist(), len(order)]
    texts, counts = [words[c[order]].tolist() for c in columns], counts[order].astype("<i8")
    lines, numbers_ = [], []
    for i, j in zip(at.tolist(), ends):
        lines.append(_zip("\n".join("\n".join(t[i:j]) for t in texts).encode("utf-8", "surrogatepass")))
        numbers_.append(_zip(counts[i:j].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([lang] * len(own), pa.string()), pa.array(lines, pa.binary()), pa.array(numbers_, pa.binary())], names=["part", "lang", "words", "counts"])


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def project(docs: DataFrame, text_col: str, lang_col: str, max_words: int, parts: int) -> DataFrame:
    """part, lang, words, counts: what a task hands on to each part, packed by columns: runs of max_words words with the number of
    their occurrences, shorter at a piece's end; single words with theirs; and no word with the number of all. A prefix of two
    words is always in the same part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, total = _Numbers(), {}, 0
        end = max_words * [0]

        def flush() -> Iterator[pa.RecordBatch]:
            words = np.array(["", *list(vocabulary)[1:]], dtype=object)
            hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.int64)
            for lang, runs in held.items():
                yield _packed(lang, *(np.concatenate(x) for x in zip(*runs)), words, hashes, max_words, parts)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                for at in range(0, max(1, len(words)), STEP_WORDS):
                    some = [vocabulary[w] for w in words[at : at + STEP_WORDS + max_words - 1]] + end
                    held.setdefault(lang, []).append((np.array(some, dtype=np.int64), np.arange(len(some)) < STEP_WORDS))
                    total += len(some)
                    if total >= HELD_WORDS:
                        yield from flush()
                        vocabulary, held, total = _Numbers(), {}, 0
        yield from flush()

    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "part long, lang string, words binary, counts binary")


def unpacked(lang: str, words: bytes, counts: bytes, max_words: int) -> pa.Table:
    """lang, w1, w2.. and n of one row of project()."""
    n = np.frombuffer(_unzip(counts), dtype="<i8")
    lines = _unzip(words).decode("utf-8", "surrogatepass").split("\n")
    columns = [pa.array(lines[k * len(n) : (k + 1) * len(n)], pa.string()) for k in range(max_words)]
    return pa.table([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), dtype=np.int64))), *columns, pa.array(n)], names=["lang", *(f"w{k}" for k in range(1, max_words + 1)), "n"])


def _sums(rows: pa.Table, keys: list[str]) -> pa.Table:
    return rows.group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def extensions(projection: pa.Table, depth: int, max_words: int, least: int) -> Iterator[pa.Table]:
    """Frequent phrases (lang, phrase, words, f) of depth words and more that the occurrences of a projection begin with: counts them,
    keeps the projection of the frequent ones, and goes on to the right."""
    keys = ["lang", *(f"w{k}" for k in range(1, depth + 1))]
    here = projection.filter(pc.not_equal(projection[keys[-1]], ""))
    found = _sums(here, keys)
    found = found.filter(pc.greater_equal(found["n"], least))
    if not len(found):
        return
    phrase = pc.binary_join_element_wise(*(found[k].combine_chunks() for k in keys[1:]), " ")
    yield pa.table([found["lang"], phrase, pa.array(np.full(len(found), depth, dtype=np.int32)), found["n"]], names=["lang", "phrase", "words", "f"])
    if depth < max_words:
        yield from extensions(here.join(found.select(keys), keys, join_type="left semi", use_threads=False), depth + 1, max_words, least)


def grow(projected: DataFrame, least: int, max_words: int) -> DataFrame:
    """lang, phrase, words, f: phrases of f >= least, and the empty one with the number of all words. From rows of project() of
    which those of a part follow one another; a worker holds one part, and less once it has added up equal rows."""
    names = ["lang", *(f"w{k}" for k in range(1, max_words + 1))]

    def found(rows: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        whole = _sums(pa.concat_tables(rows), names)
        none = whole.filter(pc.equal(whole["w1"], ""))
        total = pa.table([none["lang"], none["w1"], pa.array(np.zeros(len(none), dtype=np.int32)), none["n"]], names=["lang", "phrase", "words", "f"])
        single = whole.filter(pc.and_(pc.equal(whole["w2"], ""), pc.not_equal(whole["w1"], "")))
        tables = [total, *extensions(single, 1, 1, least), *extensions(whole.filter(pc.not_equal(whole["w2"], "")), 2, max_words, least)]
        for t in tables:
            yield from t.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows = None, [], 0
        for batch in batches:
            for own, lang, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if own != part and held:
                    yield from found(held)
                    held, rows = [], 0
                part = own
                held.append(unpacked(lang, words, counts, max_words))
                rows += len(held[-1])
                if rows > HELD_ROWS:
                    held = [_sums(pa.concat_tables(held), names)]
                    rows = len(held[0]) // 2  # what has been added up counts half, so that it is not added up again and again
        if held:
            yield from found(held)

    return projected.select("part", "lang", "words", "counts").mapInArrow(run, "lang string, phrase string, words int, f long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, phrase, words, f of all phrases of up to max_words (two or more) words with f >= least; the empty phrase has all words."""
    spark = docs.sparkSession
    text_batches(spark)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chars = docs.agg(F.coalesce(F.sum(F.length(F.col(text_col))), F.lit(0))).first()[0]
    parts = tasks * max(1, -(-chars // (tasks * PART_CHARS)))  # a task takes several parts, one after another
    dealt = project(docs, text_col, lang_col, max_words, parts).repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int"))
    return grow(dealt.sortWithinPartitions("part"), least, max_words)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP, inside_percent: int = INSIDE_PERCENT, salts: int = SALTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    Candidates are phrases of two words or more with a = f(phrase) >= least. A cut after the first k words gives l and r, the counts
    of the two parts, and floor(10^6 a a / (l r)); the lowest counts, of equal ones that of the smallest k. A candidate is dropped
    if a longer one holds it and has inside_percent of its occurrences at least. Ranks go by score and a, both descending, then
    phrase in byte order, so there are no ties.

    Null languages are `und` (as rows with that language are); null and empty texts have no words; texts of any length are read
    whole, and no phrase reaches over from one row to another. Rows that repeat an id or a text count each; other columns are not
    read, whatever their names. Arithmetic is exact up to counts of 15 digits. No rows give no rows.
    """
    phrases = cut(frequent_phrases(docs, text_col, lang_col, least, max_words))
    totals = phrases.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    counts = phrases.where("words > 0")
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("_w"))
    part = lambda first, n: F.array_join(F.slice("_w", first, n), " ")
    k = F.col("k")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select("lang", "phrase", "a", "k", part(F.lit(1), k).alias("_left"), part(k + 1, F.col("words") - k).alias("_right"))
    for side in ("l", "r"):
        name = {"l": "_left", "r": "_right"}[side]
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(side)), ["lang", name])
    exact = lambda c: f"cast({c} as decimal(15, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000000 as decimal(7, 0)) * ({exact('a')} * {exact('a')})) div ({exact('l')} * {exact('r')})"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("_cut"))
    # What lies inside longer candidates, with the most frequent of these.
    starts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))))
    inner = candidates.where("words > 2").select("lang", F.col("a").alias("_f"), F.explode(F.array_distinct(starts)).alias("phrase"))
    holds = inner.groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    kept = scored.join(holds, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_f") < inside_percent * F.col("a"), F.lit(True)))
    rows = kept.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    best = salted.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_at") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
pieces AS (SELECT doc, lang, unnest(regexp_split_to_array(low, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
numbered AS (SELECT row_number() OVER () AS piece_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
words AS (SELECT piece_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM numbered),
grams AS (SELECT lang, w AS w1, w || ' ' || lead(w, 1) OVER o AS w2, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY piece_id ORDER BY i)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f AS (
  SELECT lang, w1 AS p, 1 AS size, count(*) AS f FROM grams GROUP BY ALL
  UNION ALL SELECT lang, w2, 2, count(*) FROM grams WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w3, 3, count(*) FROM grams WHERE w3 IS NOT NULL GROUP BY ALL
),
candidates AS (SELECT lang, p, size, f AS a, string_split(p, ' ') AS ws FROM f WHERE size > 1 AND f >= {LEAST}),
cuts AS (
  SELECT c.lang, c.p, c.size, c.a, 1 AS k, c.ws[1] AS x, array_to_string(c.ws[2:], ' ') AS y FROM candidates c
  UNION ALL SELECT c.lang, c.p, c.size, c.a, 2, array_to_string(c.ws[:2], ' '), c.ws[3] FROM candidates c WHERE c.size = 3
),
scored AS (
  SELECT cuts.lang, cuts.p, cuts.size, cuts.a, l.f AS l, r.f AS r, k,
    CAST((1000000::HUGEINT * cuts.a::HUGEINT * cuts.a::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.p = cuts.x JOIN f r ON r.lang = cuts.lang AND r.p = cuts.y
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT lang, q, max(a) AS f FROM (
    SELECT lang, array_to_string(ws[:2], ' ') AS q, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, array_to_string(ws[2:], ' '), a FROM candidates WHERE size = 3
  ) GROUP BY ALL
),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.q = s.p WHERE i.f IS NULL OR 100 * i.f < {INSIDE_PERCENT} * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS place FROM kept)
SELECT ranked.lang, place AS rank, p AS phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE place <= {TOP}
"""
