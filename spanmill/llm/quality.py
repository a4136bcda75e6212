"""Quality rules: fixed rules, then robust multivariate outliers.

Documents of a language and source are compared by a vector of transformed statistics. Location and scatter come from
minimum-covariance-determinant estimates, in three parts:

1. each group is dealt into chunks of about CHUNK_ROWS rows by a hash; in a chunk, concentration steps from several starts
   (medians, and random small subsets) run until the determinant no longer falls, and the half of the best start enters
   the group's first estimate by its moments;
2. concentration steps over all rows: the half of a group's rows nearest to its estimate, by the median of their
   distances, gives the next one, until no group's determinant falls any more. A step is one pass over the statistics, its
   sums are combined where the rows are;
3. one reweighting: rows within a chi-square quantile give the final estimate.

The scatter of a part of the rows is multiplied by what makes it consistent for normal rows. Every estimate is drawn
towards that of the group's language, and this one towards that of all documents, with the weight of PRIOR_ROWS rows: a
small group rests on its language, a large one on itself, without a switch between them. FLOOR keeps a statistic that
hardly varies among a group's documents from making every small deviation an outlier; it is small enough that each
statistic can reject by itself. A document whose squared Mahalanobis distance exceeds the chi-square cutoff is rejected.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.exact_dedup import brought_back, set_aside
from spanmill.session import SMALL_ROWS, cut, text_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
STATS = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate")
P = len(STATS)
#: Standard deviations that a statistic has at least, on its transformed scale.
FLOOR = np.array([0.06, 0.25, 0.24, 0.096, 0.12, 0.20])
#: Squared distance beyond which a document is an outlier: chi-square with P degrees of freedom, upper tail 1e-6.
CUTOFF = 38.26
#: Squared distance up to which rows enter the estimates again: upper tail 1e-5. Half of all rows lie within MEDIAN.
WITHIN, MEDIAN = 33.0, 5.348
#: Rows of a chunk; rows that a language's estimate counts for in its sources' ones, and that of all in a language's.
CHUNK_ROWS, PRIOR_ROWS = 1000, 100.0
#: Random starts of a chunk beside the medians'; passes over all rows at most, and the fall of log determinants that ends them.
STARTS, PASSES, LEAST_FALL = 8, 12, 1e-3
MOMENTS = 1 + P + P * (P + 1) // 2
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def count_repeats(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    k = len(number)
    if k == n:
        return 0
    pairs = ids[:-2] * k + ids[1:-1]
    if k > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    codes = pairs * k + ids[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(n, dtype=bool)
    mark[:-2] |= twice
    mark[1:-1] |= twice
    mark[2:] |= twice
    return int(mark.sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the transformed statistics."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(SYMBOLS.findall(text))
    dup = 0
    lines = 0
    seen: set[str] = set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = count_repeats(words)
    if not n:
        return 0, chars, symbols, dup, repeats, [0.0] * P
    upper = sum(map(str.isupper, words)) / n
    bang = text.count("!") / n
    stats = [math.log(chars / n), math.log1p(20 * symbols / n), math.log1p(10 * dup / lines), math.asin(math.sqrt(min(1.0, repeats / n))), math.asin(math.sqrt(upper)), math.log1p(20 * bang)]
    return n, chars, symbols, dup, repeats, stats


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(3)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.list_(pa.float64()))],
                names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"],
            )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {id_type}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>")


def moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0), [(x[:, i] * x[:, j]).sum() for i, j in PAIRS]])


def consistency(cutoff: float) -> float:
    """What the scatter of normal rows within a squared distance is to be multiplied with to be that of all of them (P is even)."""
    terms = [math.exp(-cutoff / 2) * (cutoff / 2) ** k / math.factorial(k) for k in range(P // 2 + 1)]
    return (1 - sum(terms[:-1])) / (1 - sum(terms))


def centre(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean and scatter of summed moments."""
    n = max(m[0], 1.0)
    mean, cov = m[1 : 1 + P] / n, np.zeros((P, P))
    for v, (i, j) in zip(m[1 + P :] / n, PAIRS):
        cov[i, j] = cov[j, i] = v - mean[i] * mean[j]
    return m[0], mean, cov


def drawn(own: tuple, towards: tuple, rows: float) -> tuple[float, np.ndarray, np.ndarray]:
    """own (rows, mean, scatter) averaged with so many rows of another's mean and scatter."""
    (n, mean, cov), (_, other, scatter) = own, towards
    if n + rows <= 0:
        return own
    return n + rows, (n * mean + rows * other) / (n + rows), (n * cov + rows * scatter) / (n + rows)


def estimate(m: np.ndarray, within: float = MEDIAN) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter (made consistent for rows within a squared distance, with the floor) from summed moments."""
    _, mean, cov = centre(m)
    return mean, finished(cov, within)


def finished(cov: np.ndarray, within: float) -> np.ndarray:
    return consistency(within) * cov + np.diag(FLOOR**2)


def distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d)


def settle(x: np.ndarray, half: np.ndarray) -> tuple[float, np.ndarray]:
    """Concentration steps from a subset of rows until the determinant no longer falls: its logarithm and the rows reached."""
    h = half_of(len(x))
    best = math.inf
    while True:
        mean, cov = estimate(moments(x[half]))
        det = float(np.linalg.slogdet(cov)[1])
        if det >= best - 1e-9:
            return best, held
        if len(half) == h:
            best, held = det, half
        half = np.argsort(distances(x, mean, cov), kind="stable")[:h]


def half_of(n: int) -> int:
    return (n + P + 1) // 2 if n > P + 1 else n


def concentrate(x: np.ndarray, starts: int = STARTS) -> np.ndarray:
    """Moments of the half of x with the smallest determinant that concentration steps reach from any start: the rows nearest
    to the medians, and random subsets of P + 1 rows (from a fixed seed)."""
    h = half_of(len(x))
    scale = np.maximum(1.4826 * np.median(np.abs(x - np.median(x, axis=0)), axis=0), FLOOR)
    begin = [np.argsort((((x - np.median(x, axis=0)) / scale) ** 2).sum(1), kind="stable")[:h]]
    if len(x) > P + 1:
        g = np.random.default_rng(len(x))
        begin += [g.choice(len(x), P + 1, replace=False) for _ in range(starts)]
    return moments(x[min((settle(x, half) for half in begin), key=lambda found: found[0])[1]])


def _chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    m = concentrate(np.array(pdf["x"].to_list(), dtype=np.float64))
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "source": [pdf["source"].iloc[0]], "m": [m]})


def _sums(col: str) -> list:
    return [F.sum(F.element_at(col, i + 1)).alias(f"_m{i}") for i in range(MOMENTS)]


def _gather(frame: DataFrame, keys: list[str], col: str = "m") -> DataFrame:
    return frame.groupBy(*keys).agg(*_sums(col)).select(*keys, F.array(*[f"_m{i}" for i in range(MOMENTS)]).alias("m"))


def _sent(by_group: DataFrame, few: bool) -> DataFrame:
    """A table of a row for each group, with a broadcast hint if they are few."""
    return F.broadcast(by_group) if few else by_group


def _judge(stats: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """stats with d2, the squared distance by their group's estimate; few says that the groups are few enough to broadcast."""
    joined = stats.join(_sent(params.select("lang", "source", "mean", "inverse"), few), ["lang", "source"])
    d = [F.element_at("x", i + 1) - F.element_at("mean", i + 1) for i in range(P)]
    terms = [F.element_at("inverse", k + 1) * d[i] * d[j] for k, (i, j) in enumerate(PAIRS)]
    return joined.withColumn("d2", sum(terms[1:], terms[0])).drop("mean", "inverse")


def _inner(stats: DataFrame, params: DataFrame, within: float | None, few: bool) -> DataFrame:
    """The moments of each group's rows near its estimate, summed where the rows are before they are shuffled: of those within a
    squared distance, or without one of the nearer half."""
    judged = _judge(stats, params, few)
    if within is None:
        # Halves by counts of distances in fine bins, which add up; a bin spans 0.1 % of its distance.
        judged = judged.withColumn("_bin", F.round(F.log1p("d2") * 1000).cast("int"))
        bins = judged.groupBy("lang", "source", "_bin").agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy("lang", "source")
        upto = bins.withColumns({"_upto": F.sum("_n").over(w.orderBy("_bin")), "_all": F.sum("_n").over(w)})
        half = upto.where(f"_upto >= least(_all, ceil((_all + {P + 1}) / 2.0))").groupBy("lang", "source").agg(F.min("_bin").alias("_edge"))
        judged = judged.join(_sent(half, few), ["lang", "source"]).where("_bin <= _edge")
    else:
        judged = judged.where(F.col("d2") <= within)
    x = [F.element_at("x", i + 1) for i in range(P)]
    sums = [F.count(F.lit(1)).cast("double"), *map(F.sum, x), *(F.sum(x[i] * x[j]) for i, j in PAIRS)]
    summed = judged.groupBy("lang", "source").agg(*[v.alias(f"_m{k}") for k, v in enumerate(sums)])
    return summed.select("lang", "source", F.array(*[f"_m{k}" for k in range(MOMENTS)]).alias("m"))


def _drawn(groups: DataFrame, prior_rows: float, within: float) -> DataFrame:
    """lang, source, and the estimate from the moments of each group, with prior_rows rows of its language's and in those as many
    of all: det (logarithm of the scatter's determinant), mean, and inverse (of the scatter, its upper half, pairs doubled).
    The moments are computed once, as three queries read them."""
    groups = cut(groups)
    by_lang = _gather(groups, ["lang"]).withColumnRenamed("m", "_ml")
    overall = groups.groupBy().agg(*_sums("m")).select(F.array(*[f"_m{i}" for i in range(MOMENTS)]).alias("_mo"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for m, ml, mo in zip(pdf["m"], pdf["_ml"], pdf["_mo"]):
                _, mean, cov = drawn(centre(np.asarray(m)), drawn(centre(np.asarray(ml)), centre(np.asarray(mo)), prior_rows), prior_rows)
                found.append((mean, finished(cov, within)))
            inverses = [np.linalg.inv(cov) for _, cov in found]
            upper = [[float(v[i, j]) * (1 if i == j else 2) for i, j in PAIRS] for v in inverses]
            yield pd.DataFrame({"lang": pdf["lang"], "source": pdf["source"], "det": [float(np.linalg.slogdet(cov)[1]) for _, cov in found], "mean": [mean for mean, _ in found], "inverse": upper})

    joined = groups.join(by_lang, "lang").select("lang", "source", "m", "_ml", overall.scalar().alias("_mo"))
    return joined.mapInPandas(run, "lang string, source string, det double, mean array<double>, inverse array<double>")


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, prior_rows: float = PRIOR_ROWS, chunk_rows: int = CHUNK_ROWS, passes: int = PASSES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (squared Mahalanobis).

    Null texts have no words and fail the base rules. Null languages and sources form groups of their own, with the
    empty string. Documents that fail the base rules stay out of the estimates. With no document to estimate from,
    the base rules alone decide. Texts of any length are read whole. Ties: rows at the same distance are on the same side of
    every bound. Rows that repeat an id are judged each on their own; other columns are not read. No rows give no rows.
    A warning says so if the concentration steps have not settled after so many passes.
    """
    text_batches(docs.sparkSession)
    stats = cut(measured(docs, id_col, text_col, lang_col, source_col))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    good = stats.where(~F.col("base_failed")).select("lang", "source", "doc_id", "n_words", "x")
    counts = cut(good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")))
    # A shuffle by group alone would satisfy the grouping by chunk below and bring a hot group to one task.
    few = counts.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS  # every table by group has these groups or fewer
    chunked = good.join(_sent(counts, few), ["lang", "source"])
    chunk = F.pmod(F.xxhash64("doc_id", "n_words", "x"), F.ceil(F.col("rows") / chunk_rows))
    halves = chunked.select("lang", "source", chunk.alias("_chunk"), "x").groupBy("lang", "source", "_chunk").applyInPandas(_chunk, "lang string, source string, m array<double>")
    params = cut(_drawn(_gather(halves, ["lang", "source"]), prior_rows, MEDIAN))
    vectors = good.select("lang", "source", "x")
    for _ in range(passes):
        after = cut(_drawn(_inner(vectors, params, None, few), prior_rows, MEDIAN))
        old = params.select("lang", "source", F.col("det").alias("_det"))
        fall = after.join(old, ["lang", "source"]).agg(F.max(F.col("_det") - F.col("det"))).first()[0]
        if fall is None or fall <= LEAST_FALL:
            break
        params = after
    else:
        warnings.warn(f"concentration steps have not settled after {passes} passes: determinants still fall by {fall:.4f}", stacklevel=2)
    params = cut(_drawn(_inner(vectors, params, WITHIN, few), prior_rows, WITHIN))
    fields = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keyed = stats.select("lang", "source", *fields, "base_failed", "x")
    passed = _judge(keyed.where(~F.col("base_failed")), params, few)
    rest = keyed.where("base_failed").withColumn("d2", F.lit(None).cast("double"))
    return passed.unionByName(rest).select(*fields, "base_failed", (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"), F.col("d2").alias("distance"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """docs without what judge_quality rejects; columns as in docs.

    The verdict is on the row: rows are judged under a key of id, language, source and text, all that a verdict depends
    on, so other rows of a rejected row's id stay, and so do rows without an id. Null texts go, texts of any length are read
    whole, rows that repeat all these share a verdict. Extra columns are kept, whatever their names. No rows give no rows.
    """
    id_, text, lang, source = (f"_k_{c}" for c in (id_col, text_col, lang_col, source_col))
    fields = F.to_json(F.struct(F.col(id_).alias("i"), F.col(lang).alias("l"), F.col(source).alias("s")))
    keyed = set_aside(docs).withColumn("_row_key", F.sha2(F.concat(fields, F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), 256))
    bad = judge_quality(keyed, "_row_key", text, lang, source, **options).where(~F.col("kept")).select(F.col("doc_id").alias("_row_key"))
    return brought_back(keyed.join(bad, "_row_key", "left_anti"), docs)
