"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a share of the words of all sources. Whole passes over a source's documents come first; what is
left of its budget is fitted by counts: documents are counted by exact length, each length gives its share, and a
bounded-knapsack dynamic program over the remaining lengths hits the rest as nearly as sums of lengths allow. Within
a length, a seeded hash orders the documents. Rows that repeat an id and text are numbered, and the number enters the
hash, so any part of them can be taken.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.session import broadcast_small, cut

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
SEED = 20240229
#: Words of budget that the dynamic program covers; larger rests first shrink by whole documents.
DP_WORDS = 1 << 16
#: Rows of one hash bucket, on average: ranks are counted within buckets, so no task orders a whole hot length.
BUCKET_ROWS = 256
#: A plan of so many rows (under 100 bytes each) is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 400_000


def count_words(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in the text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, source_size -> also target: shares of the whole by repeating weights, none above max_passes sizes.

    With lambda words a unit of weight, a source gets min(cap, lambda * weight). Taking sources in order of
    cap / weight, lambda is the largest of (words - caps so far) / (weight still open): one pass over a table
    with a row per source, no iteration.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_passes)))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lam = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    return ranked.withColumn("_lam", lam).withColumn("target", F.least(F.col("_cap"), F.max("_lam").over(whole) * F.col("_w"))).select("source", "source_size", "target")


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each size to take, at most counts, so that the sum comes as near budget from below as sums allow.

    Sizes are distinct and positive. Each size first gives its share of all but a slack of a few documents' words; whole
    documents then shrink the rest, largest first, until the dynamic program over sums up to dp_words can fit it. Where
    that misses the budget, it is done again with more slack, up to dp_words, so budgets of up to dp_words are fitted as
    well as any choice can.
    """
    sizes, counts = np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    budget = max(0, min(int(budget), int((sizes * counts).sum())))
    if budget == 0:
        return np.zeros_like(counts)
    slack, best = min(budget, 4 * int(sizes.max()), dp_words), None
    while True:
        taken = _fit_with(sizes, counts, budget, slack, dp_words)
        if best is None or (taken * sizes).sum() > (best * sizes).sum():
            best = taken
        if int((best * sizes).sum()) == budget or slack >= min(budget, dp_words):
            return best
        slack = min(4 * slack, budget, dp_words)


def _fit_with(sizes: np.ndarray, counts: np.ndarray, budget: int, slack: int, dp_words: int) -> np.ndarray:
    total = int((sizes * counts).sum())
    taken = np.array([int(c) * (budget - slack) // total for c in counts], dtype=np.int64)
    rest = budget - int((taken * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        if rest <= dp_words:
            break
        more = min(int(counts[i] - taken[i]), max(0, rest - dp_words // 2) // int(sizes[i]))
        taken[i] += more
        rest -= more * int(sizes[i])
    if rest > dp_words:  # only documents longer than the rest are left
        dp_words = rest
    # Bounded knapsack: a bit for each reachable sum; copies of a size in powers of two.
    mask, reach, items, first = (1 << (rest + 1)) - 1, 1, [], np.full(rest + 1, -1, dtype=np.int32)
    for i in order[::-1]:
        left, size, part = int(counts[i] - taken[i]), int(sizes[i]), 1
        left = min(left, rest // size)
        while left > 0 and not (reach >> rest) & 1:
            n = min(part, left)
            fresh = (reach << (n * size)) & mask & ~reach
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes(rest // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: rest + 1]
                first[bits.astype(bool)] = len(items)
                items.append((i, n))
                reach |= fresh
            left -= n
            part *= 2
    at = reach.bit_length() - 1
    while at > 0:
        i, n = items[first[at]]
        taken[i] += n
        at -= n * int(sizes[i])
    return taken


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one source, a row for each length: adds passes (whole passes) and n_take (documents of one pass more)."""
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = min(MAX_PASSES, int(target // size)) if size else 0
    rest = int(round(target - passes * size)) if passes < MAX_PASSES else 0
    pdf = pdf.sort_values("size", ignore_index=True)
    n = np.zeros(len(pdf), dtype=np.int64)
    at = pdf["size"].to_numpy() > 0
    n[at] = fit_counts(pdf["size"].to_numpy()[at], pdf["docs"].to_numpy()[at], rest)
    return pdf.assign(passes=passes, n_take=n)[["source", "size", "docs", "source_size", "target", "passes", "n_take"]]


KEY = ("doc_id", "source", "_c")


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def hashed(rows: DataFrame, again: DataFrame, seed: int = SEED) -> DataFrame:
    """rows (doc_id, source, _c, ...) with _h: a hash of the seed, the id, the text's hash and the row's number among the
    rows that repeat all these. again holds the repeated keys.

    Repeated rows are numbered where they lie: each partition counts its own, and the counts of the partitions before give
    the first number. No task holds all rows of a key, and the hashes are the same however rows are partitioned."""
    h = lambda k: F.xxhash64(F.lit(seed), "doc_id", "_c", k)
    if again.isEmpty():
        return rows.withColumn("_h", h(F.lit(0).cast("long")))
    other = [f"_a{i}" for i in range(len(KEY))]
    known = broadcast_small(again.select(*[F.col(k).alias(x) for k, x in zip(KEY, other)]))
    once = rows.join(known, _same(KEY, other), "left_anti").withColumn("_h", h(F.lit(0).cast("long")))
    held = cut(rows.join(known, _same(KEY, other), "left_semi")).withColumn("_p", F.spark_partition_id())
    counts = held.groupBy(*KEY, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*KEY).orderBy("_p")) - F.col("_n")
    starts = counts.select(*[F.col(k).alias(x) for k, x in zip(KEY, other)], F.col("_p").alias("_q"), before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(*KEY, "_p").orderBy("_p")) - 1
    told = held.withColumn("_place", place).join(starts, _same([*KEY, "_p"], [*other, "_q"]))
    return once.unionByName(told.withColumn("_h", h((F.col("_before") + F.col("_place")).cast("long"))).select(*once.columns))


def plan_mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """From rows (source, size, _h): a row for each source and size with its source's target, whole passes and the last
    hash that one pass more takes. Rows at most: distinct lengths of each source, which grow as the root of its words."""
    lengths = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"))
    totals = broadcast_small(cut(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights)))
    fitted = cut(
        lengths.join(totals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        .groupBy("source").applyInPandas(_fit, "source string, size long, docs long, source_size long, target double, passes long, n_take long")
    )
    # The n-th hash of a length: first its bucket, by counts, then its rank in that bucket alone.
    wanted = fitted.where("n_take > 0 AND n_take < docs").withColumn("_buckets", F.ceil(F.col("docs") / BUCKET_ROWS)).withColumnRenamed("source", "_s").withColumnRenamed("size", "_z")
    wanted = broadcast_small(wanted, BROADCAST_ROWS)
    dealt = sized.join(wanted.select("_s", "_z", "n_take", "_buckets"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    dealt = dealt.withColumn("_b", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * F.col("_buckets"))).select("source", "size", "_h", "n_take", "_b")
    per = dealt.groupBy("source", "size", "n_take", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("source", "size").orderBy("_b"))
    edge = per.withColumn("_upto", upto).where("_upto >= n_take AND _upto - _n < n_take").select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_b").alias("_eb"), (F.col("n_take") - F.col("_upto") + F.col("_n")).alias("_rank"))
    at_edge = dealt.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_b") == F.col("_eb")))
    ranked = at_edge.withColumn("_r", F.row_number().over(Window.partitionBy("source", "size").orderBy("_h"))).where("_r = _rank")
    last = ranked.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_h").alias("last_hash"))
    return fitted.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left").drop("_s", "_z")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the row, repeats counted), copies, and keep's columns.

    Null texts have no words, null sources form the last source; texts of any length are counted whole, and one longer
    than its source's budget is left out. Ties: rows that repeat an id and text, or have no id, are told apart by their
    number, so some of them can be taken and others not; which of them, makes no difference to the rows returned. A source without
    words has target 0. No rows give no rows; extra columns are not read unless named in keep.
    """
    kept = [F.col(c).alias(f"_k_{c}") for c in keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_c"), *kept)
    sized = cut(rows.select("doc_id", "source", "size", "_c"))
    again = cut(sized.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*KEY))
    numbered = hashed(sized, again, seed)
    numbered = numbered if again.isEmpty() else cut(numbered)
    plan = cut(plan_mix(numbered, weights).withColumnRenamed("source", "_s").withColumnRenamed("size", "_z"))
    plan = broadcast_small(plan, BROADCAST_ROWS)
    more = (F.col("n_take") >= F.col("docs")) | ((F.col("n_take") > 0) & (F.col("_h") <= F.col("last_hash")))
    found = (hashed(rows, again, seed) if keep else numbered).join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.when(more, 1).otherwise(0)).otherwise(F.lit(0)).cast("int")
    return found.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *[F.col(f"_k_{c}").alias(f"_k_{c}") for c in keep])


def apply_mix(docs: DataFrame) -> DataFrame:
    """docs as the mix has them: each row as often as it is taken (not at all, or up to three times); columns as in docs.

    Rows without words (null, empty, white space) go. Very long texts, ties, repeated rows and rows without an id are taken
    as mix() says, each row on its own. Extra columns are kept, whatever their names. No rows give no rows.
    """
    mixed = mix(docs, keep=docs.columns)
    repeated = mixed.where("copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"_k_{c}").alias(c) for c in docs.columns])
