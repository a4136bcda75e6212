"""Documents of similar sets of word n-grams: a blocked sparse matrix product of documents by n-grams.

A document is a row of the incidence matrix, its set of distinct n-grams (64-bit hashes) the columns that are not zero. Two rows
link if their overlap reaches a percentage of their union; then it reaches that percentage of each of both, so they also share
one of the first ``size - need + 1`` columns of each in any one order of columns. Only that part of the matrix is multiplied:

* rows of equal sets are one row, known by a 128-bit digest,
* columns go by hash, but for those that more than HOT_ROWS rows hold, which go last, most frequent ones after others. A row first
  takes a quarter more columns by hash than it needs; the frequent ones among them are counted and set aside. Rows that have
  too few others, as those of large groups, are read anew with all their columns, which are counted, until no row is short,
* a block of columns is a task of the shuffle by column. It multiplies its columns, accumulating for each pair of rows that share
  some how many they share and where the last one stands. What is left in both rows behind that place bounds the overlap, and pairs
  whose bound is below the overlap that their sizes ask for are discarded; others are counted exactly,
* frequent columns are only multiplied with one row of theirs, which links large groups; where a column's rows remain in several
  classes, those outside its largest class are multiplied with all the others in blocks of BLOCK_ROWS rows. So all
  classes are found, without all pairs of a large group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.minhash import components, mix, row_key
from spanmill.session import broadcast_small, cut, delete_path, shared_dir, text_batches

SHINGLE, PERCENT = 4, 85
#: Rows from which on a column goes last, rows of a block there, and words whose hashes a worker keeps.
HOT_ROWS, BLOCK_ROWS, KEPT_WORDS = 50, 1000, 400_000
#: Frequent columns (8 bytes each) up to which they are broadcast.
MOST_LISTED = 2_000_000
#: Columns that a row takes beyond a quarter more than it needs, in case some are frequent.
SPARE = 8

_U = np.uint64


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, known: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Distinct n-grams of words as sorted 64-bit hashes; of fewer words, all of them are one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return np.zeros(0, dtype=np.int64)
    ids = np.fromiter((known[w] for w in words), dtype=_U, count=len(words))
    starts = max(1, len(words) - width + 1)
    h = np.full(starts, min(len(words), width), dtype=_U)
    for k in range(min(width, len(words))):
        h = mix(h * _U(0x9E3779B97F4A7C15) + ids[k : k + starts])
    return np.unique(h.view(np.int64))


def need(size: int, percent: int) -> int:
    """Least overlap with any similar row."""
    return (size * percent + 99) // 100


def read_rows(rows: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, row_key, set (a digest; null without words), node (its first half), size, cols (the row's first columns by hash, a
    quarter more than are multiplied)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            digests, nodes, sizes, columns = [], [], [], []
            for text in batch.column(2):
                own = shingle_set(text.as_py(), known, width)
                digest = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
                digests.append(digest)
                nodes.append(int.from_bytes(digest[:8], "little", signed=True) if digest else None)
                sizes.append(len(own))
                first = len(own) - need(len(own), percent) + 1
                columns.append(own[: first + first // 4 + SPARE] if len(own) else None)
            arrays = [pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(columns, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], names=["doc_id", "row_key", "set", "node", "size", "cols"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "row_key", "text").mapInArrow(run, f"doc_id {id_type}, row_key string, set binary, node long, size long, cols array<long>")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, to be deleted as soon as it is not needed."""
    path = f"{shared_dir(df.sparkSession)}/ngrams-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def distinct_rows(signed: DataFrame) -> DataFrame:
    """set, node (unique), size, cols and the row_key of one of the documents with this set."""
    found = signed.where("set IS NOT NULL").groupBy("set").agg(F.min("row_key").alias("row_key"), F.first("node").alias("node"), F.first("size").alias("size"), F.first("cols").alias("cols"))
    clash = cut(signed.where("set IS NOT NULL").select("node", "set").distinct().groupBy("node").count().where("count > 1").select("node"))
    if clash.isEmpty():
        return found
    moved = found.join(clash, "node", "left_semi").withColumn("node", F.col("node") + F.row_number().over(Window.partitionBy("node").orderBy("set")) - 1)
    return found.join(clash, "node", "left_anti").unionByName(moved.select(*found.columns))


def whole_rows(rows: DataFrame, matrix: DataFrame, nodes: DataFrame, width: int, repeats: bool) -> DataFrame:
    """node, size, all: all columns of the given nodes, from their texts. repeats: whether rows repeat id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), known, width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "size", "all"])

    keys = broadcast_small(cut(matrix.select("node", "row_key").join(nodes, "node", "left_semi")))
    texts = rows.select("row_key", "text").join(keys, "row_key")
    if repeats:
        texts = texts.groupBy("node").agg(F.min("text").alias("text"))
    return cut(texts.select("node", "text").mapInArrow(run, "node long, size long, all array<long>"))


def frequent_last(rows: DataFrame, matrix: DataFrame, hot_rows: int, percent: int, width: int, repeats: bool) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The entries to multiply, (col, node, size, at), of columns of few rows and of frequent ones, each row's columns in the final
    order; and the rows that were read anew, with all their columns. The last two are None if there are no such rows."""
    first = F.expr(f"cast(size - (size * {percent} + 99) div 100 + 1 as int)")
    held = matrix.select("node", "size", "cols")
    hot = cut(_frequent(held.select(F.explode("cols").alias("col")), hot_rows))
    whole, read = None, None
    while True:
        plain = without(held, hot.select("col"), percent)
        short = cut(plain.where("short").select("node"))
        fresh = short if read is None else cut(short.join(read, "node", "left_anti"))
        if fresh.isEmpty():
            break
        some = whole_rows(rows, matrix, fresh, width, repeats)
        whole = some if whole is None else whole.unionByName(some)
        read = fresh if read is None else read.unionByName(fresh)
        added = cut(_frequent(whole.select(F.explode("all").alias("col")), hot_rows).join(hot, "col", "left_anti"))
        if added.isEmpty():
            break
        hot = cut(hot.unionByName(added))
    # Rows that are short stay so as more columns are frequent, so the others are those that were not read anew.
    cold = plain.where("NOT short").select("node", "size", F.posexplode("cols").alias("at", "col")).select("col", "node", "size", "at")
    if whole is None:
        return cold, None, None
    mine = whole.select("node", F.explode("all").alias("col")).join(broadcast_small(hot), "col").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "col"))).alias("_hot"))
    none = F.array().cast("array<struct<df: bigint, col: bigint>>")
    known = whole.join(mine, "node", "left").withColumn("_hot", F.coalesce("_hot", none))
    rare = F.transform(F.array_except("all", F.transform("_hot", lambda x: x["col"])), lambda c: F.struct(F.lit(0).cast("long").alias("df"), c.alias("col")))
    again = known.select("node", "size", F.posexplode(F.slice(F.concat(rare, F.col("_hot")), F.lit(1), first)).alias("at", "_e"))
    again = cut(again.select(F.col("_e.col").alias("col"), "node", "size", "at", (F.col("_e.df") > 0).alias("hot")))
    return cold.unionByName(again.where("NOT hot").drop("hot")), again.where("hot").drop("hot"), whole


def without(held: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """node, size, cols, short: of each row (node, size, cols) the first columns that are not hot (col), as many as are multiplied;
    short if there are fewer."""
    if hot.limit(MOST_LISTED + 1).count() > MOST_LISTED:
        first = F.expr(f"cast(size - (size * {percent} + 99) div 100 + 1 as int)")
        met = held.select("node", F.explode("cols").alias("col")).join(hot, "col").groupBy("node").agg(F.collect_list("col").alias("_hot"))
        cold = F.array_except("cols", F.coalesce("_hot", F.array().cast("array<bigint>")))
        return held.join(met, "node", "left").select("node", "size", cold.alias("cols"), first.alias("_first")).select("node", "size", F.slice("cols", F.lit(1), F.col("_first")).alias("cols"), (F.size("cols") < F.col("_first")).alias("short"))
    listed = held.sparkSession.sparkContext.broadcast(np.append(np.sort(hot.toArrow()["col"].to_numpy()), np.iinfo(np.int64).max))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = listed.value
        for batch in batches:
            flat, lengths = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.diff(batch.column(2).offsets.to_numpy())
            size = batch.column(1).to_numpy()
            first = size - (size * percent + 99) // 100 + 1
            owner = np.repeat(np.arange(len(size)), lengths)
            at = np.searchsorted(known, flat)
            cold = (known[at] != flat) | (at == len(known) - 1)
            before = np.cumsum(cold) - cold  # cold columns up to here, of all rows
            rows = np.bincount(owner[cold], minlength=len(size))
            place = before - (np.cumsum(rows) - rows)[owner]
            take = cold & (place < first[owner])
            ends = np.append(0, np.cumsum(np.bincount(owner[take], minlength=len(size))))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[take], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(rows < first)], names=["node", "size", "cols", "short"])

    return held.mapInArrow(run, "node long, size long, cols array<long>, short boolean")


def _frequent(entries: DataFrame, hot_rows: int) -> DataFrame:
    return entries.groupBy("col").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > hot_rows)


def multiply(cold: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link, from the entries of columns of few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 4

        def pairs(parts: list[np.ndarray]) -> pa.RecordBatch:
            col, node, size, at = parts
            new = np.flatnonzero(np.r_[True, col[1:] != col[:-1]]) if len(col) else np.zeros(0, dtype=np.int64)
            lengths = np.diff(np.r_[new, len(col)])
            left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for n in np.unique(lengths[lengths > 1]).tolist():
                i, j = np.triu_indices(n, 1)
                begin = new[lengths == n][:, None]
                left.append((begin + i).ravel())
                right.append((begin + j).ravel())
            x, y = np.concatenate(left), np.concatenate(right)
            fits = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
            x, y = x[fits], y[fits]
            return pa.RecordBatch.from_arrays([pa.array(c[z]) for c, z in ((node, x), (node, y), (size, x), (size, y), (at, x), (at, y))], names=["a", "b", "na", "nb", "ia", "ib"])

        for batch in batches:
            parts = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            if not len(parts[0]):
                continue
            end = int(np.searchsorted(parts[0], parts[0][-1]))  # the last column may go on
            held = [p[end:] for p in parts]
            yield pairs([p[:end] for p in parts])
        yield pairs(held)

    placed = cold.select("col", "node", "size", F.col("at").cast("long").alias("at")).repartition("col").sortWithinPartitions("col", "node")
    met = placed.mapInArrow(run, "a long, b long, na long, nb long, ia long, ib long")
    counted = met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"), F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    bound = F.col("shared") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1
    # overlap >= percent / (100 + percent) of both sizes is what percent of the union asks for
    return counted.where((100 + percent) * bound >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def linked(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact overlap."""
    # Of each side only the rows that are asked for, so that no others are shuffled.
    asked = whole.join(broadcast_small(cut(pairs.select(F.col("a").alias("node")).distinct())), "node", "left_semi")
    a, b = (x.select(F.col("node").alias(k), F.col("all").alias(f"_{k}")) for k, x in (("a", asked), ("b", whole)))
    overlap = b.join(broadcast_small(pairs), "b").join(a, "a").select("a", "b", F.size(F.array_intersect("_a", "_b")).alias("_both"), (F.size("_a") + F.size("_b")).alias("_sizes"))
    return overlap.where((100 + percent) * F.col("_both") >= percent * F.col("_sizes")).select("a", "b")


def block_product(asking: list[np.ndarray], asked: list[np.ndarray], labels: np.ndarray, asked_labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(asking, asked) places: for each asking row one linked row of each other label. Columns of the asked rows are an
    inverted index; overlaps are accumulated row by row."""
    sizes = np.array([len(x) for x in asked], dtype=np.int64)
    flat, owner = np.concatenate(asked), np.repeat(np.arange(len(asked)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found = []
    for i, own in enumerate(asking):
        low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
        counts = high - low
        at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        both = np.bincount(owner[at], minlength=len(asked))
        hits = np.flatnonzero(((100 + percent) * both >= percent * (len(own) + sizes)) & (asked_labels != labels[i]))
        found += [(i, int(hits[j])) for j in np.unique(asked_labels[hits], return_index=True)[1]]
    return found


def late_links(classed: DataFrame, whole: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """Links (a, b) between classes that share a frequent column, from its rows (col, node, label)."""
    sums = classed.groupBy("col", "label").agg(F.count(F.lit(1)).alias("_n")).groupBy("col")
    sums = cut(sums.agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "label")).alias("_top"), F.count(F.lit(1)).alias("_labels")).where("_labels > 1"))
    part = lambda n: F.greatest(F.lit(1), F.ceil(n / block_rows)).cast("int")
    sums = sums.select("col", F.col("_top.label").alias("_major"), part(F.col("_all")).alias("_of"), part(F.col("_all") - F.col("_top._n")).alias("_by"))
    dealt = classed.join(broadcast_small(sums), "col")
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    asking = dealt.where("label <> _major").select("col", mine(F.col("_by")).alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_j"), "node", "label", F.lit(True).alias("asks"))
    asked = dealt.select("col", F.explode(F.sequence(F.lit(0), F.col("_by") - 1)).alias("_i"), mine(F.col("_of")).alias("_j"), "node", "label", F.lit(False).alias("asks"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        found = block_product(list(p["all"]), list(q["all"]), p["label"].to_numpy(), q["label"].to_numpy(), percent) if len(p) and len(q) else []
        a, b = p["node"].to_numpy(), q["node"].to_numpy()
        return pd.DataFrame([(min(a[i], b[j]), max(a[i], b[j])) for i, j in found], columns=["a", "b"]).astype("int64")

    meet = asking.unionByName(asked)
    some = broadcast_small(cut(meet.select("node").distinct()))
    return meet.join(whole.select("node", "all").join(some, "node", "left_semi"), "node").groupBy("col", "_i", "_j").applyInPandas(run, "a long, b long").distinct()


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = SHINGLE, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, the row's own included).

    Documents without words (null, empty, white space) have an empty set and link with nothing. Texts of any length are read
    whole. Ties: equal sets link. Rows that repeat an id are rows of their own; rows without an id link as well, but
    component_id is null only where nothing reachable has one. Other columns are not read, whatever their names. No rows give no
    rows. N-grams are told apart by 64 bits, sets by 128.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    read, read_at = stored(read_rows(rows, percent, width))
    signed = cut(read.select("doc_id", "row_key", "set", "size"))
    repeats = not signed.groupBy("row_key").count().where("count > 1").isEmpty()
    wide, wide_at = stored(distinct_rows(read))
    delete_path(spark, read_at)
    matrix = cut(wide.select("set", "node", "row_key"))
    cold, hot, whole = frequent_last(rows, wide, hot_rows, percent, width, repeats)
    pairs = multiply(cold, percent)
    if hot is not None:
        centre = cut(hot.groupBy("col").agg(F.min(F.struct("node", "size")).alias("_c")))
        fits = 100 * F.least("size", "_c.size") >= percent * F.greatest("size", "_c.size")
        star = hot.join(broadcast_small(centre), "col").where("node <> _c.node").where(fits).select(F.col("_c.node").alias("a"), F.col("node").alias("b"))
        pairs = pairs.unionByName(star).distinct()
    pairs = cut(pairs)
    delete_path(spark, wide_at)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if whole is None:
        whole = whole_rows(rows, matrix, wanted, width, repeats)
    else:
        whole = whole.unionByName(whole_rows(rows, matrix, wanted.join(whole.select("node"), "node", "left_anti"), width, repeats))
    # A pair for each row first; of the other pairs those that this has not put into one class.
    tried = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = cut(linked(tried, whole, percent))
    labels = components(links)
    rest = pairs.join(tried, ["a", "b"], "left_anti")
    for k in "ab":
        rest = rest.join(broadcast_small(labels.select(F.col("node").alias(k), F.col("label").alias(f"_{k}"))), k, "left")
    rest = cut(rest.where("NOT coalesce(_a, a) <=> coalesce(_b, b)").select("a", "b"))
    if not rest.isEmpty():
        more = cut(linked(rest, whole, percent))
        links = links.unionByName(more)
        labels = components(links)
    if hot is not None:
        classed = hot.select("col", "node").join(broadcast_small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
        late = cut(late_links(classed, whole, percent, block_rows))
        if not late.isEmpty():
            labels = components(links.unionByName(late))
    named = signed.join(matrix.select("set", F.col("node").alias("_node")), "set", "left").join(labels.select(F.col("node").alias("_node"), "label"), "_node", "left")
    named = cut(named.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("label", "_node").alias("_class")))
    least = named.where("_class IS NOT NULL").groupBy("_class").agg(F.min("doc_id").alias("_least"))
    out = named.join(least, "_class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


OP12_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM texts WHERE len(ws) > 0)
),
sets AS (SELECT DISTINCT doc_id, g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT texts.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, least(texts.doc_id, coalesce(min(reach.b), texts.doc_id)) AS component_id
FROM texts LEFT JOIN sizes ON sizes.doc_id = texts.doc_id LEFT JOIN reach ON reach.a = texts.doc_id GROUP BY texts.doc_id
"""
