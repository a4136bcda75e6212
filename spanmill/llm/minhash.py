"""Near-duplicate detection with BagMinHash signatures.

A document is a multiset of five-word shingles. Weights are whole numbers, cut into dyadic levels [0,1), [1,2), [2,4)
and so on; every level of a shingle has a Poisson process of its own whose points fall on random components, and a
point counts if its place within the level lies below the weight. A component keeps its earliest point, so two
signatures agree in a component with the probability of their weighted Jaccard similarity, without bias. A process
stops as soon as its next point is later than every component's: long documents need little more than a point for
each shingle.

Rows of equal words are one representative, known by a 128-bit digest of its words, so ids may repeat, be null or of any
type. Representatives that agree in a band of the signature meet in a bucket. Each is verified by exact multiset overlap
against its bucket's smallest digest, and links are joined to classes. Where a
bucket still holds several classes, those outside its largest one are held against all its members by counting shared
shingles in an inverted index, block by block, without writing pairs out. So no link between bucket members is lost
that would join two classes, and a large group of copies costs a verification for each member and bucket.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.exact_dedup import brought_back, one_row_each, set_aside
from spanmill.session import broadcast_small, cut, delete_path, shared_dir, shuffles_released, text_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 meets in some band with probability 1 - (1 - 0.8^4)^20 > 0.9999.
BANDS, BAND_ROWS = 20, 4
SIZE = BANDS * BAND_ROWS
#: Words handled at once, and words whose hashes a worker keeps.
CHUNK_WORDS, CHUNK_DOCS, KEPT_WORDS = 300_000, 4096, 400_000
#: Documents of a block where classes of one bucket are compared.
BLOCK_DOCS = 1000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), in wrapping arithmetic."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1) from the upper 53 bits."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


class WordHashes(dict):
    """Word -> 64-bit hash, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, multiplicity) of up to CHUNK_DOCS documents given as word hashes, sorted by document and hash.

    A document of fewer than SHINGLE words is one shingle of all its words; one of no words has none.
    """
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    words = np.array([h for d in docs for h in d], dtype=_U)
    owner = np.repeat(np.arange(len(docs)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words))  # words from here to the document's end
    whole = np.repeat(lengths, lengths)
    start = (left >= SHINGLE) | (left == whole) & (whole < SHINGLE)
    h = np.zeros(len(words), dtype=_U)
    for k in range(SHINGLE):
        part = np.zeros(len(words), dtype=_U)
        part[: max(0, len(words) - k)] = words[k:]
        h = mix(h * _U(0x9E3779B97F4A7C15) + np.where(left > k, part, _U(k + 1)))
    keys = np.sort((owner[start].astype(_U) << _U(52)) | (h[start] >> _U(12)))  # one plain sort; 52 bits tell a document's shingles apart
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    keys = keys[at]
    return (keys >> _U(52)).astype(np.int64), keys << _U(12), np.diff(np.append(at, len(start.nonzero()[0])))


def bag_minhash(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, size: int = SIZE) -> np.ndarray:
    """Earliest points, documents x components; infinite where a document has no shingle."""
    first = np.full((docs, size), np.inf)
    flat = first.reshape(-1)
    top = int(weight.max()).bit_length() if len(weight) else 0
    seeds, owners, rates, lows, weights = [], [], [], [], []
    for level in range(top + 1):
        low, rate = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        at = weight > low
        if not at.any():
            break
        seeds.append(mix(h[at] + _U(level * 0xD1B54A32D192ED03 % 2**64)))
        owners.append(owner[at])
        rates.append(np.full(at.sum(), float(rate)))
        lows.append(np.full(at.sum(), float(low)))
        weights.append(weight[at].astype(np.float64))
    if not seeds:
        return first
    seed, own, rate, low, weight = (np.concatenate(x) for x in (seeds, owners, rates, lows, weights))
    x = np.zeros(len(seed))
    while len(seed):
        seed = mix(seed + _U(0x9E3779B97F4A7C15))
        x = x - np.log(uniform(seed)) / rate
        draw = mix(seed ^ _U(0xA0761D6478BD642F))
        component = ((draw >> _U(32)) % _U(size)).astype(np.int64)
        place = low + rate * ((draw & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        counts = place < weight
        np.minimum.at(flat, own[counts] * size + component[counts], x[counts])
        latest = first.max(axis=1)
        alive = x < latest[own]
        seed, own, rate, low, weight, x = seed[alive], own[alive], rate[alive], low[alive], weight[alive], x[alive]
    return first


def band_hashes(first: np.ndarray) -> np.ndarray:
    """documents x BANDS hashes; a point is known by its time to 24 bits, the same on every machine."""
    bits = first.astype(np.float32).view(np.uint32).astype(_U).reshape(len(first), BANDS, BAND_ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(first), BANDS)).copy()
    for k in range(BAND_ROWS):
        h = mix(h * _U(0x9E3779B97F4A7C15) + bits[:, :, k] + _U(1))
    return h


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that stand for a row's id and text."""
    ident, text = F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    return F.concat_ws("-", F.hex(F.xxhash64(ident, text)), F.hex(F.xxhash64(F.lit(1), text, ident)))


def signatures(docs: DataFrame) -> DataFrame:
    """From rows (doc_id, row_key, text): doc_id, row_key, words (a 128-bit digest of the word sequence), node (its first half),
    size (shingles) and bands; the last four are null for a document without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts = batch.column(2)
            at = 0
            while at < len(texts):
                begin, digests, rows, total = at, [], [], 0
                while at < len(texts) and total < CHUNK_WORDS and len(rows) < CHUNK_DOCS:
                    words = WORD.findall(texts[at].as_py() or "")
                    digests.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")) if words else None)
                    rows.append([known[w] for w in words])
                    total += len(words)
                    at += 1
                h = band_hashes(bag_minhash(*shingles(rows), len(rows))).view(np.int64)
                bands = [b if d is not None else None for b, d in zip(h, digests)]
                nodes = [int.from_bytes(d[:8], "little", signed=True) if d is not None else None for d in digests]
                sizes = [max(1, len(r) - SHINGLE + 1) if r else None for r in rows]
                cols = [pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, at - begin) for c in batch.columns[:2]), *cols], names=["doc_id", "row_key", "words", "node", "size", "bands"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row_key", "text").mapInArrow(run, f"doc_id {id_type}, row_key string, words binary, node long, size int, bands array<long>")


def representatives(signed: DataFrame) -> DataFrame:
    """words, node, size, bands and first (of the rows with these words the one of the smallest id, then key). Nodes are unique:
    word sequences that share the first half of their digests get the next numbers."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    found = cut(signed.where("words IS NOT NULL").groupBy("words").agg(first, F.first("node").alias("node"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    clash = cut(found.groupBy("node").count().where("count > 1").select("node"))
    if clash.isEmpty():
        return found
    one_more = found.join(clash, "node", "left_semi").withColumn("node", F.col("node") + F.row_number().over(Window.partitionBy("node").orderBy("words")) - 1)
    return cut(found.join(clash, "node", "left_anti").unionByName(one_more.select(*found.columns)))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with sim, their exact weighted Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = WordHashes(), (None, None)

        def bag(text: str):
            return shingles([[known[w] for w in WORD.findall(text)]])[1:]

        for batch in batches:
            sims = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if last[0] != a:
                    last = (a, bag(ta.as_py()))
                (ha, wa), (hb, wb) = last[1], bag(tb.as_py())
                _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                both = int(np.minimum(wa[i], wb[j]).sum())
                sims.append(both / (int(wa.sum()) + int(wb.sum()) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    ta, tb = (texts.select(F.col("node").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    return pairs.select("a", "b").join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, sim double")


def tokens_of(text: str, known: WordHashes) -> np.ndarray:
    """Distinct tokens of a document, sorted: its shingles with their copies numbered, which makes a multiset a set."""
    _, h, w = shingles([[known[x] for x in WORD.findall(text)]])
    copy = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    return np.sort(mix(np.repeat(h, w) + copy.astype(_U)))


def block_links(probes: list[np.ndarray], built: list[np.ndarray], probe_labels: np.ndarray, labels: np.ndarray, similarity: float) -> list[tuple[int, int, float]]:
    """(probe, built, similarity): for each probe its most similar document of each other label that reaches the similarity.

    An inverted index of the built documents counts the overlaps; pairs are not written out.
    """
    sizes = np.array([len(t) for t in built])
    flat, owner = np.concatenate(built), np.repeat(np.arange(len(built)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found = []
    for i, tokens in enumerate(probes):
        lo, hi = np.searchsorted(flat, tokens), np.searchsorted(flat, tokens, side="right")
        counts = hi - lo
        total = int(counts.sum())
        if not total:
            continue
        at = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(total)
        both = np.bincount(owner[at], minlength=len(built))
        sim = both / (len(tokens) + sizes - both)
        hits = np.flatnonzero((sim >= similarity) & (labels != probe_labels[i]))
        best: dict[int, int] = {}
        for j in hits[np.argsort(-sim[hits], kind="stable")].tolist():
            best.setdefault(int(labels[j]), j)
        found += [(i, j, float(sim[j])) for j in best.values()]
    return found


def mixed_links(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b, sim) between nodes of different labels in the same bucket, from rows (bucket, node, label, size): enough
    of them to join every two classes that any pair of a bucket links.

    Nodes of a bucket's most frequent label are looked up, the others look up. Sizes fall into classes that grow by
    1 / similarity, so similar nodes are of the same or of neighbouring classes, and no others meet. Within a class each
    side is dealt into blocks of about BLOCK_DOCS, so no task holds a large bucket, and what is looked up is sent once for each
    block of those that look up, which are few beside a large class.
    """
    sized = rows.withColumn("_c", F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(1 / similarity) + 1e-9)).cast("int"))
    major = sized.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("_n")).groupBy("bucket").agg(F.max_by("label", F.struct("_n", "label")).alias("_major"))
    counted = sized.join(broadcast_small(cut(major)), "bucket").withColumn("_probes", F.col("label") != F.col("_major"))
    blocks = lambda n: F.ceil(n / BLOCK_DOCS).cast("int")
    parts = counted.groupBy("bucket", "_c").agg(blocks(F.count(F.lit(1))).alias("_n"), blocks(F.count_if("_probes")).alias("_p"))
    listed = lambda n: F.map_from_entries(F.collect_list(F.when(F.col(n) > 0, F.struct("_c", n))))
    parts = parts.groupBy("bucket").agg(listed("_n").alias("_built"), listed("_p").alias("_asking"))
    dealt = counted.join(broadcast_small(cut(parts)), "bucket")
    here, around = F.col("_c"), F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1)

    def side(own: str, others: str) -> tuple[Column, Column]:
        """A node's block on its own side, and those of the other side that it meets."""
        mine = F.struct(here.alias("c"), F.pmod(F.xxhash64("node"), F.element_at(own, here)).cast("int").alias("j"))
        near = F.filter(around, lambda c: F.map_contains_key(others, c))
        return mine, F.explode(F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), F.element_at(others, c) - 1), lambda j: F.struct(c.alias("c"), j.alias("j"))))))

    has, asks = side("_built", "_asking")
    built = dealt.select("bucket", has.alias("_has"), asks.alias("_asks"), "node", "label", F.lit(False).alias("probe"))
    asks, has = side("_asking", "_built")
    probes = dealt.where("_probes").select("bucket", has.alias("_has"), asks.alias("_asks"), "node", "label", F.lit(True).alias("probe"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, has = pdf[pdf["probe"]], pdf[~pdf["probe"]]
        if not len(ask) or not len(has):
            return pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})
        known, seen = WordHashes(), {}
        for node, text in zip(pdf["node"], pdf["text"]):
            if node not in seen:
                seen[node] = tokens_of(text, known)
        p, q = ask["node"].to_numpy(), has["node"].to_numpy()
        found = block_links([seen[d] for d in p], [seen[d] for d in q], ask["label"].to_numpy(), has["label"].to_numpy(), similarity)
        return pd.DataFrame([(min(p[i], q[j]), max(p[i], q[j]), s) for i, j, s in found], columns=["a", "b", "sim"]).astype({"a": "int64", "b": "int64", "sim": "float64"})

    wanted = built.unionByName(probes)
    return wanted.join(texts, "node").groupBy("bucket", "_has", "_asks").applyInPandas(run, "a long, b long, sim double").dropDuplicates(["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node that links lead to) of links (a, b); labels jump, so chains halve in a round."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        met = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("_near", "label")).alias("_low"))
        jump = labels.select(F.col("node").alias("_low"), F.col("label").alias("_jump"))
        after = cut(met.join(jump, "_low", "left").select("node", F.col("label").alias("_was"), F.least("_low", F.coalesce("_jump", "_low")).alias("label")))
        if after.where("label <> _was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest id of the class), copy_id (smallest id of equal words), links (verified links of its
    representative), kept.

    Documents without words (null, empty, white space) are classes of their own and kept. Texts of any length are read
    whole. Ties and repeats: rows of equal words are one representative, whatever their ids; an id repeated with
    different texts is in the class of each of them; of rows that share a class's smallest id one text is kept, that of the
    smallest digest, and rows that repeat id and text share a verdict. Rows without an id join classes as well, but are kept
    only where no row of their class has one. Ids may be of any type that can be ordered. Other columns are not read,
    whatever their names. No rows give no rows.
    """
    return _verdicts(docs, id_col, text_col, similarity).drop("row_key", "worded")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """What near_duplicates returns, with each row's key and whether it has words."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    signed = cut(signatures(rows))
    copies = representatives(signed)
    dealt = cut(copies.select("node", F.explode("bands").alias("bucket")))
    # Computed before the join, which Spark can then split where a bucket is large.
    buckets = cut(dealt.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket", "a"))
    members = cut(dealt.join(buckets, "bucket").select("bucket", "a", F.col("node").alias("b")))

    where = f"{shared_dir(spark)}/near-texts-{uuid.uuid4().hex}"
    involved = copies.select("node", "first.row_key").join(members.select(F.col("b").alias("node")).distinct(), "node")
    with shuffles_released(spark):
        rows.select("row_key", "text").join(involved, "row_key").groupBy("node").agg(F.min("text").alias("text")).write.parquet(where)
    texts = spark.read.parquet(where)

    checked = cut(verify(members.where("a <> b").select("a", "b").distinct(), texts))
    links = checked.where(F.col("sim") >= similarity)
    labels = components(links)
    # Buckets of several classes: pairs of different classes that have not met yet and may be similar.
    classed = members.join(labels.withColumnRenamed("node", "b"), "b", "left").select("bucket", "a", F.col("b").alias("node"), F.coalesce("label", "b").alias("label"))
    mixed = classed.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("_n")).where("_low <> _high AND _n > 2").select("bucket")
    mixed = broadcast_small(cut(mixed))
    sizes = copies.select("node", "size")
    late = cut(mixed_links(classed.join(mixed, "bucket").select("bucket", "node", "label").join(sizes, "node"), texts, similarity))
    delete_path(spark, where)
    if not late.isEmpty():
        links = links.unionByName(late)
        labels = components(links)
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    linked = copies.select("words", "node", "first").join(labels, "node")
    winners = linked.groupBy("label").agg(F.min(F.struct("first.*", "words")).alias("winner"))
    reps = copies.select("words", "node", "first").join(labels.join(winners, "label").select("node", "winner"), "node", "left").join(degree, "node", "left")
    reps = reps.select("words", "first", F.coalesce("winner", F.struct("first.*", "words")).alias("winner"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    found = signed.select("doc_id", "row_key", "words").join(reps, "words", "left")
    worded = F.col("words").isNotNull()
    return found.select(
        "doc_id", F.when(worded, F.col("winner.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(worded, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("copy_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        F.when(worded, (F.col("row_key") == F.col("winner.row_key"))).otherwise(F.lit(True)).alias("kept"), "row_key", worded.alias("worded"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate class, as near_duplicates keeps them; columns as in docs.

    The verdict is on the row, by id and text, so other texts of a dropped row's id stay where they are of another class. Rows
    without words (null, empty) stay. Of rows that repeat id and text, the smallest by the other columns that can be ordered
    stays. Texts of any length are read whole; extra columns are kept, whatever their names. No rows give no rows.
    """
    verdicts = cut(_verdicts(docs, id_col, text_col, SIMILARITY).select("row_key", "kept", "worded").groupBy("row_key", "kept", "worded").agg(F.count(F.lit(1)).alias("_rows")))
    held = set_aside(docs)
    keyed = held.withColumn("_row_key", row_key(f"_k_{id_col}", f"_k_{text_col}"))
    dropped = verdicts.where("NOT kept").select(F.col("row_key").alias("_row_key"))
    again = cut(verdicts.where("kept AND worded AND _rows > 1").select(F.col("row_key").alias("_row_key")))
    return brought_back(one_row_each(keyed.join(dropped, "_row_key", "left_anti"), again, ["_row_key"], held.schema, f"_k_{text_col}"), docs)
