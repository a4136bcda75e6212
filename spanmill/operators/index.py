"""A stored keyword index (words and character trigrams, with places) and its upkeep as documents come, change and go.

Below a folder:

* ``postings/segment=N/kind=K``: packed postings, one row for each term of a block of documents: term, block, slots (of the block's
  documents that have it), sizes (how many places each), places; the last three as gaps in bytes (see pack). Each file is sorted by
  term, so a query's terms are a few pages of it. Documents are indexed where they are read, so nothing is shuffled. ``kind=docs``
  names a block's documents. A segment is written once.
* ``state/run=N``: the documents as of a run: doc, id, rows (equal ones), segment, block, slot, and their lengths. What a segment
  holds of documents that have changed or gone since is passed over, because reading joins it with the state, which it needs for the
  lengths anyway.
* ``runs/run=N``: one row, written last: corpus figures and the segments in use. The highest run counts; a run that was
  interrupted before it is done anew, over the same folders.

A run writes new and changed documents as one new segment, and with it what is left of the segments that are no larger, from
their postings. So segments grow geometrically, their number with the logarithm of the documents, and a document is rewritten as
often at most. All of it is plain Parquet below explicit paths; one writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from spanmill.functions import text as tx
from spanmill.session import broadcast_small, cut, delete_path, text_batches

KINDS = ("words", "trigrams")
RUN = "documents long, words double, trigrams double, segments array<struct<segment: int, documents: bigint>>, dropped array<int>, run int"
#: What a segment's files hold; segment and kind come from their folders.
PACKED = "term string, block long, slots binary, sizes binary, places binary"
#: Code points of texts of a block (one text at least), and bytes of places that are unpacked at once.
BLOCK_CHARS, UNPACK_BYTES = 2_000_000, 1 << 20
#: Letters of Latin-1 without their accents, as token_words folds them, by code point.
FOLDED = np.arange(256)
FOLDED[[ord(c) for c in tx.ACCENTED]] = [ord(c) for c in tx.PLAIN]


def doc_key(ident: Column, text: Column) -> Column:
    """128 bits that stand for an id and its text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.coalesce(ident.cast("string"), F.lit("\u0000")), F.lit("\u001f"), text), 256), 1, 32))


def pack(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Values from 0 on as bytes of seven bits, the last one of each below 128; a row from each of begins on."""
    widths = np.ones(len(values), dtype=np.int64)
    for bits in (7, 14, 21, 28):
        widths += values >= 1 << bits
    ends = np.cumsum(widths)
    out = np.zeros(ends[-1] if len(ends) else 0, dtype=np.uint8)
    for k in range(5):
        at = np.flatnonzero(widths > k)
        out[ends[at] - widths[at] + k] = values[at] >> 7 * k & 127 | np.where(widths[at] > k + 1, 128, 0)
    offsets = np.append((ends - widths)[begins], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpack(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values that pack took, and how many of them each row has."""
    rows = rows.cast(pa.binary())
    offsets = np.frombuffer(rows.buffers()[1], dtype=np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    data = np.frombuffer(rows.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    last = data < 128
    ends = np.flatnonzero(last) + 1
    widths = np.diff(ends, prepend=0)
    values = np.zeros(len(ends), dtype=np.int64)
    for k in range(5):
        at = np.flatnonzero(widths > k)
        values[at] |= (data[ends[at] - widths[at] + k] & 127).astype(np.int64) << 7 * k
    return values, np.diff(np.append(0, np.cumsum(last))[offsets - offsets[0]])


def _begins(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _gaps(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    out = np.diff(values, prepend=0)
    out[begins] = values[begins]
    return out


def _sums(gaps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    upto = np.append(0, np.cumsum(gaps))
    return upto[1:] - np.repeat(upto[_begins(counts)], counts)


def _packed(slots: np.ndarray, codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Of tokens (slot, code, place), by slot and place: the distinct codes, and slots, sizes and places of each, packed."""
    order = np.argsort(codes.astype(np.uint16) if codes.max(initial=0) < 1 << 16 else codes, kind="stable")
    slots, codes, places = slots[order], codes[order], places[order]
    terms = np.ones(len(codes), dtype=bool)
    terms[1:] = codes[1:] != codes[:-1]
    docs = terms.copy()
    docs[1:] |= slots[1:] != slots[:-1]
    at_term, at_doc = np.flatnonzero(terms), np.flatnonzero(docs)
    first = np.searchsorted(at_doc, at_term)
    return codes[at_term], [pack(_gaps(slots[at_doc], first), first), pack(np.diff(np.append(at_doc, len(codes))), first), pack(_gaps(places, at_doc), at_term)]


def _flat(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of each of the elements of lists of these lengths."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(_begins(lengths), lengths)


@cache
def word_chars() -> bytes:
    """Bits of the code points that words consist of, as Spark's regular expressions have them (see token_words)."""
    points = SparkSession.active().range(0x110000).where("id < 55296 OR id > 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    bits = np.zeros(0x110000, dtype=np.uint8)
    bits[points.where(char.rlike(f"^{tx.WORD_CHARS}$")).agg(F.collect_list("id")).first()[0]] = 1
    return np.packbits(bits).tobytes()


def _words(points: np.ndarray, owner: np.ndarray, chars: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-case texts, given as code points and their texts' numbers: words, and their texts' numbers."""
    folded = np.where(points < len(FOLDED), FOLDED[np.minimum(points, len(FOLDED) - 1)], points)
    inside = chars[folded]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
    held = folded[inside]
    widths = 1 + (held >= 0x80) + (held >= 0x800) + (held >= 0x10000)
    offsets = np.append(_begins(widths)[starts[inside]], widths.sum()).astype(np.int32)
    data = held.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)), owner[starts]


def _word_rows(words: pa.Array, owner: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, list[pa.Array]]:
    coded = words.dictionary_encode()
    codes, columns = _packed(owner, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.arange(len(owner)) - np.repeat(_begins(counts), counts))
    return coded.dictionary.take(pa.array(codes)), columns


def _trigram_rows(points: np.ndarray, lengths: np.ndarray) -> tuple[pa.Array, list[pa.Array]]:
    owner, place = _flat(lengths)
    whole = np.flatnonzero(place + 2 < np.repeat(lengths, lengths))
    coded = pa.array(points[whole] << 42 | points[whole + 1] << 21 | points[whole + 2]).dictionary_encode()
    found, columns = _packed(owner[whole], coded.indices.to_numpy(zero_copy_only=False), place[whole])
    codes = coded.dictionary.to_numpy()[found]
    chars = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4")
    return pa.array(np.ascontiguousarray(chars).view("<U3").ravel().tolist(), pa.string()), columns


def postings_of(texts: DataFrame, kinds: Sequence[str] = KINDS, run: int = 0) -> DataFrame:
    """kind and PACKED of rows (doc, text), each doc once, in blocks of the order they come in. Rows of kind docs hold a block's
    docs one after another in slots, and their numbers of words and trigrams in sizes and places."""
    low = F.lower("text")
    read = texts.select("doc", low.alias("low"), (F.length(low) + 16).alias("chars"))
    bits = word_chars()

    def rows(kind: str, block: int, terms: pa.Array, columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(terms), pa.string()), terms, pa.array([block] * len(terms), pa.int64()), *columns], names=["kind", "term", "block", "slots", "sizes", "places"])

    def of_block(block: int, held: pa.Table) -> Iterator[pa.RecordBatch]:
        held = held.combine_chunks().to_batches()[0]
        low = held.column("low").to_pylist()
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        lengths = np.array([len(t) for t in low], dtype=np.int64)
        words, owner = _words(points, np.repeat(np.arange(len(low)), lengths), np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).view(bool))
        n_words = np.bincount(owner, minlength=len(low))
        sizes = [pack(n, np.array([0])) for n in (n_words, np.maximum(lengths - 2, 0))]
        yield rows("docs", block, pa.nulls(1, pa.string()), [pa.array([b"".join(held.column("doc").to_pylist())], pa.binary()), *sizes])
        if "words" in kinds and len(words):
            yield rows("words", block, *_word_rows(words, owner, n_words))
        if "trigrams" in kinds and lengths.max() > 2:
            yield rows("trigrams", block, *_trigram_rows(points, lengths))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = run << 40 | TaskContext.get().partitionId() << 20
        held, chars = [], 0
        for batch in batches:
            begin = 0
            for at, more in enumerate(batch.column("chars").to_pylist()):
                if chars and chars + more > BLOCK_CHARS:
                    yield from of_block(block, pa.Table.from_batches([*held, batch.slice(begin, at - begin)]))
                    block, held, chars, begin = block + 1, [], 0, at
                chars += more
            held.append(batch.slice(begin))
        if sum(len(h) for h in held):
            yield from of_block(block, pa.Table.from_batches(held))

    return read.mapInArrow(index, "kind string, " + PACKED)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Packed rows, some at a time: rows, documents of each, slots, places of each document, places."""
    bytes_ = np.cumsum([len(p.as_buffer()) for p in batch.column("places")])
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(bytes_, (bytes_[begin - 1] if begin else 0) + UNPACK_BYTES, "right")))
        part = batch.slice(begin, end - begin)
        sizes, docs = unpack(part.column("sizes"))
        yield part, docs, _sums(unpack(part.column("slots"))[0], docs), sizes, _sums(unpack(part.column("places"))[0], sizes)
        begin = end


def unpacked(postings: DataFrame) -> DataFrame:
    """term, block, slot, places of packed postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, docs, slots, sizes, places in _parts(batch):
                row = pa.array(np.repeat(np.arange(len(docs)), docs))
                lists = pa.ListArray.from_arrays(pa.array(np.append(_begins(sizes), len(places)), pa.int32()), pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("term").take(row), part.column("block").take(row), pa.array(slots, pa.int32()), lists], names=["term", "block", "slot", "places"])

    return postings.select(*[c.split(" ")[0] for c in PACKED.split(", ")]).mapInArrow(run, "term string, block long, slot int, places array<int>")


def occurrences(postings: DataFrame) -> DataFrame:
    """term, block, slot, tf, first_place, last_place of packed postings: how often, and where first and last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, docs, slots, sizes, places in _parts(batch):
                row, first = pa.array(np.repeat(np.arange(len(docs)), docs)), _begins(sizes)
                columns = [pa.array(slots, pa.int32()), pa.array(sizes), pa.array(places[first]), pa.array(places[first + sizes - 1])]
                yield pa.RecordBatch.from_arrays([part.column("term").take(row), part.column("block").take(row), *columns], names=["term", "block", "slot", "tf", "first_place", "last_place"])

    return postings.select(*[c.split(" ")[0] for c in PACKED.split(", ")]).mapInArrow(run, "term string, block long, slot int, tf long, first_place long, last_place long")


def _left_of(postings: DataFrame, live: DataFrame) -> DataFrame:
    """Packed postings (kind, PACKED) without documents other than live ones (block, slot)."""
    blocks = live.groupBy("block").agg(F.collect_set("slot").alias("_live"), F.max("slot").alias("top"))
    blocks = cut(blocks.select("block", "top", F.array_except(F.sequence(F.lit(0), "top"), "_live").alias("dead")))
    names = ["kind", *(c.split(" ")[0] for c in PACKED.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, docs, slots, sizes, places in _parts(batch):
                row = np.repeat(np.arange(len(docs)), docs)
                dead, tops = part.column("dead"), part.column("top").to_numpy(zero_copy_only=False)
                dead_keys = np.repeat(np.arange(len(docs)), np.diff(dead.offsets.to_numpy())) << 32 | dead.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                keep = (slots <= tops[row]) & ~np.isin(row << 32 | slots, dead_keys)
                if not keep.any():
                    continue
                kept_rows, docs_left = np.unique(row[keep], return_counts=True)
                places, sizes, slots = places[np.repeat(keep, sizes)], sizes[keep], slots[keep]
                first, at_doc = _begins(docs_left), _begins(sizes)
                columns = [pack(_gaps(slots, first), first), pack(sizes, first), pack(_gaps(places, at_doc), at_doc[first])]
                yield pa.RecordBatch.from_arrays([part.column(n).take(pa.array(kept_rows)) for n in ("kind", "term", "block")] + columns, names=names)

    joined = postings.where("kind <> 'docs'").join(broadcast_small(blocks, 10_000), "block")
    return joined.select(*names, "top", "dead").mapInArrow(run, "kind string, " + PACKED)


def _documents_of(postings: DataFrame) -> DataFrame:
    """doc, block, slot, words, trigrams of packed rows of kind docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, docs in enumerate(batch.column("slots").to_pylist()):
                words, trigrams = (unpack(batch.column(n).slice(i, 1))[0] for n in ("sizes", "places"))
                each = pa.array([docs[k : k + 16] for k in range(0, len(docs), 16)], pa.binary())
                yield pa.RecordBatch.from_arrays([each, pa.array([batch.column("block")[i].as_py()] * len(each), pa.int64()), pa.array(np.arange(len(each)), pa.int32()), pa.array(words), pa.array(trigrams)], names=["doc", "block", "slot", "words", "trigrams"])

    return postings.select("block", "slots", "sizes", "places").mapInArrow(run, "doc binary, block long, slot int, words long, trigrams long")


def _segments(spark: SparkSession, folder: str, segments: Sequence[int]) -> DataFrame:
    schema = f"{PACKED}, segment int, kind string"
    if not segments:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/postings").parquet(*[f"{folder}/postings/segment={s}" for s in segments])


def last_run(spark: SparkSession, folder: str) -> Row | None:
    """The run that counts, or None where there is none yet."""
    try:
        return spark.read.schema(RUN).parquet(f"{folder}/runs").orderBy(F.desc("run")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class Index:
    """An index as of its last run: postings of a kind (term, block, slot, places), lengths (doc, id, rows, segment, block, slot,
    words, trigrams) and totals (documents, and their average lengths)."""

    def __init__(self, folder: str, spark: SparkSession):
        self.totals = last_run(spark, folder)
        if self.totals is None:
            raise ValueError(f"no index at {folder}")
        self.lengths = spark.read.parquet(f"{folder}/state/run={self.totals['run']}")
        self.packed = _segments(spark, folder, [s["segment"] for s in self.totals["segments"]])

    def postings(self, kind: str, terms: Sequence[str] | None = None) -> DataFrame:
        """The postings of some terms, or of all; those of documents that are not in lengths any more as well."""
        mine = self.packed.where(F.col("kind") == kind)
        return unpacked(mine if terms is None else mine.where(F.col("term").isin(*terms)))

    def occurrences(self, kind: str) -> DataFrame:
        """The same without the places: of all terms, how often and where first and last they stand."""
        return occurrences(self.packed.where(F.col("kind") == kind))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("id", text.alias("text"), doc_key(F.col("id"), text).alias("doc"))


def _counted(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("doc").agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("rows"))


def refresh(docs: DataFrame, folder: str, kinds: Sequence[str] = KINDS) -> dict:
    """Bring the index to docs (id, text) as they are: what is new or changed is read, what is gone goes.

    Null texts count as empty. Ids that repeat with several texts are several documents; rows that repeat id and text are counted.
    Returns what was done; a run that finds nothing to do writes nothing.
    """
    keyed = _keyed(docs)
    current = cut(_counted(keyed))
    return _run(docs.sparkSession, folder, keyed, current, current.count(), kinds)


def upsert(added: DataFrame, folder: str, removed: DataFrame | None = None, kinds: Sequence[str] = KINDS) -> dict:
    """Take added (id, text) in place of what the index has under these ids, and take removed (id) out. Nothing else is read
    but the state."""
    spark = added.sparkSession
    keyed = _keyed(added)
    fresh = cut(_counted(keyed))
    named = fresh.count()
    last = last_run(spark, folder)
    if last is not None:
        touched = added.select("id") if removed is None else added.select("id").unionByName(removed.select("id"))
        state = spark.read.parquet(f"{folder}/state/run={last['run']}")
        touched = touched.distinct().withColumnRenamed("id", "_id")
        fresh = state.join(touched, F.col("id").eqNullSafe(F.col("_id")), "left_anti").select("doc", "id", "rows").unionByName(fresh)
    return _run(spark, folder, keyed, cut(fresh), named, kinds)


def _once(keyed: DataFrame, fresh: DataFrame, whole: bool) -> DataFrame:
    """doc, text of the documents of fresh (doc, rows), each once; whole: those are all of keyed. Only rows of documents that repeat
    are shuffled, or if fresh is too many to be sent to all."""
    texts = keyed.select("doc", "text")
    if not whole:
        texts = texts.join(broadcast_small(fresh.select("doc")), "doc", "left_semi")
    repeats = fresh.where("rows > 1").select("doc")
    if repeats.isEmpty():
        return texts
    repeats = broadcast_small(repeats)
    return texts.join(repeats, "doc", "left_anti").unionByName(texts.join(repeats, "doc", "left_semi").dropDuplicates(["doc"]))


def _run(spark: SparkSession, folder: str, keyed: DataFrame, current: DataFrame, named: int, kinds: Sequence[str]) -> dict:
    """Make the state's documents those of current (doc, id, rows); texts of new ones are in keyed, which has so many documents."""
    text_batches(spark)
    last = last_run(spark, folder)
    run = 0 if last is None else last["run"] + 1
    if last is None:
        fresh, kept, changed, gone = current, None, 0, 0
    else:
        state = spark.read.parquet(f"{folder}/state/run={last['run']}")
        fresh = cut(current.join(state, "doc", "left_anti"))
        kept = cut(state.withColumnRenamed("rows", "_rows").join(current.select("doc", "rows"), "doc"))
        changed = kept.where("rows <> _rows").count()
        gone = state.count() - kept.count()
    arrived = fresh.count()
    done = {"run": run, "new": arrived, "gone": gone, "recounted": changed, "folded": []}
    if last is not None and not (arrived or changed or gone):
        return done | {"run": last["run"], "written": False}

    left = {} if kept is None else {r["segment"]: r["count"] for r in kept.groupBy("segment").count().collect()}  # a row a segment
    fold, size = [], arrived
    if arrived:
        for segment in sorted(left, key=lambda s: (left[s], s)):
            if left[segment] > size:
                break
            fold.append(segment)
            size += left[segment]
        found = postings_of(_once(keyed, fresh, arrived == named), kinds, run)
        if fold:
            found = found.unionByName(_left_of(_segments(spark, folder, fold), kept.where(F.col("segment").isin(*fold))))
        found.sortWithinPartitions("kind", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/postings/segment={run}")
        read = _documents_of(_segments(spark, folder, [run]).where("kind = 'docs'"))
        after = fresh.join(read, "doc").select("doc", "id", "rows", F.lit(run).alias("segment"), "block", "slot", "words", "trigrams")
        if kept is not None:
            moved = F.when(F.col("segment").isin(*fold), F.lit(run)).otherwise(F.col("segment")) if fold else F.col("segment")
            after = after.unionByName(kept.withColumn("segment", moved).select(*after.columns))
    elif kept is None:
        after = current.select("doc", "id", "rows", F.lit(run).alias("segment"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("trigrams"))
    else:
        after = kept.select("doc", "id", "rows", "segment", "block", "slot", "words", "trigrams")
    after.write.mode("overwrite").parquet(f"{folder}/state/run={run}")

    held = spark.read.parquet(f"{folder}/state/run={run}")
    mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col("rows")) / F.sum("rows"), F.lit(0.0)).alias(c)
    sums = held.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("documents"), mean("words"), mean("trigrams"))
    sizes = {s: n for s, n in left.items() if s not in fold} | ({run: size} if size else {})
    used = F.array(*[F.struct(F.lit(s).alias("segment"), F.lit(n).cast("long").alias("documents")) for s, n in sorted(sizes.items())]).cast("array<struct<segment: int, documents: bigint>>")
    dropped = [s["segment"] for s in (last["segments"] if last else []) if s["segment"] not in sizes]
    row = sums.select("*", used.alias("segments"), F.array(*[F.lit(s) for s in dropped]).cast("array<int>").alias("dropped"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs/run={run}")
    if last is not None:  # what the run before this one no longer used; that run itself may still be read
        for segment in last["dropped"]:
            delete_path(spark, f"{folder}/postings/segment={segment}")
        delete_path(spark, f"{folder}/state/run={last['run'] - 1}")
    return done | {"folded": fold, "written": True}


def build_index(docs: DataFrame, folder: str) -> Index:
    """The index of docs (id, text) at folder, made or brought up to date."""
    refresh(docs, folder)
    return Index(folder, docs.sparkSession)
