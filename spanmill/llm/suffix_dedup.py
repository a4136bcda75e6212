"""Removal of byte strings that occur elsewhere, with a logarithmic family of suffix arrays.

Every string of LENGTH bytes that starts at two or more places is removed at each of them. Suffixes are sparse: a
place is sampled if the hash of its GRAM bytes is the least among LENGTH - GRAM + 1 neighbouring places, so equal
strings hold equal samples at equal offsets, and every such string holds one. What surrounds a sample, at most
LENGTH - GRAM bytes before and LENGTH after its start, is its context.

1. Samples are counted by hash (combined before the shuffle). A hash that occurs once matches nothing.
2. Equal contexts (by 128 bits: two hashes of their bytes) are combined. One that occurs twice is covered whole.
3. All distinct contexts of a hash that has several go to an index, dealt by hash, so a task has an index family for its
   share of the sampled suffixes. Contexts arrive in batches. A batch becomes a suffix array, ordered by the bytes that
   follow, with the lengths of the prefixes that neighbours share; it is scanned for long matches inside and merge-scanned
   against the levels present; levels of equal size merge, so a suffix is copied a logarithmic number of times. Matches
   are read off the bytes themselves: shared prefixes after the sample, and before it.
   A hash with more than HOT_CONTEXTS distinct contexts is matched by distributed counts of its strings instead.
4. A document's covered intervals are united and cut out.

Only hashes of samples and the contexts of step 3 are shuffled by content; whole texts are shuffled by id alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.session import cut, delete_path, shared_dir, text_batches

LENGTH, GRAM = 200, 50
BEFORE = LENGTH - GRAM
#: Contexts of a batch, and samples of a record batch.
BATCH, SAMPLE_ROWS = 2048, 50_000
#: Distinct contexts of one hash beyond which they are matched by counting their strings across tasks, not in one index.
HOT_CONTEXTS = 50_000
_U = np.uint64
_BYTES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.int64).astype(_U)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place, by doubling: 50 = 32 + 16 + 2."""

    def both(a: np.ndarray, b: np.ndarray, n: int, odd: int) -> np.ndarray:
        x = a[: n] * _U(odd) + b[: n]
        return x ^ (x >> _U(29))

    n, h, width, parts = len(data), _BYTES[data], 1, {}
    while width <= GRAM:
        parts[width] = h
        if 2 * width <= GRAM:
            h = both(h, h[width:], n - 2 * width + 1, 0x9E3779B97F4A7C15)
        width *= 2
    at, out, left = 0, None, GRAM
    for width in sorted(parts, reverse=True):
        if left >= width:
            piece = parts[width][at : at + n - GRAM + 1]
            out = piece if out is None else both(out, piece, n - GRAM + 1, 0xC2B2AE3D27D4EB4F)
            at, left = at + width, left - width
    return out * _U(0xFF51AFD7ED558CCD) ^ (out >> _U(32))


def sliding(op, x: np.ndarray, width: int, fill: int) -> np.ndarray:
    """op over x[i : i + width] for each i (len(x) - width + 1 values), in two running passes over blocks."""
    n = len(x)
    blocks = -(-n // width)
    full = np.full(blocks * width, fill, dtype=x.dtype)
    full[:n] = x
    grid = full.reshape(blocks, width)
    ahead = op.accumulate(grid, axis=1).reshape(-1)
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[: n - width + 1], ahead[width - 1 : n])


def samples(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): each place whose hash is the least of some window of BEFORE + 1 places."""
    h = gram_hashes(data)
    least = sliding(np.minimum, h, BEFORE + 1, 2**64 - 1)
    padded = np.concatenate([np.zeros(BEFORE, _U), least, np.zeros(BEFORE, _U)])
    at = np.flatnonzero(sliding(np.maximum, padded, BEFORE + 1, 0) == h)
    return at, h


def context_digests(raw: bytes, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A digest of each sample's context: from the grams that tile it, or of its bytes where the document cuts it short."""
    n = len(raw)
    whole = (at >= BEFORE) & (at + LENGTH <= n)
    out = np.zeros(len(at), dtype=_U)
    p, x = at[whole], np.zeros(int(whole.sum()), dtype=_U)
    for offset in range(-BEFORE, LENGTH, GRAM):
        x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9) + h[p + offset]
    out[whole] = x ^ (x >> _U(33))
    for i in np.flatnonzero(~whole):
        a = max(0, int(at[i]) - BEFORE)
        out[i] = xxhash.xxh3_64_intdigest(raw[a : at[i] + LENGTH], seed=1 + int(at[i]) - a)
    return out


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of two byte grids: how many bytes they agree in from the first on."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def as_strings(grid: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(grid).view(f"S{grid.shape[1]}").reshape(-1)


def neighbours(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a grid's rows, and the length of the prefix that each row but the first shares with the one before."""
    order = np.argsort(as_strings(grid), kind="stable")
    rows = grid[order]
    return order, shared_prefix(rows[1:], rows[:-1])


class Contexts:
    """Contexts as rows: the bytes before the sample, nearest first, and those from it on, padded, and their numbers."""

    def __init__(self, ids: np.ndarray, before: np.ndarray, after: np.ndarray, n_before: np.ndarray, n_after: np.ndarray):
        self.ids, self.before, self.after, self.n_before, self.n_after = ids, before, after, n_before, n_after

    def take(self, at: np.ndarray) -> Contexts:
        return Contexts(self.ids[at], self.before[at], self.after[at], self.n_before[at], self.n_after[at])

    def with_(self, other: Contexts) -> Contexts:
        return Contexts(*(np.concatenate([x, y]) for x, y in zip(self.columns(), other.columns())))

    def columns(self) -> tuple:
        return self.ids, self.before, self.after, self.n_before, self.n_after

    def __len__(self) -> int:
        return len(self.ids)


class Level:
    """A suffix array: contexts in the order of the bytes that follow from the sample on."""

    def __init__(self, held: Contexts):
        self.held = held
        self.keys = as_strings(held.after)
        self.grams = as_strings(held.after[:, :GRAM])

    @classmethod
    def of(cls, new: Contexts) -> Level:
        return cls(new.take(np.argsort(as_strings(new.after), kind="stable")))

    def merged(self, other: Level) -> Level:
        """Both arrays merged: each suffix of the other goes in front of the first that is not less."""
        at = np.searchsorted(self.keys, other.keys) + np.arange(len(other))
        mine = np.ones(len(self) + len(other), dtype=bool)
        mine[at] = False
        out = []
        for x, y in zip(self.held.columns(), other.held.columns()):
            both = np.empty((len(mine), *x.shape[1:]), dtype=x.dtype)
            both[mine], both[at] = x, y
            out.append(both)
        return Level(Contexts(*out))

    def meeting(self, other: Level) -> Contexts | None:
        """The contexts of both whose suffixes agree in the sample's bytes; None if there are none."""
        lo, hi = np.searchsorted(self.grams, other.grams), np.searchsorted(self.grams, other.grams, side="right")
        theirs = np.flatnonzero(hi > lo)
        if not len(theirs):
            return None
        step = np.zeros(len(self) + 1, dtype=np.int64)
        np.add.at(step, lo[theirs], 1)
        np.add.at(step, hi[theirs], -1)
        return self.held.take(np.flatnonzero(np.cumsum(step[:-1]) > 0)).with_(other.held.take(theirs))

    def __len__(self) -> int:
        return len(self.held)


def long_matches(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, least, greatest): of the contexts that have a string of LENGTH bytes around the sample which another one has at
    the same place, the least and the greatest number of bytes by which such a string starts before the sample.

    Suffixes are ordered by what follows from the sample on, and again by what goes before it. Two of them hold the string
    that starts t bytes before if they lie in one run of neighbours that share LENGTH - t bytes here and t bytes there.
    """
    order, shared = neighbours(c.after)
    near = shared >= GRAM
    alone = ~(np.append(False, near) | np.append(near, False))
    if alone.any():
        c = c.take(np.sort(order[~alone]))
        if not len(c):
            return c.ids, c.ids, c.ids
        order, shared = neighbours(c.after)
    n = len(c)
    back, shared_back = neighbours(c.before)
    least, greatest = np.full(n, LENGTH + 1), np.full(n, -1)
    run, run_back = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for t in range(BEFORE + 1):
        at = np.flatnonzero((c.n_before >= t) & (c.n_after >= LENGTH - t))
        if len(at) < 2:
            continue
        run[order[1:]] = np.cumsum(shared < LENGTH - t)
        run_back[back[1:]] = np.cumsum(shared_back < t)
        key = run_back[at] * n + run[at]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        if same.any():
            hit = at[by[np.append(False, same) | np.append(same, False)]]
            least[hit] = np.minimum(least[hit], t)
            greatest[hit] = t
    found = np.flatnonzero(greatest >= 0)
    return c.ids[found], least[found], greatest[found]


class IndexFamily:
    """Suffix arrays of growing size. add() gives a batch its suffix array, finds its long matches inside it, merge-scans it
    against all levels for others, and lets levels of equal size merge, so a suffix is copied a logarithmic number of times."""

    def __init__(self):
        self.levels: list[Level] = []
        self.low: np.ndarray = np.zeros(0, dtype=np.int64)  # least and greatest matched distance of each context so far
        self.high: np.ndarray = np.zeros(0, dtype=np.int64)

    def _found(self, ids: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> None:
        self.low[ids] = np.minimum(self.low[ids], least)
        self.high[ids] = np.maximum(self.high[ids], greatest)

    def add(self, before: np.ndarray, after: np.ndarray, n_before: np.ndarray, n_after: np.ndarray) -> None:
        n, base = len(after), len(self.low)
        self.low, self.high = np.append(self.low, np.full(n, LENGTH + 1)), np.append(self.high, np.full(n, -1))
        new = Level.of(Contexts(np.arange(base, base + n), before, after, n_before, n_after))
        self._found(*long_matches(new.held))
        for level in self.levels:
            both = level.meeting(new)
            if both is not None:
                self._found(*long_matches(both))
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) <= len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merged(b))

    def reach(self) -> list[tuple[int, int]]:
        """For each context in the order it came: how far before and after its sample strings reach that another has too; (-1, -1)
        for none. All these strings hold the sample, so what they cover is one interval."""
        return [(int(h), LENGTH - int(low)) if h >= 0 else (-1, -1) for low, h in zip(self.low, self.high)]


def hot_matches(contexts: DataFrame) -> DataFrame:
    """What the index finds, for hashes of too many distinct contexts for one task: every string of LENGTH bytes of a context is
    counted by hash, distance and the hashes of its two parts, combined before the shuffle."""
    distance = F.sequence(F.lit(0), F.col("before"))
    strings = contexts.select("h", "dg", F.explode(distance).alias("t"), "around", "after").where(F.col("after") >= LENGTH - F.col("t"))
    keyed = strings.select("h", "dg", "t", F.xxhash64(F.substring("around", F.lit(1), F.col("t"))).alias("_x"), F.xxhash64(F.substring("around", F.lit(BEFORE + 1), LENGTH - F.col("t"))).alias("_y"))
    twice = cut(keyed.groupBy("h", "t", "_x", "_y").agg((F.min("dg") != F.max("dg")).alias("_more")).where("_more").drop("_more"))
    found = keyed.join(twice, ["h", "t", "_x", "_y"]).groupBy("h", "dg").agg(F.max("t").alias("a"), (LENGTH - F.min("t")).alias("b"))
    return found.select("h", "dg", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))


def unite(spans: np.ndarray, n: int) -> np.ndarray:
    """Maximal intervals of spans (rows of start, end), clipped to [0, n); touching ones join."""
    spans = np.clip(spans, 0, n)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """df in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out._path = path
    return out


def _let_go(*stored: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in stored:
        delete_path(df.sparkSession, df._path)


def _binaries(grid: np.ndarray) -> pa.Array:
    n, width = grid.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(grid.tobytes())])


def _grid(column: pa.Array) -> np.ndarray:
    """The rows of a binary column of equal lengths."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(column), BEFORE + LENGTH)


def cut_contexts(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, bytes before, bytes after) of the samples at some places: BEFORE bytes, nearest first, then LENGTH bytes, padded."""
    data = np.frombuffer(bytes(BEFORE) + raw + bytes(LENGTH), dtype=np.uint8)
    around = np.concatenate([BEFORE - 1 - np.arange(BEFORE), BEFORE + np.arange(LENGTH)])
    return data[at[:, None] + around], np.minimum(at, BEFORE), np.minimum(len(raw) - at, LENGTH)


def covered(docs: DataFrame) -> DataFrame:
    """From rows (doc, tag, raw): the intervals (doc, tag, spans) that strings found elsewhere cover."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "tag", "at", "h", "dg"]
        held, size = [], 0
        for batch in batches:
            docs_, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, raw in enumerate(batch.column(2)):
                raw = raw.as_py()
                if len(raw) < LENGTH:
                    continue
                at, h = samples(np.frombuffer(raw, dtype=np.uint8))
                n = len(at)
                held.append((np.full(n, docs_[i]), np.full(n, tags[i]), at.astype(np.int32), h[at].view(np.int64), context_digests(raw, at, h).view(np.int64)))
                size += n
                if size > SAMPLE_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)

    places = _stored(docs.mapInArrow(sample, "doc long, tag long, at int, h long, dg long"), "samples")
    # Computed first: against a plain table, Spark can split the partition of a hot hash; against an aggregate it cannot.
    twice = cut(places.groupBy("h").agg(F.count(F.lit(1)).alias("_n"), (F.min("dg") != F.max("dg")).alias("mixed")).where("_n > 1").select("h", "mixed"))
    shared = _stored(places.join(twice, "h"), "shared-samples")
    _let_go(places)

    contexts = cut(shared.where("mixed").groupBy("h", "dg").agg(F.min(F.struct("doc", "tag", "at")).alias("_first"), (F.count(F.lit(1)) == 1).alias("single")))
    many = cut(contexts.groupBy("h").agg((F.count(F.lit(1)) > HOT_CONTEXTS).alias("hot")))
    wanted = contexts.join(many, "h").select("h", "dg", "hot", "_first.*").groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "h", "dg", "hot")).alias("wanted"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # rows that repeat an id and text are read once in a task
        for batch in batches:
            for doc, tag, raw, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if (doc, tag) in seen:
                    continue
                seen.add((doc, tag))
                at, h, dg, hot = items.values.flatten()
                rows, n_before, n_after = cut_contexts(raw.as_py(), at.to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([h, dg, _binaries(rows), pa.array(n_before.astype(np.int32)), pa.array(n_after.astype(np.int32)), hot], names=["h", "dg", "around", "before", "after", "hot"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, seen, keys, held = IndexFamily(), set(), [], []

        def flush() -> None:
            if held:
                rows, n_before, n_after = (np.concatenate(x) for x in zip(*held))
                family.add(np.ascontiguousarray(rows[:, :BEFORE]), np.ascontiguousarray(rows[:, BEFORE:]), n_before, n_after)
                held.clear()

        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                part = batch.slice(begin, BATCH)
                fresh = []
                for i, key in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        fresh.append(i)
                if fresh:
                    at = np.array(fresh)
                    held.append((_grid(part.column(2))[at], part.column(3).to_numpy()[at].astype(np.int64), part.column(4).to_numpy()[at].astype(np.int64)))
                if sum(len(x[0]) for x in held) >= BATCH:
                    flush()
        flush()
        out = [(*key, a, b) for key, (a, b) in zip(keys, family.reach()) if a >= 0]
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["h", "dg", "a", "b"])

    texts = _stored(docs.join(wanted, ["doc", "tag"]).select("doc", "tag", "raw", "wanted").mapInArrow(cut_out, "h long, dg long, around binary, before int, after int, hot boolean"), "contexts")
    matched = texts.where("NOT hot").select("h", "dg", "around", "before", "after").repartition(F.col("h")).mapInArrow(index, "h long, dg long, a int, b int")
    if not many.where("hot").isEmpty():
        matched = matched.unionByName(hot_matches(texts.where("hot")))
    matched = cut(matched)
    _let_go(texts)

    digests = contexts.where("NOT single").select("h", "dg", F.lit(BEFORE).alias("a"), F.lit(LENGTH).alias("b"))
    reach = cut(matched.unionByName(digests).groupBy("h", "dg").agg(F.max("a").alias("a"), F.max("b").alias("b")))
    by_match = shared.where("mixed").join(reach, ["h", "dg"])
    whole = shared.where("NOT mixed").withColumns({"a": F.lit(BEFORE), "b": F.lit(LENGTH)})
    spans = whole.select("doc", "tag", "at", "a", "b").unionByName(by_match.select("doc", "tag", "at", "a", "b"))
    # A set: rows that repeat an id and text send the same intervals, which are combined before the shuffle.
    spans = cut(spans.groupBy("doc", "tag").agg(F.collect_set(F.struct((F.col("at") - F.col("a")).alias("lo"), (F.col("at") + F.col("b")).alias("hi"))).alias("spans")))
    _let_go(shared)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with with_text the kept bytes.

    Null texts count as empty: nothing to remove. Texts under LENGTH bytes are left alone, longer ones are read whole,
    however long. Ties and repeats: rows are known by 128 bits of their id and text, so rows that repeat an id, or have
    none, are documents of their own, and an exact copy of a row is a repeat of it. Ids may be of any type. Other columns are
    not read, whatever their names. No rows give no rows.
    """
    text_batches(docs.sparkSession)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    id_type = docs.schema[id_col].dataType.simpleString()
    ident = F.col(id_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(ident, F.col(text_col)).alias("doc"), F.xxhash64(F.lit(1), F.col(text_col), ident).alias("tag"), raw.alias("raw"))
    spans = covered(rows.select("doc", "tag", "raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, held in zip(batch.column(1), batch.column(2)):
                data = value.as_py()
                if not held.is_valid:
                    out.append((len(data), 0, 0, data))
                    continue
                lo, hi = held.values.field(0).to_numpy(), held.values.field(1).to_numpy()
                runs = unite(np.stack([lo, hi], axis=1).astype(np.int64), len(data))
                edges = [0, *runs.reshape(-1).tolist(), len(data)]
                out.append((len(data), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))))
            n, removed, k, kept = zip(*out) if out else ([], [], [], [])
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(k, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return rows.join(spans, ["doc", "tag"], "left").select("doc_id", "raw", "spans").mapInArrow(run, schema)
