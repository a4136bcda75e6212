"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is a row of words (of long ones, as in scripts without spaces, overlapping parts), scored in overlapping windows
of WINDOW words, one starting every STEP words; the text's score is that of its worst window. A word enters as its own vector (words of the training sample that occur in
MIN_DOCS documents) beside the mean vector of its character n-grams, so forms never seen before are read by their
letters. Two recurrent passes, one from each side, meet in an attention layer whose weighted mean decides.

Training: labels belong to texts, not windows, so a text's logit is the soft maximum of all its windows' logits. The
labelled rows whose crc32 leaves 2 modulo 4 are held out. Of the others, at most TRAIN_TOXIC and TRAIN_OTHER rows, in
the order of a hash of their ids, are the training sample; every fifth of them calibrates the scores instead.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.session import text_batches

WORD = re.compile(r"[^\W_]+")
WINDOW, STEP = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 12, 12, 12, 12
GRAMS, GRAM_BUCKETS = (3, 4, 5), 16384
MIN_DOCS, MAX_VOCABULARY = 4, 8000
#: Bounds of the training sample, in labelled rows; of its words and n-grams the network keeps vectors of so many.
TRAIN_TOXIC, TRAIN_OTHER = 700, 1100
EPOCHS, MIN_STEPS, BATCH, RATE, SEED = 3, 110, 32, 1e-2, 5
HELD_OUT, THRESHOLD = 2, 0.3
#: Characters of a word; a longer one is read in parts, one starting every PART_STEP characters. Words whose vectors a worker keeps.
WORD_CHARS, PART_STEP, KEPT_WORDS, CHUNK_WINDOWS = 40, 20, 120_000, 4096
f4 = np.float32


def words_of(text: str | None) -> list[str]:
    """Words in text order; one of more than WORD_CHARS characters as overlapping parts that cover it, each a word."""
    words = WORD.findall((text or "").lower())
    if max(map(len, words), default=0) <= WORD_CHARS:
        return words
    return [w[i : i + WORD_CHARS] for w in words for i in range(0, max(1, len(w) - WORD_CHARS + PART_STEP), PART_STEP)]


def gram_ids(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length in GRAMS: the buckets of the n-grams of <word>, word after word, and how many each word has."""
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the word's end
    for n in GRAMS:
        h = np.full(len(codes), n, dtype=np.uint64)
        for k in range(min(n, len(codes))):
            h[: len(codes) - k] = (h[: len(codes) - k] ^ codes[k:]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        yield (h[left >= n] % np.uint64(GRAM_BUCKETS)).astype(np.int64), np.maximum(sizes - n + 1, 0)


def sum_rows(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """n rows, each the sum of those of rows that at sends there."""
    out = np.zeros((n, rows.shape[1]), dtype=rows.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def windows(n: int) -> np.ndarray:
    """Starts of the windows that cover n words; texts without words have one empty window."""
    return np.arange(0, max(1, n - WINDOW + STEP), STEP) if n > WINDOW else np.zeros(1, dtype=np.int64)


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class BiGru:
    """params: word and character vectors, input weights of both directions, recurrent weights, attention, output."""

    def __init__(self, vocabulary: list[str], seed: int = SEED):
        g = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        init = lambda *shape, s: g.normal(0, s, shape).astype(f4)
        self.p = {"word": init(len(vocabulary) + 1, WORD_DIM, s=0.1), "char": init(GRAM_BUCKETS, CHAR_DIM, s=0.3), "wa": init(2 * h, ATTENTION, s=0.3), "ba": np.zeros(ATTENTION, f4), "v": init(ATTENTION, s=0.3), "o": init(2 * h, s=0.3), "c": np.zeros(1, f4)}
        for k in "fb":
            self.p |= {f"x{k}": init(d, 3 * h, s=d**-0.5), f"bx{k}": np.zeros(3 * h, f4), f"u{k}": init(h, 2 * h, s=h**-0.5), f"n{k}": init(h, h, s=h**-0.5)}
        self.scale = (1.0, 0.0)

    def inputs(self, words: list[str]) -> np.ndarray:
        """The input vector of each word."""
        out = np.zeros((len(words), WORD_DIM + CHAR_DIM), dtype=f4)
        out[:, :WORD_DIM] = self.p["word"][[self.vocabulary.get(w, 0) for w in words]]
        if words:
            total = np.zeros((len(words), 1), dtype=f4)
            for ids, sizes in gram_ids(words):
                some = sizes > 0
                if some.any():
                    out[some, WORD_DIM:] += np.add.reduceat(self.p["char"][ids], (np.cumsum(sizes) - sizes)[some], axis=0)
                    total[:, 0] += sizes
            out[:, WORD_DIM:] /= total
        return out

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["xf"] + self.p["bxf"], x @ self.p["xb"] + self.p["bxb"]

    def run(self, k: str, table: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction, windows x places x HIDDEN; past a window's end they stay as they were."""
        m, t = ids.shape
        h = np.zeros((m, HIDDEN), dtype=f4)
        out = np.empty((m, t, HIDDEN), dtype=f4)
        u, n = self.p[f"u{k}"], self.p[f"n{k}"]
        full = mask.all(axis=0)
        for i in range(t) if k == "f" else range(t - 1, -1, -1):
            x = table[ids[:, i]]
            zr = sigmoid(x[:, : 2 * HIDDEN] + h @ u)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ n)
            nxt = new + z * (h - new)
            if not full[i]:
                nxt = np.where(mask[:, i, None], nxt, h)
            if keep is not None:
                keep.append((i, h, z, r, new))
            h = nxt
            out[:, i] = h
        return out

    def attend(self, states: np.ndarray, mask: np.ndarray):
        e = np.tanh(states @ self.p["wa"] + self.p["ba"])
        s = np.where(mask, e @ self.p["v"], f4(-1e9))
        a = np.exp(s - s.max(axis=1, keepdims=True)) * mask
        a /= np.maximum(a.sum(axis=1, keepdims=True), f4(1e-9))
        pooled = np.einsum("mt,mth->mh", a, states)
        return e, a, pooled, pooled @ self.p["o"] + self.p["c"]

    def logits(self, tables: tuple[np.ndarray, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.run("f", tables[0], ids, mask), self.run("b", tables[1], ids, mask)], axis=2)
        return self.attend(states, mask)[3]

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * np.asarray(logits, dtype=np.float64) + self.scale[1], -60, 60)))

    def step(self, rows: list[tuple[list[list[str]], int]], weights: tuple[float, float]) -> dict[str, np.ndarray]:
        """Gradients for a batch of texts, each its windows' words and its label."""
        known: dict[str, int] = {}
        flat = [w for ws, _ in rows for w in ws]
        ids, mask = np.zeros((len(flat), WINDOW), dtype=np.int64), np.zeros((len(flat), WINDOW), dtype=bool)
        for i, ws in enumerate(flat):
            ids[i, : len(ws)] = [known.setdefault(w, len(known)) for w in ws]
            mask[i, : len(ws)] = True
        words = list(known) or [""]
        owner = np.repeat(np.arange(len(rows)), [len(ws) for ws, _ in rows])
        y = np.array([label for _, label in rows])
        x = self.inputs(words)
        tables = self.project(x)
        held: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.run(k, t, ids, mask, held[k]) for k, t in zip("fb", tables)], axis=2)
        e, a, pooled, s = self.attend(states, mask)
        top = np.full(len(rows), -np.inf)
        np.maximum.at(top, owner, s)
        soft = np.exp(s - top[owner])
        total = np.zeros(len(rows))
        np.add.at(total, owner, soft)
        text = top + np.log(total)
        dt = (1 / (1 + np.exp(-text)) - y) * np.where(y == 1, *weights) / len(rows)
        ds = (soft / total[owner] * dt[owner]).astype(f4)
        p, g = self.p, {}
        g["o"], g["c"] = pooled.T @ ds, ds.sum(keepdims=True)
        dpool = ds[:, None] * p["o"]
        dstates = a[:, :, None] * dpool[:, None, :]
        da = np.einsum("mth,mh->mt", states, dpool)
        dsc = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("mt,mta->a", dsc, e)
        de = dsc[:, :, None] * p["v"] * (1 - e * e)
        g["wa"], g["ba"] = np.einsum("mth,mta->ha", states, de), de.sum(axis=(0, 1))
        dstates += de @ p["wa"].T
        dx = np.zeros_like(x)
        for k, cols in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, n = p[f"u{k}"], p[f"n{k}"]
            gu, gn, dgates = np.zeros_like(u), np.zeros_like(n), np.empty((*ids.shape, 3 * HIDDEN), dtype=f4)
            dh = np.zeros((len(flat), HIDDEN), dtype=f4)
            for i, h, z, r, new in reversed(held[k]):
                dh = dh + dstates[:, i, cols]
                at = mask[:, i, None]
                stay, go = np.where(at, 0, dh), np.where(at, dh, 0)
                dn = go * (1 - z) * (1 - new * new)
                drh = dn @ n.T
                dz, dr = go * (h - new) * z * (1 - z), drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                gn += (r * h).T @ dn
                gu += h.T @ dzr
                dh = stay + go * z + drh * r + dzr @ u.T
                dgates[:, i] = np.concatenate([dzr, dn], axis=1)
            dtable = sum_rows(len(words), ids.reshape(-1), dgates.reshape(-1, 3 * HIDDEN))
            g |= {f"u{k}": gu, f"n{k}": gn, f"x{k}": x.T @ dtable, f"bx{k}": dtable.sum(axis=0)}
            dx += dtable @ p[f"x{k}"].T
        wid = np.array([self.vocabulary.get(w, 0) for w in words])
        g["word"] = sum_rows(len(p["word"]), wid, dx[:, :WORD_DIM])
        parts = list(gram_ids(words))
        each = dx[:, WORD_DIM:] / sum(sizes for _, sizes in parts)[:, None]
        g["char"] = sum_rows(GRAM_BUCKETS, np.concatenate([ids for ids, _ in parts]), np.concatenate([np.repeat(each, sizes, axis=0) for _, sizes in parts]))
        return g

    def train(self, texts: list[list[str]], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> None:
        g = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        positive = max(1, sum(labels))
        weights = (max(1.0, (len(labels) - positive) / positive) ** 0.5, 1.0)
        epochs = max(epochs, -(-MIN_STEPS * BATCH // len(texts)))  # a small sample is gone through more often
        steps, count = 0, epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = g.permutation(len(texts))
            for i in range(0, len(texts), BATCH):
                rows = []
                for j in order[i : i + BATCH]:
                    rows.append(([texts[j][s : s + WINDOW] for s in windows(len(texts[j]))], labels[j]))
                steps += 1
                rate = RATE * min(1.0, steps / 10) * (1 - 0.9 * steps / count)
                for k, d in self.step(rows, weights).items():
                    a, b = moments[k]
                    a += 0.1 * (d - a)
                    b += 0.01 * (d * d - b)
                    self.p[k] -= f4(rate) * (a / f4(1 - 0.9**steps)) / (np.sqrt(b / f4(1 - 0.99**steps)) + f4(1e-7))

    def calibrate(self, logits: np.ndarray, labels: np.ndarray) -> None:
        """Platt scaling with a mild prior towards the raw logits."""
        z, y = np.asarray(logits, dtype=np.float64), np.asarray(labels, dtype=np.float64)
        a, b = 1.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
            q = p * (1 - p)
            g = np.array([((p - y) * z).sum() + (a - 1), (p - y).sum() + 0.1 * b])
            h = np.array([[(q * z * z).sum() + 1, (q * z).sum()], [(q * z).sum(), q.sum() + 0.1]])
            d = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
            a, b = a - d[0], b - d[1]
        self.scale = (float(max(a, 0.05)), float(b))


class Scorer:
    """Scores texts with a trained network; word projections are kept up to KEPT_WORDS."""

    def __init__(self, net: BiGru):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.tables = (np.zeros((KEPT_WORDS, 3 * HIDDEN), dtype=f4), np.zeros((KEPT_WORDS, 3 * HIDDEN), dtype=f4))

    def ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        fresh = list({w for w in words if w not in known})
        if fresh:
            begin = len(known)
            for w in fresh:
                known[w] = len(known)
            for t, rows in zip(self.tables, self.net.project(self.net.inputs(fresh))):
                t[begin : begin + len(fresh)] = rows
        return np.array([known[w] for w in words], dtype=np.int64)

    def worst(self, texts: list[list[str]]) -> np.ndarray:
        """The largest window logit of each text. A text of any length is read whole, CHUNK_WINDOWS windows at a time."""
        out = np.full(len(texts), -np.inf)
        ids, mask, owner = [], [], []
        held = 0

        def flush() -> None:
            nonlocal held
            if owner:
                own = np.concatenate(owner)
                np.maximum.at(out, own, self.net.logits(self.tables, np.concatenate(ids), np.concatenate(mask)))
                ids.clear(), mask.clear(), owner.clear()
                held = 0

        per = CHUNK_WINDOWS * STEP
        for i, words in enumerate(texts):
            for begin in range(0, max(1, len(words)), per):
                part = words[begin : begin + per + WINDOW - STEP]
                if begin and len(part) <= WINDOW - STEP:
                    break
                if len(self.known) + len(part) > KEPT_WORDS or held >= CHUNK_WINDOWS:
                    flush()
                    if len(self.known) + len(part) > KEPT_WORDS:
                        self.reset()
                n = len(part)
                starts = windows(n)
                padded = np.zeros(int(starts[-1]) + WINDOW, dtype=np.int64)
                padded[:n] = self.ids(part)
                at = starts[:, None] + np.arange(WINDOW)
                ids.append(padded[at])
                mask.append(at < n)
                owner.append(np.full(len(starts), i))
                held += len(starts)
        flush()
        return out


def train_network(rows: list[tuple[int, str | None, int]]) -> BiGru:
    """From (doc_id, text, toxic) of the bounded training sample; the same rows give the same network in any order."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(f"s{r[0]}".encode()), str(r[0]), r[1] or ""))
    texts, labels = [words_of(t) for _, t, _ in rows], [int(x) for *_, x in rows]
    check = np.array([zlib.crc32(f"c{r[0]}".encode()) % 5 == 0 for r in rows], dtype=bool) if len(rows) >= 50 else np.zeros(len(rows), dtype=bool)
    fit = np.flatnonzero(~check)
    seen = Counter(w for i in fit for w in set(texts[i]))
    net = BiGru([w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= MIN_DOCS][:MAX_VOCABULARY])
    if len(fit):
        net.train([texts[i] for i in fit], [labels[i] for i in fit])
    if check.any():
        net.calibrate(Scorer(net).worst([texts[i] for i in np.flatnonzero(check)]), np.array(labels)[check])
    return net


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, toxic: at most TRAIN_TOXIC and TRAIN_OTHER labelled rows that are not held out, by a hash of their ids. Of the
    rows that repeat an id one is taken, so the sample is no larger."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = known.where("toxic = 1").orderBy(*order).limit(TRAIN_TOXIC).unionByName(known.where("toxic = 0").orderBy(*order).limit(TRAIN_OTHER))
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("_h"), "text")).alias("_one")
    return found.groupBy("doc_id", "toxic").agg(one).select("doc_id", "_one.text", "toxic")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: BiGru | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted.

    Null and empty texts have one window without words and so a score as well. Texts of any length are scored whole. Ties:
    equal texts have equal scores. Rows without an id are not held out.
    Rows that repeat an id are scored each by their own text; labels that disagree count as toxic. Without labels the
    network stays as it was initialised. Columns other than id and text are not read, whatever their names. No rows
    give no rows.
    """
    text_batches(docs.sparkSession)
    net = net or train_network([tuple(r) for r in training_sample(docs, labels, id_col, text_col).select("doc_id", "text", "toxic").collect()])
    model = docs.sparkSession.sparkContext.broadcast(net)  # vectors of at most MAX_VOCABULARY words and GRAM_BUCKETS n-grams
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                scores = scorer.net.score(scorer.worst([words_of(t.as_py()) for t in part.column(1)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, score double, predicted int")
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
