"""BPE encoding and decoding with a contiguous rank array.

A short piece is a row of part boundaries with the rank of each adjacent pair beside them: the scan finds the lowest
rank, its boundary goes, the two ranks next to it are looked up again. Pieces of more than SHORT bytes, where scans
would cost the square of their length, take the same merges from a heap. Both give lowest rank first, leftmost on ties.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from spanmill.session import text_batches

#: Fixed value: how byte-level tokenizers split a text into pieces.
SPLIT = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 256
#: Encoded pieces kept in a worker; beyond that the store starts anew.
KEPT_PIECES = 200_000
NO_RANK = 1 << 60


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """piece in parts: the contiguous rank array."""
    cuts = list(range(len(piece) + 1))
    get = ranks.get
    near = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
    while near:
        low = min(near)
        if low == NO_RANK:
            break
        i = near.index(low)
        del cuts[i + 1], near[i]
        if i < len(near):
            near[i] = get(piece[cuts[i] : cuts[i + 2]], NO_RANK)
        if i > 0:
            near[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], NO_RANK)
    return [piece[a:b] for a, b in zip(cuts, cuts[1:])]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same parts from a heap of pairs over a linked list."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * n

    def offer(a: int) -> None:
        b = after[a]
        if b < n and (r := ranks.get(piece[a : end[b]])) is not None:
            heapq.heappush(heap, (r, a, b, end[b]))

    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if not (alive[a] and b < n and alive[b] and after[a] == b and end[b] == stop):
            continue
        alive[b], end[a], after[a] = 0, stop, after[b]
        if after[b] < n:
            before[after[b]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [piece[i : end[i]] for i in range(n) if alive[i]]


class ByteBpe:
    """A byte-level BPE vocabulary file: encode(text) -> ids, decode(ids) -> text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_characters()
        as_bytes = lambda token: bytes(chars[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        # The rank of a pair is that of what it makes: in these vocabularies a token has one merge.
        self.ranks = {as_bytes(a + b): i for i, (a, b) in enumerate(pairs)}
        self.one_merge = len(self.ranks) == len(pairs)
        assert self.one_merge, "a token with two merges needs ranks by pair"
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.find = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.pieces: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ids.get(raw)
        if len(raw) == 1:
            return (whole,)
        parts = merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
        out = tuple(self.ids[p] for p in parts)
        if len(raw) <= SHORT:
            if len(self.pieces) >= KEPT_PIECES:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        out: list[int] = []
        known, add, piece = self.pieces.get, out.extend, self.piece
        plain = [text]
        if self.cut and any(t in text for t in self.added):
            plain = self.cut(text)
        for part in plain:
            if len(plain) > 1 and part in self.added:
                out.append(self.added[part])
                continue
            for p in self.find(part):
                add(known(p) or piece(p))
        return np.array(out, dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_path() -> str:
    """The 50k byte-level vocabulary; imported here, as other operators do without."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids and the decoded text.

    Null texts count as empty: no tokens, the hash of no bytes. Repeated rows are encoded each on its own; other
    columns are not read. No rows give no rows. A row at a time is held, besides the piece store of a worker.
    """
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    text_batches(spark)
    file = path or default_path()
    spark.sparkContext.addFile(file)
    name = file.rsplit("/", 1)[-1]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(SparkFiles.get(name))
        for batch in batches:
            n, shas, backs, ids_out, texts = [], [], [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py() or "")
                back = bpe.decode(ids)
                n.append(len(ids))
                shas.append(hashlib.sha256(ids.tobytes()).hexdigest())
                backs.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    ids_out.append(ids.astype(np.int32))
                    texts.append(back)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
