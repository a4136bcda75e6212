"""Hybrid retrieval: two keyword channels (BM25 over words and over character trigrams), vectors, rank fusion, reranking.

``docs`` has id and text, ``vectors`` id and embedding. Corpus figures (documents, average length, document
frequencies) are one aggregated row, a scalar subquery; documents stay where they are until the top rows are known.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions import text as tx
from spanmill.operators.index import Index
from spanmill.session import cut

#: Fixed values.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K, RECALL, REL_DELTA, RERANK_FLOOR, HITS_PER_GROUP = 60, 20, 0.05, 0.505, 3
#: What tells chunks of different prompt versions apart, where docs have it.
CHUNK_KEYS, EXPOSURE = ("kind", "title", "text"), ("last_seen", "session_count")
CHANNELS = ("vector", "trigram", "words")


def query_tokens(query: str, unicode_words: bool = False) -> list[str]:
    """Tokens of a query, in order, each once. By default letters beyond ASCII separate, but for CJK ones."""
    pattern = r"\w+" if unicode_words else r"[A-Za-z0-9_一-鿿]+"
    return list(dict.fromkeys(re.findall(pattern, query)))


def index_tokens(query: str, unicode_words: bool = False) -> list[str]:
    """Tokens that an index looks up: none if the query holds a bare AND or OR, which no index can read between the ORs that
    join tokens."""
    tokens = query_tokens(query, unicode_words)
    return [] if {"AND", "OR"} & set(tokens) else tokens


def match_expression(query: str) -> str:
    """The query as a keyword index would take it; empty if nothing is left."""
    return " OR ".join(query_tokens(query))


def _idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def _bm25(counted: DataFrame, terms: int) -> DataFrame:
    """From id, dl and tf0..tfN: score of the documents that have a term."""
    row = F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), F.array(*[F.count_if(F.col(f"tf{i}") > 0) for i in range(terms)]).alias("df"))
    hits = counted.where(" OR ".join(f"tf{i} > 0" for i in range(terms))).withColumn("_s", counted.agg(row.alias("s")).scalar())
    score = F.lit(0.0)
    for i in range(terms):
        tf = F.col(f"tf{i}")
        score = score + _idf(F.col("_s.n"), F.col("_s.df")[i]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("_s.avg")))
    return hits.select("id", score.alias("score"))


def bm25_words(docs: DataFrame, query: str, unicode_words: bool = False) -> DataFrame:
    """id, score by words: lower case, accents folded, _ separates (a query token with one is a phrase of its parts)."""
    phrases = word_phrases(query, unicode_words)
    if not phrases:
        return docs.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    # Words between two blanks each, so that a phrase is a substring. Going through explode keeps the words from being
    # taken apart anew for every term.
    words = docs.select("id", F.explode(F.array(tx.token_words(F.coalesce("text", F.lit(""))))).alias("_w"))
    joined = words.select("id", F.size("_w").alias("dl"), F.explode(F.array(F.concat(F.lit(" "), F.array_join("_w", "  "), F.lit(" ")))).alias("_j"))
    return _bm25(joined.select("id", "dl", *[tx.count_matches(F.col("_j"), f" {'  '.join(p)} ").alias(f"tf{i}") for i, p in enumerate(phrases)]), len(phrases))


def _fold(token: str) -> list[str]:
    import unicodedata

    flat = "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", flat)


def bm25_trigrams(docs: DataFrame, query: str, unicode_words: bool = False) -> DataFrame:
    """id, score by substrings of three characters and more, case folded; shorter tokens match nothing. A document's
    length is its number of trigrams, a token's frequency its occurrences, overlapping ones too."""
    terms = trigram_terms(query, unicode_words)
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    low = docs.select("id", F.explode(F.array(F.lower(F.coalesce("text", F.lit(""))))).alias("_t"))
    counts = [F.when(F.contains("_t", F.lit(t)), F.regexp_count("_t", F.lit(f"(?=\\Q{t}\\E)"))).otherwise(0).alias(f"tf{i}") for i, t in enumerate(terms)]
    return _bm25(low.select("id", F.greatest(F.length("_t") - 2, F.lit(0)).alias("dl"), *counts), len(terms))


def postings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An inverted index of words: (term, id, tf), to be stored by term, and (id, dl)."""
    words = docs.select("id", tx.token_words(F.coalesce("text", F.lit(""))).alias("_w"))
    terms = words.select("id", F.explode("_w").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return terms, words.select("id", F.size("_w").alias("dl"))


def bm25_postings(index: DataFrame, lengths: DataFrame, terms: Sequence[str]) -> DataFrame:
    """id, score from a stored index: only the query terms' postings are read."""
    stats = lengths.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg")).alias("s"))
    mine = index.where(F.col("term").isin(*terms))
    df = mine.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    hits = mine.join(F.broadcast(df), "term").join(lengths, "id").withColumn("_s", stats.scalar())
    part = _idf(F.col("_s.n"), F.col("_df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("_s.avg")))
    return hits.groupBy("id").agg(F.sum(part).alias("score"))


def cosine(embedding: Column, query: Sequence[float]) -> Column:
    """Cosine of a float array with a query vector, in double; a zero norm counts as 1."""
    q = [float(x) for x in query]
    norm = math.sqrt(sum(x * x for x in q)) or 1.0
    lit = F.array(*[F.lit(x) for x in q])
    wide = embedding.cast("array<double>")
    dot = F.aggregate(F.zip_with(wide, lit, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (F.when(own == 0, 1.0).otherwise(own) * norm)


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int = RECALL) -> DataFrame:
    """The k nearest of positive cosine; ties by id."""
    return vectors.select("id", cosine(F.col("embedding"), query).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def ranked(channel: DataFrame, k: int = RECALL) -> DataFrame:
    """The top k of (id, score) with rank from 1. Scores count to nine decimals, so that sums in another order rank alike;
    ties by id."""
    top = channel.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rrf(channels: Sequence[tuple[str, DataFrame, float]], k: int = RRF_K, limit: int | None = RECALL) -> DataFrame:
    """id, score: the sum of weight / (k + rank) over ranked channels (name, (id, rank), weight); weight 0 leaves a channel
    out. Ties: first by channel order, then by rank there."""
    parts = [c.select("id", F.lit(i).alias("_c"), F.col("rank"), (F.lit(float(w)) / (k + F.col("rank"))).alias("_s")) for i, (_, c, w) in enumerate(channels) if w]
    if not parts:
        return channels[0][1].select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("id").agg(F.sum("_s").alias("score"), F.min(F.struct("_c", "rank")).alias("_first")).orderBy(F.desc("score"), "_first")
    return (fused.limit(limit) if limit else fused).select("id", "score", "_first")


def parse_weights(text: str | None) -> tuple[float, float, float]:
    """'v,t,w' as weights; anything else means equal ones."""
    try:
        found = tuple(float(x) for x in (text or "").split(","))
    except ValueError:
        return (1.0, 1.0, 1.0)
    return found if len(found) == 3 and all(x >= 0 and math.isfinite(x) for x in found) else (1.0, 1.0, 1.0)


# Embedders and rerankers are callables; these stand in where no model is at hand.


def hash_embedder(texts: Sequence[str], dimension: int = 16) -> np.ndarray:
    """Token counts by the first byte of their sha256, normalised."""
    import hashlib

    out = np.zeros((len(texts), dimension), dtype=np.float32)
    for i, t in enumerate(texts):
        for token in re.findall(r"[a-z0-9]+", (t or "").lower()):
            out[i, hashlib.sha256(token.encode()).digest()[0] % dimension] += 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def lexical_overlap(query: str, texts: Sequence[str]) -> list[float]:
    """Share of the query's distinct tokens that a text has."""
    q = set(re.findall(r"[a-z0-9]+", query.lower()))
    return [len(q & set(re.findall(r"[a-z0-9]+", (t or "").lower()))) / len(q) if q else 0.0 for t in texts]


def embed(rows: DataFrame, embedder: Callable = hash_embedder, text: str = "text", batch: int = 32) -> DataFrame:
    """rows with embedding (null where a batch failed) and state."""

    def run(batches):
        for pdf in batches:
            vectors: list = [None] * len(pdf)
            for i in range(0, len(pdf), batch):
                try:
                    vectors[i : i + batch] = [v.tolist() for v in embedder(pdf[text].iloc[i : i + batch].fillna("").tolist())]
                except Exception:  # noqa: BLE001  a failing batch is marked and the rest goes on
                    pass
            yield pdf.assign(embedding=vectors, state=["failed" if v is None else "indexed" for v in vectors])

    names = [c for c in rows.columns if c not in ("embedding", "state")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names) + ", embedding array<float>, state string"
    return rows.select(*names).mapInPandas(run, schema)


def check_identity(stored: tuple[str, int], embedder: tuple[str, int]) -> None:
    if stored != embedder:
        raise ValueError(f"the index was built with {stored}, not {embedder}: reindex")


def overlap_score(text: Column, query: str) -> Column:
    """lexical_overlap as an expression."""
    q = sorted(set(re.findall(r"[a-z0-9]+", query.lower())))
    if not q:
        return F.lit(0.0)
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in q]))) / F.lit(float(len(q)))


def rerank(top: DataFrame, query: str, reranker: Callable | None = lexical_overlap, fallback: str = "cosine") -> DataFrame:
    """top (few rows with text and the fallback's column) with score and reranked: false, with the fallback's score, where
    the reranker is missing or fails."""
    if reranker is None:
        return top.withColumns({"score": F.col(fallback), "reranked": F.lit(False)})

    def run(batches):
        for pdf in batches:
            try:
                scores, ok = list(map(float, reranker(query, pdf["text"].tolist()))), True
            except Exception:  # noqa: BLE001
                scores, ok = pdf[fallback].tolist(), False
            yield pdf.assign(score=scores, reranked=ok)

    base = cut(top.drop("score", "reranked"))  # the rows as they are found, in parallel; only then one task has them
    return base.coalesce(1).mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", score double, reranked boolean")


def relative_floor(hits: DataFrame, delta: float = REL_DELTA) -> DataFrame:
    """Hits within delta of the best, and the best itself. hits are few: a recalled list."""
    return hits.withColumn("_top", F.max("score").over(Window.partitionBy())).where((F.col("score") > F.col("_top") - delta) | (F.col("score") == F.col("_top"))).drop("_top")


def merge_across(hits: DataFrame, keys: Sequence[str] = ("kind", "title", "text"), order: Sequence[str] = ("score", "last_seen")) -> DataFrame:
    """Of hits with equal keys the best stays and takes on the others' session counts."""
    w = Window.partitionBy(*keys)
    first = F.row_number().over(w.orderBy(*[F.desc(c) for c in order], "id"))
    return hits.withColumns({"_r": first, "session_count": F.sum("session_count").over(w)}).where("_r = 1").drop("_r")


def top_per_group(hits: DataFrame, group: str, n: int = HITS_PER_GROUP) -> DataFrame:
    """The n best hits of each group with the group's best score; groups by it, hits within."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    best = F.max("score").over(Window.partitionBy(group))
    return hits.withColumns({"place": F.row_number().over(w), "group_score": best}).where(F.col("place") <= n).orderBy(F.desc("group_score"), group, "place")


def _from_postings(index: Index, kind: str, phrases: Sequence[Sequence[str]]) -> DataFrame:
    """id, score: each phrase is a row of terms that follow one another (words) or overlap (trigrams)."""
    if not phrases or not index.totals["documents"]:
        return index.lengths.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    terms = sorted({t for p in phrases for t in p})
    lengths = index.lengths.select("block", "slot", "id", "rows", F.col(kind).alias("dl"))
    # A document's places of each wanted term, beside one another: a phrase occurs where its terms' places, shifted back, meet.
    rows = index.postings(kind, terms).groupBy("block", "slot").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("_at"))
    counts = []
    for i, phrase in enumerate(phrases):
        shifted = [_back(F.coalesce(F.element_at("_at", F.lit(t)), F.array().cast("array<int>")), k) for k, t in enumerate(phrase)]
        met = shifted[0]
        for s in shifted[1:]:
            met = F.array_intersect(met, s)
        counts.append(F.size(met).alias(f"tf{i}"))
    # Documents as the state has them; rows of equal id and text count each.
    found = cut(rows.select("block", "slot", *counts).where(" OR ".join(f"tf{i} > 0" for i in range(len(phrases)))).join(lengths, ["block", "slot"]))
    df = found.agg(*[F.coalesce(F.sum(F.when(F.col(f"tf{i}") > 0, F.col("rows"))), F.lit(0)).alias(f"df{i}") for i in range(len(phrases))]).first()
    score = F.lit(0.0)
    for i in range(len(phrases)):
        tf = F.col(f"tf{i}")
        score = score + _idf(F.lit(float(index.totals["documents"])), F.lit(float(df[i]))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(index.totals[kind]))))
    scored = found.select("id", "rows", score.alias("score"))
    return scored.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("id", "score")


def _back(places: Column, steps: int) -> Column:
    return F.transform(places, lambda x: x - steps)


def word_phrases(query: str, unicode_words: bool = False) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(p) for t in index_tokens(query, unicode_words) if (p := _fold(t))))


def trigram_terms(query: str, unicode_words: bool = False) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in index_tokens(query, unicode_words) if len(t) >= 3))


def indexed_words(index: Index, query: str, unicode_words: bool = False) -> DataFrame:
    """What bm25_words finds, from stored postings."""
    return _from_postings(index, "words", word_phrases(query, unicode_words))


def indexed_trigrams(index: Index, query: str, unicode_words: bool = False) -> DataFrame:
    """What bm25_trigrams finds, from stored postings: a token's trigrams in a row."""
    return _from_postings(index, "trigrams", [tuple(t[i : i + 3] for i in range(len(t) - 2)) for t in trigram_terms(query, unicode_words)])


def hybrid_search(docs: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], recall: int = RECALL, weights: Sequence[float] = (1.0, 1.0, 1.0), index: Index | None = None) -> DataFrame:
    """id, score: the three channels fused; documents without a vector take part by keywords only. With an index, keywords are
    looked up in its postings (of docs, which then are not read)."""
    if index is None:
        keywords = [("trigram", bm25_trigrams(docs, query)), ("words", bm25_words(docs, query))]
    else:
        ids = docs.select("id")
        keywords = [("trigram", indexed_trigrams(index, query).join(ids, "id", "left_semi")), ("words", indexed_words(index, query).join(ids, "id", "left_semi"))]
    channels = [("vector", vector_topk(vectors, query_vector, recall)), *keywords]
    return rrf([(name, ranked(c, recall), w) for (name, c), w in zip(channels, weights)], limit=recall)


def search(docs: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], group: str, limit: int = 10, reranker: Callable | None = lexical_overlap, min_score: float | None = None, recall: int = RECALL, weights: Sequence[float] = (1.0, 1.0, 1.0), delta: float = REL_DELTA, fold: bool = True, within: Column | None = None, index: Index | None = None) -> DataFrame:
    """The whole search: recall by fusion, fold of equal chunks, rerank (or fall back to cosine), floors, and the best hits of each
    group: id, text, group, score, reranked, place, group_score, session_count (of the group, null where docs have none).

    docs needs id, text and the group's column; limit counts groups. Where docs have kind, title, last_seen and session_count,
    equal chunks of several groups are one hit before reranking: the best by cosine, then the newest; its group's session_count
    takes in the others'. Reranked scores must exceed the floor; others must reach it (0 unless given) and, whether the reranker is
    missing or fails, stay within delta of the best. within keeps candidates of some rows only: vectors are compared among
    these, keywords rank over all docs. With an index (see operators.index) only the query terms' postings are read. A blank query
    finds nothing.
    """
    names = ["id", "text", group, "score", "reranked", "place", "group_score", "session_count"]
    counted = "session_count" in docs.columns
    sessions = F.col("session_count").cast("long") if counted else F.lit(None).cast("long")
    if not query.strip():
        nothing = docs.where(F.lit(False)).withColumns({"score": F.lit(0.0), "reranked": F.lit(False), "place": F.lit(0), "group_score": F.lit(0.0)})
        return nothing.withColumn("session_count", F.lit(None).cast("long")).select(*names)
    wanted = docs if within is None else docs.where(within)
    vectors = vectors if within is None else vectors.join(wanted.select("id"), "id", "left_semi")
    top = cut(hybrid_search(docs, vectors, query, query_vector, recall, weights, index).select("id", F.col("score").alias("fused")))  # at most recall rows
    cos = vectors.join(F.broadcast(top.select("id")), "id", "left_semi").select("id", cosine(F.col("embedding"), query_vector).alias("cosine"))
    foldable = fold and counted and all(c in docs.columns for c in (*CHUNK_KEYS, *EXPOSURE))
    own = [c for c in dict.fromkeys(("id", "text", group, *(CHUNK_KEYS + EXPOSURE if foldable else ()), *(("session_count",) if counted else ()))) if c in docs.columns]
    held = wanted.select(*own).join(F.broadcast(top), "id").join(F.broadcast(cos), "id", "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    held = held.withColumn("_own", sessions)
    if foldable:
        held = merge_across(held, CHUNK_KEYS, ("cosine", "last_seen")).withColumn("_bonus", F.col("session_count") - F.col("_own"))
    else:
        held = held.withColumn("_bonus", F.lit(0).cast("long"))
    scored = cut(rerank(held, query, reranker))
    above = F.col("score") > F.lit(RERANK_FLOOR if min_score is None else min_score)
    reach = F.col("score") >= F.lit(0.0 if min_score is None else min_score)
    loose = relative_floor(scored.where(~F.col("reranked") & reach), delta)
    kept = scored.where(F.col("reranked") & above).unionByName(loose)
    exposure = F.max("_own").over(Window.partitionBy(group)) + F.sum("_bonus").over(Window.partitionBy(group))
    grouped = top_per_group(kept.withColumn("session_count", exposure), group)
    best = grouped.groupBy(group).agg(F.max("group_score").alias("_g")).orderBy(F.desc("_g"), group).limit(limit)
    return grouped.join(F.broadcast(best.select(group)), group, "left_semi").select(*names)


def search_messages(messages: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], role: str | None = None, client: str | None = None, **options) -> DataFrame:
    """search over messages (id, session_id, role, client, text), of one role or client if asked: no folding, grouped by session."""
    within = None
    for column, value in (("role", role), ("client", client)):
        if value:
            within = F.col(column) == value if within is None else within & (F.col(column) == value)
    return search(messages, vectors, query, query_vector, "session_id", fold=False, within=within, **options)


def recall_memories(hits: DataFrame, limit: int = 5, min_score: float | None = None) -> DataFrame:
    """Hits of all groups as one list, best first, with where they come from (needs seen_at, client, session_id)."""
    kept = hits if min_score is None else hits.where(F.col("score") >= min_score)
    return kept.withColumn("source", tx.attribution(F.col("seen_at"), F.col("client"), F.col("session_id"))).orderBy(F.desc("score"), "id").limit(limit)


