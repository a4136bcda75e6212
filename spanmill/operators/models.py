"""Embedders and rerankers behind one shape, chosen by settings, and the upkeep of an index of embedded rows.

An embedder is called with texts and gives a vector for each; it has a name, which says whose vectors an index holds, and may have a
way of its own to embed queries. A reranker is called with a query and texts. Models are optional: where none can be
loaded, Unavailable says why, and the built-in stand-ins need nothing.
"""

from __future__ import annotations

import json
import math
import os
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.functions.record import embedder_identity
from spanmill.operators import knowledge as kb, retrieval as rt

SECTION, PREFIX = "retrieval", "SPANMILL_"
#: What sentence models of the usual family expect before passages and queries.
PASSAGE, QUESTION = "passage: ", "query: "


class Unavailable(RuntimeError):
    """A model that is not installed or cannot be loaded."""


@dataclass(frozen=True)
class Settings:
    """embedder: hash, local or api. reranker: lexical, local or off."""

    embedder: str = "hash"
    local_model: str = "intfloat/multilingual-e5-small"
    api_base: str = ""
    api_model: str = ""
    api_key_env: str = "EMBEDDING_API_KEY"
    query_prefix: str = QUESTION
    passage_prefix: str = PASSAGE
    reranker: str = "lexical"
    reranker_model: str = "BAAI/bge-reranker-v2-m3"
    rrf_weights: tuple[float, float, float] = (1.0, 1.0, 1.0)


def read_settings(path: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Settings of a TOML file's section, each overridden by a variable of the environment; unknown keys are passed over, and weights
    that are no three numbers are equal ones."""
    import tomllib

    found: dict[str, str] = {}
    if path and os.path.isfile(path):
        with open(path, "rb") as file:
            found = {k: str(v) for k, v in tomllib.load(file).get(SECTION, {}).items()}
    environment = os.environ if environment is None else environment
    names = [f.name for f in fields(Settings)]
    found |= {n: environment[PREFIX + n.upper()] for n in names if environment.get(PREFIX + n.upper())}
    told = {k: rt.parse_weights(v) if k == "rrf_weights" else v for k, v in found.items() if k in names}
    return replace(Settings(), **told)


class HashEmbedder:
    """Token counts by hash: needs no model."""

    name, dimension = "hash-16", 16

    def __call__(self, texts: Sequence[str]):
        return rt.hash_embedder(texts, self.dimension)

    queries = __call__


class LocalEmbedder:
    """A sentence model on this machine; it is loaded where it is used, so executors load their own."""

    def __init__(self, model: str, passage: str = PASSAGE, question: str = QUESTION, load: Callable | None = None):
        self.model, self.passage, self.question, self._load, self._loaded = model, passage, question, load, None
        self.name = f"local:{embedder_identity(model)}" + ("+prefixes" if passage or question else "")

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    def _encode(self, texts: Sequence[str]):
        if self._loaded is None:
            self._loaded = (self._load or _sentence_model)(self.model)
        return self._loaded.encode(list(texts), normalize_embeddings=True)

    def __call__(self, texts: Sequence[str]):
        return self._encode([self.passage + t for t in texts])

    def queries(self, texts: Sequence[str]):
        return self._encode([self.question + t for t in texts])


def _sentence_model(name: str, kind: str = "SentenceTransformer"):
    try:
        import sentence_transformers
    except ImportError as missing:
        raise Unavailable("sentence_transformers is not installed") from missing
    try:
        return getattr(sentence_transformers, kind)(name)
    except Exception as error:
        raise Unavailable(f"{name} cannot be loaded: {error}") from error


class ApiEmbedder:
    """A service with an OpenAI-compatible /embeddings end point. post(url, headers, body) sends a request and gives the answer's text."""

    def __init__(self, base: str, model: str, key: str, post: Callable | None = None):
        self.url, self.model, self.key, self.post = base.rstrip("/") + "/embeddings", model, key, post or _post
        self.name = f"api:{model}"

    def __call__(self, texts: Sequence[str]):
        import numpy as np

        answer = json.loads(self.post(self.url, {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}, json.dumps({"model": self.model, "input": list(texts)})))
        return np.array([item["embedding"] for item in answer["data"]], dtype=np.float32)

    queries = __call__


def _post(url: str, headers: dict, body: str) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, data=body.encode(), headers=headers), timeout=60) as answer:
        return answer.read().decode()


class CrossEncoder:
    """Scores of a query with each text between 0 and 1, from a cross-encoder's logits."""

    def __init__(self, model: str, load: Callable | None = None):
        self.model, self._load, self._loaded = model, load, None

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    def __call__(self, query: str, texts: Sequence[str]) -> list[float]:
        if not texts:
            return []
        if self._loaded is None:
            self._loaded = (self._load or (lambda name: _sentence_model(name, "CrossEncoder")))(self.model)
        return [1 / (1 + math.exp(-float(z))) for z in self._loaded.predict([[query, t] for t in texts])]


def make_embedder(settings: Settings, environment: Mapping[str, str] | None = None):
    if settings.embedder == "hash":
        return HashEmbedder()
    if settings.embedder == "local":
        return LocalEmbedder(settings.local_model, settings.passage_prefix, settings.query_prefix)
    if settings.embedder == "api":
        key = (os.environ if environment is None else environment).get(settings.api_key_env)
        if not (settings.api_base and settings.api_model and key):
            raise Unavailable(f"an api embedder needs api_base, api_model and a key in {settings.api_key_env}")
        return ApiEmbedder(settings.api_base, settings.api_model, key)
    raise Unavailable(f"no embedder of the kind {settings.embedder!r}")


def make_reranker(settings: Settings):
    return {"off": None, "lexical": rt.lexical_overlap}[settings.reranker] if settings.reranker in ("off", "lexical") else CrossEncoder(settings.reranker_model)


def index_pending(rows: DataFrame, embedder, batch: int = 32, most: int = kb.MAX_ATTEMPTS) -> DataFrame:
    """rows (id, text, state, attempts, embedding) after a round of indexing: failed rows with attempts left are tried again, pending ones
    embedded in batches; a failing batch is marked and the others go on. Rows that are indexed are not read by the model."""
    queued = kb.requeue(rows, most)
    waiting = queued.where("state = 'pending'")
    done = rt.embed(waiting, embedder, batch=batch).withColumn("attempts", F.col("attempts") + 1)
    return queued.where("state <> 'pending'").unionByName(done.select(*rows.columns))


def reindex(rows: DataFrame, embedder, batch: int = 32) -> DataFrame:
    """rows embedded anew, whatever their state."""
    fresh = rows.withColumns({"state": F.lit("pending"), "attempts": F.lit(0)})
    return index_pending(fresh, embedder, batch)
