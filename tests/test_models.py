import json

import numpy as np
import pytest

from spanmill.operators import models, retrieval as rt


def test_settings(tmp_path):
    (tmp_path / "s.toml").write_text('[retrieval]\nembedder = "local"\nlocal_model = "x/y"\nrrf_weights = "1,0,2"\nodd = 3\n')
    s = models.read_settings(str(tmp_path / "s.toml"), {"SPANMILL_LOCAL_MODEL": "a/b", "SPANMILL_RERANKER": ""})
    assert (s.embedder, s.local_model, s.rrf_weights, s.reranker) == ("local", "a/b", (1.0, 0.0, 2.0), "lexical")
    assert models.read_settings(None, {"SPANMILL_RRF_WEIGHTS": "1,x"}).rrf_weights == (1.0, 1.0, 1.0)
    assert models.read_settings(str(tmp_path / "none.toml"), {}) == models.Settings()


class Sentences:
    def __init__(self, name):
        self.name = name

    def encode(self, texts, normalize_embeddings):
        return np.array([[len(t), 1.0] for t in texts])

    def predict(self, pairs):
        return [0.0 if "none" in t else 2.0 for _, t in pairs]


def test_embedders():
    e = models.LocalEmbedder("/cache/models--org--small/snapshots/1", load=Sentences)
    assert e.name == "local:org/small+prefixes"
    assert e(["ab"])[0][0] == 2 + len(models.PASSAGE) and e.queries(["ab"])[0][0] == 2 + len(models.QUESTION)
    sent = []

    def post(url, headers, body):
        sent.append((url, headers["Authorization"], json.loads(body)))
        return json.dumps({"data": [{"embedding": [1, 2]}, {"embedding": [3, 4]}]})

    api = models.ApiEmbedder("https://api.example/v1/", "m", "k", post)
    assert api(["a", "b"]).tolist() == [[1, 2], [3, 4]] and sent == [("https://api.example/v1/embeddings", "Bearer k", {"model": "m", "input": ["a", "b"]})]
    with pytest.raises(models.Unavailable):
        models.make_embedder(models.Settings(embedder="api"), {})
    with pytest.raises(models.Unavailable):
        models.make_embedder(models.Settings(embedder="odd"))
    assert models.make_embedder(models.Settings()).name == "hash-16"


def test_rerankers():
    c = models.CrossEncoder("x", load=Sentences)
    assert c("q", ["none", "some"]) == pytest.approx([0.5, 1 / (1 + np.exp(-2))]) and c("q", []) == []
    assert models.make_reranker(models.Settings(reranker="off")) is None and models.make_reranker(models.Settings()) is rt.lexical_overlap


def test_rounds_of_indexing(spark):
    rows = spark.createDataFrame([(1, "a", "pending", 0, None), (2, "boom", "pending", 2, None), (3, "c", "failed", 1, None), (4, "d", "failed", 3, None), (5, "e", "indexed", 1, [9.0])], "id long, text string, state string, attempts int, embedding array<float>")

    def embedder(texts):
        if "boom" in texts:
            raise RuntimeError("no")
        return np.ones((len(texts), 1), dtype=np.float32)

    after = {r["id"]: (r["state"], r["attempts"], r["embedding"]) for r in models.index_pending(rows, embedder, batch=1).collect()}
    assert after == {1: ("indexed", 1, [1.0]), 2: ("failed", 3, None), 3: ("indexed", 2, [1.0]), 4: ("failed", 3, None), 5: ("indexed", 1, [9.0])}
    again = {r["id"]: (r["state"], r["embedding"]) for r in models.reindex(rows.where("id <> 2"), embedder).collect()}
    assert again == {i: ("indexed", [1.0]) for i in (1, 3, 4, 5)}
