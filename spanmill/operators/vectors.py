"""A stored vector index: inverted lists around centroids, partitioned by list.

Vectors are scaled to length 1 and belong to the list of the centroid of greatest cosine. The centroids are found by k-means of
Spark's machine-learning library over at most SAMPLE_PER_LIST vectors a list, chosen by a hash of their id; every vector is put into
a list. A list keeps its reach, the largest angle between its centroid and one of its vectors: nothing in it can be nearer to a
query than the query's angle to the centroid less the reach. A search goes through the lists in the order of their centroids, a few at
a time, and reads only these partitions. With ``probes`` it ends after so many lists; without, it ends when the reach of those
left rules them out, so its result is that of comparing all vectors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.operators.retrieval import RECALL, cosine
from spanmill.session import cut

#: Vectors of a list that the centroids are fitted to at most, vectors that a list has at least on average, and lists at most.
SAMPLE_PER_LIST, LEAST_PER_LIST, MOST_LISTS = 256, 64, 4096
#: Lists that a search reads at once.
STEP = 4
#: Angles are compared with so much room for rounding.
ROOM = 1e-6


def lists_for(rows: int) -> int:
    """The square root of the number of vectors, but for few or very many of them."""
    return max(1, min(math.isqrt(rows), rows // LEAST_PER_LIST, MOST_LISTS))


def _unit(embedding: Column) -> Column:
    wide = embedding.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def build_lists(vectors: DataFrame, folder: str, lists: int | None = None, seed: int = 7) -> None:
    """Write the index of vectors (id, embedding) below folder: ``lists/list=L`` and ``centroids`` (list, centroid, reach, rows).

    Null vectors are left out, as no search can find them. Ids may repeat. Runs over the same vectors give the same lists.
    """
    kept = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding")
    rows = kept.count()
    lists = lists or lists_for(rows)
    unit = kept.withColumn("_u", _unit(F.col("embedding")))
    share = min(1.0, lists * SAMPLE_PER_LIST / max(1, rows))
    sample = unit.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(array_to_vector("_u").alias("features"))
    if lists > 1:
        model = KMeans(k=lists, seed=seed, maxIter=10).fit(cut(sample))
        found = np.array(model.clusterCenters())
        norms = np.linalg.norm(found, axis=1, keepdims=True)
        centroids = found / np.where(norms > 0, norms, 1)
    else:
        centroids = np.zeros((1, len(first["_u"]) if (first := unit.select("_u").first()) else 0))

    def assign(batches):
        for pdf in batches:
            best = np.array([], dtype=int) if not len(pdf) else (np.stack(pdf["_u"]) @ centroids.T)
            at = best.argmax(axis=1) if len(pdf) else best
            near = best.max(axis=1) if len(pdf) else np.array([])
            yield pdf[["id", "embedding"]].assign(angle=np.arccos(np.clip(near, -1, 1)), list=at.astype("int32"))

    id_type = kept.schema["id"].dataType.simpleString()
    kind = kept.schema["embedding"].dataType.simpleString()
    dealt = unit.mapInPandas(assign, f"id {id_type}, embedding {kind}, angle double, list int")
    dealt.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{folder}/lists")
    spark = vectors.sparkSession
    reach = _lists(spark, folder, dealt).groupBy("list").agg(F.max("angle").alias("reach"), F.count(F.lit(1)).alias("rows"))
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    named.join(reach, "list").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")


def _lists(spark: SparkSession, folder: str, like: DataFrame | None = None) -> DataFrame:
    return spark.read.schema(like.schema).parquet(f"{folder}/lists") if like is not None else spark.read.parquet(f"{folder}/lists")


def search_lists(spark: SparkSession, folder: str, query: Sequence[float], k: int = RECALL, probes: int | None = None) -> DataFrame:
    """The k nearest of positive cosine (id, score), ties by id: of all vectors, or of the first probes lists."""
    q = np.asarray(query, dtype=np.float64)
    q = q / (np.linalg.norm(q) or 1.0)
    held = spark.read.parquet(f"{folder}/centroids").collect()  # at most MOST_LISTS
    if not held:
        return spark.createDataFrame([], "id long, score double")
    stored = spark.read.parquet(f"{folder}/lists")
    # Centroids of length 0 (one list) say nothing: their vectors are at any angle.
    angles = {r["list"]: math.acos(float(np.clip(np.dot(q, r["centroid"]), -1, 1))) if np.any(r["centroid"]) else 0.0 for r in held}
    least = {r["list"]: max(0.0, angles[r["list"]] - r["reach"] - ROOM) for r in held}
    order = sorted(angles, key=lambda x: (angles[x], x)) if probes is not None else sorted(angles, key=lambda x: (least[x], x))
    order = order[:probes] if probes is not None else order
    top = None
    while order:
        step, order = order[:STEP], order[STEP:]
        near = stored.where(F.col("list").isin(*step)).select("id", cosine(F.col("embedding"), query).alias("score")).where("score > 0")
        near = near if top is None else near.unionByName(top)
        top = cut(near.orderBy(F.desc("score"), "id").limit(k))
        if probes is None and order:
            worst = top.agg(F.min("score"), F.count(F.lit(1))).first()
            limit = math.acos(min(1.0, worst[0])) if worst[1] >= k else math.pi / 2
            order = [x for x in order if least[x] <= limit + ROOM]
    return top.orderBy(F.desc("score"), "id")


def recall(spark: SparkSession, folder: str, vectors: DataFrame, queries: Sequence[Sequence[float]], probes: int, k: int = RECALL) -> float:
    """Share of the true k nearest that so many probes find, over some queries."""
    found = total = 0
    for q in queries:
        exact = {r["id"] for r in vectors.select("id", cosine(F.col("embedding"), q).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k).collect()}
        found += len(exact & {r["id"] for r in search_lists(spark, folder, q, k, probes).collect()})
        total += len(exact)
    return found / total if total else 1.0
