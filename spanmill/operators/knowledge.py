"""The message and prompt base: deduplication, tombstones, survivors, versions, recency, index states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions import text as tx

KEY = ("content_hash", "client", "role")
MAX_ATTEMPTS = 3


def unique_messages(messages: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row for each (hash, client, role): the first in order keeps its attribution; last_seen is that of the last."""
    cols = [c for c in messages.columns if c not in KEY]
    first = F.min_by(F.struct(*cols), F.struct(*order)).alias("_first")
    out = messages.groupBy(*KEY).agg(first, F.max_by("seen_at", F.struct(*order)).alias("last_seen"), F.count(F.lit(1)).alias("copies"))
    return out.select(*KEY, "_first.*", "last_seen", "copies")


def occurrences(messages: DataFrame) -> DataFrame:
    """One row for each message and session, with the time it was first seen there."""
    return messages.groupBy(*KEY, "session_id").agg(F.min("seen_at").alias("seen_at"))


def without_purged(messages: DataFrame, purged: DataFrame) -> DataFrame:
    return messages.join(purged.select(*KEY).distinct(), list(KEY), "left_anti")


def variants(messages: DataFrame, content_hash: str) -> DataFrame:
    return messages.where(F.col("content_hash") == content_hash).select("client", "role").distinct()


def purge(messages: DataFrame, purged: DataFrame, content_hash: str, client: str | None = None, role: str | None = None) -> tuple[DataFrame, DataFrame]:
    """messages without a text, and purged with tombstones for it: for all its variants, or for the one named, even if unseen."""
    spark = messages.sparkSession
    if client is not None and role is not None:
        stones = spark.createDataFrame([(content_hash, client, role)], "content_hash string, client string, role string")
    else:
        stones = variants(messages, content_hash).select(F.lit(content_hash).alias("content_hash"), "client", "role")
    after = purged.select(*KEY).unionByName(stones).distinct()
    return without_purged(messages, stones), after


def unpurge(purged: DataFrame, content_hash: str) -> DataFrame:
    return purged.where(F.col("content_hash") != content_hash)


def delete_session(unique: DataFrame, seen: DataFrame, session_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """unique and seen without sessions: a message goes with its last occurrence, else its earliest survivor represents it
    where a deleted session did."""
    gone = session_ids.select("session_id").distinct()
    left = seen.join(gone, "session_id", "left_anti")
    heirs = left.groupBy(*KEY).agg(F.min(F.struct("seen_at", "session_id")).alias("_heir"))
    marked = unique.join(gone.withColumn("_gone", F.lit(True)), "session_id", "left")
    kept = marked.join(heirs, list(KEY))
    return kept.withColumn("session_id", F.when(F.col("_gone"), F.col("_heir.session_id")).otherwise(F.col("session_id"))).drop("_gone", "_heir").select(*unique.columns), left


def unprocessed(sessions: DataFrame, processed: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions that no run has processed yet, in order of their ids."""
    out = sessions.join(processed.select(F.col("session_id").alias("id")).distinct(), "id", "left_anti").orderBy("id")
    return out.limit(limit) if limit is not None else out


def versions(snapshots: DataFrame, order: Sequence[str] = ("seen_at",)) -> DataFrame:
    """Prompt versions by (client, model, hash): first and last seen in processing order, and how many sessions had them."""
    o = F.struct(*order)
    return snapshots.groupBy("client", "model", "content_hash").agg(F.min_by("seen_at", o).alias("first_seen"), F.max_by("seen_at", o).alias("last_seen"), F.count(F.lit(1)).alias("session_count"))


def timeline(version_table: DataFrame, client: str | None = None, model: str | None = None) -> DataFrame:
    """Versions in order of appearance, numbered for each client and model."""
    out = version_table
    out = out.where(F.col("client") == client) if client is not None else out
    out = out.where(F.col("model") == model) if model is not None else out
    return out.withColumn("version", F.row_number().over(Window.partitionBy("client", "model").orderBy("first_seen", "content_hash")))


def index_stats(rows: DataFrame) -> DataFrame:
    """Rows by role and state of indexing."""
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "indexed", "failed")])


def requeue(rows: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    retry = (F.col("state") == "failed") & (F.col("attempts") < most)
    return rows.withColumn("state", F.when(retry, "pending").otherwise(F.col("state")))


def pending(rows: DataFrame, limit: int) -> DataFrame:
    return rows.where(F.col("state") == "pending").orderBy("id").limit(limit)


def indexed_chunks(chunks: DataFrame, version_table: DataFrame, client: str | None = None, kind: str | None = None) -> DataFrame:
    """Indexed chunks (snapshot, kind, title, text, state) with what is known of their prompt version (content_hash, client, model,
    first_seen, last_seen, session_count)."""
    ready = chunks.where(F.col("state") == "indexed")
    ready = ready if kind is None else ready.where(F.col("kind") == kind)
    of = version_table if client is None else version_table.where(F.col("client") == client)
    return ready.join(of.withColumnRenamed("content_hash", "snapshot"), "snapshot")


def indexed_messages(messages: DataFrame, client: str | None = None) -> DataFrame:
    ready = messages.where(F.col("state") == "indexed")
    return ready if client is None else ready.where(F.col("client") == client)


def version_of(version_table: DataFrame, content_hash: str) -> DataFrame:
    return version_table.where(F.col("content_hash") == content_hash)


def replace_chunks(chunks: DataFrame, fresh: DataFrame, key: str = "snapshot") -> DataFrame:
    """chunks with those of fresh's snapshots replaced by fresh."""
    return chunks.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def recent_sessions(seen: DataFrame, limit: int, client: str | None = None) -> DataFrame:
    out = seen if client is None else seen.where(F.col("client") == client)
    return out.groupBy("session_id").agg(F.max("client").alias("client"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")).orderBy(F.desc("last_seen"), F.desc("session_id")).limit(limit)


def first_user_message(messages: DataFrame, order: Sequence[str] = ("seen_at",)) -> DataFrame:
    return messages.where(F.col("role") == "user").groupBy("session_id").agg(F.min_by("text", F.struct(*order)).alias("first_user"))


def last_messages(messages: DataFrame, n: int, order: Sequence[str] = ("seen_at",)) -> DataFrame:
    """The last n messages of each session, oldest of them first (place 1)."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(*[F.desc(c) for c in order]))
    held = messages.withColumn("_back", back).where(F.col("_back") <= n)
    return held.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("_back")))).drop("_back")


def recent_overview(seen: DataFrame, messages: DataFrame, sessions: int = 5, per_session: int = 3, order: Sequence[str] = ("seen_at",), client: str | None = None) -> DataFrame:
    """The newest sessions with what their user asked first (200 characters) and their last messages (300 each)."""
    top = recent_sessions(seen, sessions, client)
    mine = messages.join(F.broadcast(top.select("session_id")), "session_id")
    last = last_messages(mine, per_session, order).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", tx.truncate(F.col("text"), 300).alias("text")))).alias("messages"))
    asked = first_user_message(mine, order).select("session_id", tx.truncate(F.col("first_user"), 200).alias("first_user"))
    return top.join(asked, "session_id", "left").join(last, "session_id", "left").orderBy(F.desc("last_seen"), F.desc("session_id"))
