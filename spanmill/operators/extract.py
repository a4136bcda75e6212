"""The message and prompt base as tables that grow: each run takes sessions that no run has taken, and writes only what they add.

Below a folder: messages/run=N (new texts, one for each KEY), seen/run=N (which session had which), prompts/run=N (new prompt
versions), sources/run=N (sessions taken, with their prompt version). The sources are written last. A run that was interrupted
before has no effect and is done again under its number; one interrupted there has some of its sessions done, and the next run
finds the others' texts held. One run at a time.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions import records as rc
from spanmill.functions.chunking import MAX_CHARS
from spanmill.operators import knowledge as kb
from spanmill.session import broadcast_small, cut

log = logging.getLogger(__name__)

_KEY = "content_hash string, client string, role string"
TABLES = {
    "messages": f"{_KEY}, session_id string, record_index long, message_index long, model string, timestamp string, text string, seen_at string",
    "seen": f"{_KEY}, session_id string, seen_at string",
    "prompts": "content_hash string, client string, model string, system_prompt string, developer_prompt string, user_prompt string, tools string",
    "sources": "session_id string, client string, model string, content_hash string, seen_at string",
}
ORDER = ("seen_at", "session_id", "record_index", "message_index")


def _all_runs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = f"{TABLES[name]}, run long"
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def last_run(spark: SparkSession, folder: str) -> int:
    """The number of the last run that counts, -1 before the first."""
    last = _all_runs(spark, folder, "sources").agg(F.max("run")).first()[0]
    return -1 if last is None else last


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of TABLES with the run that wrote each row. A session's sight of a text counts once."""
    rows = _all_runs(spark, folder, name).where(F.col("run") <= last_run(spark, folder))
    if name != "seen":
        return rows
    return rows.groupBy(*kb.KEY, "session_id").agg(F.min("seen_at").alias("seen_at"), F.min("run").alias("run"))


def extract(sessions: DataFrame, records: DataFrame, folder: str, purged: DataFrame | None = None, limit: int | None = None, most: int | None = MAX_CHARS) -> dict:
    """Take at most limit sessions (id, client) that are not taken yet, in order of their ids, with their records (session_id,
    record_index, payload); how many sessions there were, and how many texts by role and prompt versions are new.

    Texts of more than most characters are taken in pieces, with None whole. Texts in purged (KEY) stay out. Sessions without records are taken as well. Sessions that come with several rows count once,
    with the least client; those without an id are left out, a client that is null or empty is called unknown. Without sessions
    to take, nothing is written.
    """
    spark = sessions.sparkSession
    held = last_run(spark, folder)
    number = held + 1
    client = F.coalesce(F.nullif(F.col("client"), F.lit("")), F.lit("unknown"))
    known = sessions.where(F.col("id").isNotNull()).groupBy(F.col("id").cast("string").alias("id")).agg(F.min(client).alias("client"))
    todo = cut(kb.unprocessed(known, read(spark, folder, "sources"), limit).select(F.col("id").alias("session_id"), "client"))
    done = {"sessions": todo.count(), "user": 0, "assistant": 0, "prompts": 0}
    if not done["sessions"]:
        return done
    mine = records.select(F.col("session_id").cast("string").alias("session_id"), "record_index", "payload").join(broadcast_small(todo), "session_id")
    of = lambda found: found.join(broadcast_small(todo), "session_id")

    def write(frame: DataFrame, name: str) -> DataFrame:
        path, columns = f"{folder}/{name}/run={number}", [c.split(" ")[0] for c in TABLES[name].split(", ")]
        frame.select(*columns).write.mode("overwrite").parquet(path)
        return spark.read.schema(TABLES[name]).parquet(path)

    said = of(rc.messages(mine, most)).withColumn("seen_at", F.col("timestamp"))
    said = cut(kb.without_purged(said, purged) if purged is not None else said)
    before = _all_runs(spark, folder, "messages").where(F.col("run") <= held).select(*kb.KEY)
    fresh = kb.unique_messages(said, ORDER).join(before, list(kb.KEY), "left_anti")
    done |= {r["role"]: r["count"] for r in write(fresh, "messages").groupBy("role").count().collect()}  # a row a role
    write(kb.occurrences(said), "seen")

    shown = cut(of(rc.snapshots(mine)))
    version = ["content_hash", "client", "model"]
    rest = F.struct("session_id", "system_prompt", "developer_prompt", "user_prompt", "tools")
    prompts = shown.groupBy(*version).agg(F.min_by(rest, F.struct("seen_at", "session_id")).alias("_p")).select(*version, "_p.*")
    old = _all_runs(spark, folder, "prompts").where(F.col("run") <= held).select(*version)
    done["prompts"] = write(prompts.join(old, version, "left_anti"), "prompts").count()
    write(todo.join(shown.select("session_id", "model", "content_hash", "seen_at"), "session_id", "left"), "sources")
    log.info("run %s: took %s, wrote to %s", number, done, folder)
    return done


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt versions of all runs with when they were seen and in how many sessions (see knowledge.timeline)."""
    return kb.versions(read(spark, folder, "sources").where(F.col("content_hash").isNotNull()), ["seen_at", "session_id"])
