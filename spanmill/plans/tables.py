"""The trace tables as the driver's tables hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.session import table

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def iso(ts):
    return F.date_format(ts.cast("timestamp"), ISO)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records: a user's events are a session, value stands for tokens, props for the payload."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.floor("value").cast("long").alias("tokens"), F.col("props").alias("payload"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events rolled up to sessions with a summary of the listing's shape."""
    e = events(spark, sf_dir)
    order = F.struct("ts", "event_id")
    rolled = e.groupBy("session_id").agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.min_by("event_type", order).alias("client"), F.max_by("event_type", order).alias("_ends"), F.count(F.lit(1)).alias("record_count"),
        *[F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("tokens"))), F.lit(0)).alias(name) for kind, name in (("view", "input_tokens"), ("click", "output_tokens"), ("purchase", "cache_read_tokens"), ("signup", "cache_create_tokens"))],
        F.min_by("k", order).alias("_k"), F.count_if(F.col("event_type") == "error").alias("_errors"),
    )
    summary = F.to_json(F.struct("input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens", (F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_create_tokens")).alias("total_tokens"), F.concat(F.lit("m"), F.col("_k") % 5).alias("model"), F.when(F.col("_errors") % 7 == 0, "error").otherwise("complete").alias("status")))
    return rolled.select(
        F.col("session_id").alias("id"), iso(F.col("_first")).alias("started_at"), iso(F.col("_last")).alias("updated_at"), F.date_format("_first", "yyyy-MM-dd").alias("date_key"), "client", F.when(F.col("_ends") == "error", "error").when(F.col("_ends") == "signup", "active").otherwise("complete").alias("status"),
        "record_count", summary.alias("summary"), F.concat(F.lit("p"), F.col("session_id").cast("long") % 7).alias("cwd"), F.lit(None).cast("string").alias("legacy_rel_path"),
    )


#: The same sessions for DuckDB.
SESSIONS_SQL = """
e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, ts, event_type, CAST(floor(value) AS BIGINT) AS tokens, props AS payload, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(event_type, ts) AS client, arg_max(event_type, ts) AS ends, count(*) AS record_count,
  CAST(coalesce(sum(tokens) FILTER (event_type = 'view'), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(tokens) FILTER (event_type = 'click'), 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(tokens) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS cache_read_tokens, CAST(coalesce(sum(tokens) FILTER (event_type = 'signup'), 0) AS BIGINT) AS cache_create_tokens,
  arg_min(k, ts) AS k, count(*) FILTER (event_type = 'error') AS errs FROM e GROUP BY session_id),
sessions AS (SELECT session_id AS id, strftime(first_ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS started_at, strftime(last_ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS updated_at, strftime(first_ts, '%Y-%m-%d') AS date_key, client,
  CASE ends WHEN 'error' THEN 'error' WHEN 'signup' THEN 'active' ELSE 'complete' END AS status, record_count, input_tokens, output_tokens, cache_read_tokens, cache_create_tokens,
  input_tokens + output_tokens + cache_read_tokens + cache_create_tokens AS total_tokens, 'm' || CAST(k % 5 AS VARCHAR) AS model, CASE WHEN errs % 7 = 0 THEN 'error' ELSE 'complete' END AS summary_status, 'p' || CAST(CAST(session_id AS BIGINT) % 7 AS VARCHAR) AS cwd FROM r)
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered within their session."""
    from pyspark.sql import Window

    e = events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")) - 1
    return e.select("session_id", n.cast("long").alias("record_index"), "ts", iso(F.col("ts")).alias("timestamp"), "event_type", "tokens", "payload")


RECORDS_SQL = "records AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS record_index, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, event_type, tokens, payload FROM e)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages; seen_at orders the turns of all conversations."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("record_index"), "role", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.concat(F.lit("c"), F.col("conv_id") % 3).alias("client"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seen_at"))


MESSAGES_SQL = "messages AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS record_index, role, text, sha256(coalesce(text, '')) AS content_hash, 'c' || CAST(conv_id % 3 AS VARCHAR) AS client, conv_id * 1000 + turn AS seen_at FROM conversations)"
