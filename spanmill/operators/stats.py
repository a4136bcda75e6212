"""Usage statistics over sessions.

A summary is JSON in one of two shapes: that of the live writer (api_calls, *_tokens, models_used, has_error) or that
of the listing (status, model, *_tokens, total_tokens). with_summary() reads both into columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions import text as tx
from spanmill.operators.sessions import summary_field

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens")


def top_model(models_used: Column) -> Column:
    """The most used model of JSON {model: calls}; the first among equals."""
    pairs = F.map_entries(F.from_json(models_used, "map<string,bigint>"))
    ranked = F.transform(pairs, lambda e, i: F.struct(e["value"].alias("n"), (-i).alias("i"), e["key"].alias("model")))
    return F.array_max(ranked)["model"]


def with_summary(sessions: DataFrame) -> DataFrame:
    """sessions with token counts (0 where absent), model ('' where unknown) and failed."""
    counts = {t: F.coalesce(summary_field(t).try_cast("long"), F.lit(0)) for t in TOKENS}
    named = F.nullif(summary_field("model"), F.lit(""))
    model = F.coalesce(F.nullif(named, F.lit("unknown")), top_model(summary_field("models_used")), F.lit(""))
    failed = F.coalesce(F.col("status") == "error", F.lit(False)) | F.coalesce(summary_field("has_error") == "true", F.lit(False)) | F.coalesce(summary_field("status") == "error", F.lit(False))
    return sessions.withColumns(counts | {"model": F.when(model == "unknown", "").otherwise(model), "failed": failed})


def in_dates(sessions: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Sessions of the days date_from to date_to, both included."""
    if date_from:
        sessions = sessions.where(F.col("date_key") >= date_from)
    return sessions.where(F.col("date_key") <= date_to) if date_to else sessions


def _tokens() -> Column:
    total = F.lit(0)
    for t in TOKENS:
        total = total + F.col(t)
    return F.coalesce(F.sum(total), F.lit(0)).alias("tokens")


def totals(summarised: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOKENS]
    return summarised.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"), *sums, F.count_if("failed").alias("errors"))


def by(summarised: DataFrame, key: Column | str, name: str) -> DataFrame:
    """sessions and tokens of each value of key, null and '' together as ''; most tokens first, then by key."""
    key = F.col(key) if isinstance(key, str) else key
    return summarised.groupBy(F.coalesce(key, F.lit("")).alias(name)).agg(F.count(F.lit(1)).alias("sessions"), _tokens()).orderBy(F.desc("tokens"), name)


def by_day(summarised: DataFrame) -> DataFrame:
    return by(summarised, "date_key", "date").orderBy("date")


def by_model(summarised: DataFrame) -> DataFrame:
    return by(summarised.where(F.col("model") != ""), "model", "model")


def session_aggregates(sessions: DataFrame) -> DataFrame:
    """Count, records, total tokens as summarised, and errors (an active session with an error summary is one)."""
    error = (F.col("status") == "error") | ((F.col("status") == "active") & F.coalesce(summary_field("status") == "error", F.lit(False)))
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"), F.coalesce(F.sum(summary_field("total_tokens").try_cast("long")), F.lit(0)).alias("tokens"), F.count_if(error).alias("errors"))


def agent_buckets(sessions: DataFrame) -> DataFrame:
    """Sessions by agent: the summary's, else the client's name, else Unknown."""
    agent = F.coalesce(F.nullif(summary_field("agent"), F.lit("")), F.nullif(F.col("client"), F.lit("")), F.lit("Unknown"))
    return sessions.groupBy(agent.alias("agent")).agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.lower("agent"), "agent")


def fold_buckets(buckets: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Buckets under display labels, merged by key."""
    named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.lower("agent")] if labels else F.lit(None).cast("string")
    shown = buckets.withColumn("label", F.coalesce(named, F.col("agent")))
    return shown.groupBy(tx.slug(F.col("label")).alias("key")).agg(F.min("label").alias("label"), F.sum("sessions").alias("sessions"))


def session_summaries(described: DataFrame) -> DataFrame:
    """A summary of each session from described records (see functions.records): sums, the most used model (first among
    equals), the model used last, distinct whole turns (or the record count), status, previews and the first error."""
    p = tx.is_primary(F.col("path"))
    order = F.col("record_index")
    counted = described.where(F.col("model") != "").groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    mode = counted.groupBy("session_id").agg(F.max_by("model", F.struct("_n", -F.col("_first"))).alias("model_mode"))
    error = tx.is_error(F.col("path"), F.col("status"), F.col("error"))
    aux = tx.is_auxiliary_error(F.col("path"), F.col("status"))
    shown = p | ~tx.is_auxiliary(F.col("path"))
    first_user = F.coalesce(F.min_by("first_user", F.when(p & (F.col("first_user") != ""), order)), F.min_by("first_user", F.when(shown & (F.col("first_user") != ""), order)), F.lit(""))
    last_response = F.coalesce(F.max_by("response_text", F.when(p & (F.col("response_text") != ""), order)), F.max_by("response_text", F.when(shown & (F.col("response_text") != ""), order)), F.lit(""))
    sums = [F.coalesce(F.sum(F.col(f"usage.{u}")), F.lit(0)).alias(t) for t, u in zip(TOKENS, ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))]
    out = described.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("record_count"), F.count_distinct("turn").alias("_turns"), F.sum(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"), *sums,
        F.max_by("model", F.when(F.col("model") != "", order)).alias("model_last"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("updated_at"),
        (F.max(error) | (F.max(aux) & ~F.max(tx.is_primary_success(F.col("path"), F.col("status"))))).alias("failed"), F.min_by("error", F.when(error & (F.col("error") != ""), order)).alias("error"),
        tx.preview(first_user, 220).alias("first_user"), tx.preview(last_response, 220).alias("last_response"), F.min_by("agent", order).alias("agent"),
    )
    total = sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))
    return out.join(mode, "session_id", "left").withColumns({"turn_count": F.when(F.col("_turns") > 0, F.col("_turns")).otherwise(F.col("record_count")), "total_tokens": total, "model": F.coalesce("model_mode", F.lit("unknown")), "status": F.when(F.col("failed"), "error").otherwise("complete"), "error": F.coalesce("error", F.lit("")), "agent_key": tx.slug(F.col("agent"))}).drop("_turns", "model_mode")


def path_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(tx.path_only(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("records")).orderBy("path")


def viewer_totals(records: DataFrame) -> DataFrame:
    """Tokens and cache hit rate over records with usage columns input, output, cache_read, cache_create and cache_inside."""
    base = F.sum(F.when(F.col("cache_inside"), F.col("input")).otherwise(F.col("input") + F.col("cache_read") + F.col("cache_create")))
    return records.agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum(F.col("input") + F.col("output")).alias("tokens"), F.when(base > 0, F.floor(F.sum("cache_read") * 100.0 / base + 0.5)).cast("long").alias("cache_hit_percent"))


def match_counts(texts: DataFrame, variants: list[str], text: str = "text") -> DataFrame:
    """texts with matches: the most non-overlapping occurrences of any variant of a query; entries without go."""
    counts = [tx.count_matches(F.lower(F.col(text)), v.lower()) for v in variants]
    return texts.withColumn("matches", F.greatest(*counts) if len(counts) > 1 else counts[0]).where(F.col("matches") > 0)


def match_address(counted: DataFrame, k: int, order: str) -> DataFrame:
    """The entry of the k-th match (from 0) over all entries in order, and its place among the entry's own."""
    upto = F.sum("matches").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("_upto", upto).where((F.col("_upto") > k) & (F.col("_upto") - F.col("matches") <= k)).withColumn("local", F.lit(k) - F.col("_upto") + F.col("matches")).drop("_upto")
