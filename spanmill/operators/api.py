"""What the read and write end points of a trace service give, as one call each.

Answers are DataFrames, or plain values where they are a handful of numbers; nothing here reads a clock.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import records as rc
from spanmill.functions import text as tx
from spanmill.operators import knowledge as kb, retrieval as rt, sessions as ss, stats as st


def sessions_view(sessions: DataFrame, *texts: DataFrame, date=None, status=None, agent=None, search=None, limit=None, offset=None, known_agents: Sequence[str] = (), as_of: Column | None = None) -> dict:
    """A page of sessions with aggregates over all that match, the dates there are, and whether more follow."""
    live = ss.finalize_stale(sessions, as_of) if as_of is not None else sessions
    n, at = ss.clamp_page(limit, offset)
    found = ss.filter_sessions(live, ss.build_query(date, status, agent, search, known_agents), *texts)
    totals = st.session_aggregates(found).first().asDict()
    return {"page": ss.page(found, n, at), "totals": totals, "dates": ss.list_dates(live), "has_more": at + n < totals["sessions"]}


def stats_view(sessions: DataFrame, date_from: str | None = None, date_to: str | None = None) -> dict[str, DataFrame]:
    """Totals and the four groupings of the days from date_from to date_to; bad or reversed days are an error."""
    for day in (date_from, date_to):
        if day and not re.match(ss.DATE, day):
            raise ValueError(f"no date: {day!r}")
    if date_from and date_to and date_from > date_to:
        raise ValueError("the range is reversed")
    s = st.with_summary(st.in_dates(sessions, date_from, date_to))
    return {"totals": st.totals(s), "daily": st.by_day(s), "clients": st.by(s, "client", "client"), "projects": st.by(s, "cwd", "project"), "models": st.by_model(s)}


def session_view(sessions: DataFrame, records: DataFrame, session_id: str, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A session's row, and a page of its records with credentials marked."""
    rows = ss.record_page(records, session_id, limit, max(0, offset))
    return sessions.where(F.col("id") == session_id), rows.withColumn("payload", rc.redact_json()(F.col("payload")))


def delete_view(sessions: DataFrame, ids: Sequence[str], live: Sequence[str] = ()) -> DataFrame:
    """What would become of ids: deletable, active (protected) or missing."""
    asked = sessions.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids) if i], "id string")
    known = sessions.select("id", ss.deletable(live).alias("_free"))
    return asked.join(known, "id", "left").select("id", F.when(F.col("_free").isNull(), "missing").when(F.col("_free"), "deletable").otherwise("active").alias("fate"))


def with_live(sessions: DataFrame, live: DataFrame) -> DataFrame:
    """sessions with those of live (id, live_count) marked; a count is the larger of the stored and the live one."""
    joined = sessions.join(live.select("id", "live_count"), "id", "left")
    return joined.withColumns({"live": F.col("live_count").isNotNull(), "record_count": F.greatest("record_count", F.coalesce("live_count", F.lit(0))), "status": F.when(F.col("live_count").isNotNull(), "active").otherwise(F.col("status"))}).drop("live_count")


def cached_summary(sessions: DataFrame) -> DataFrame:
    """Sessions as listed from their summaries: the row's own times, counts and status win; tokens are the sum of the four
    counts, or the stored total where that is zero."""
    s = st.with_summary(sessions)
    total = sum((F.col(t) for t in st.TOKENS[1:]), F.col(st.TOKENS[0]))
    stored = F.coalesce(ss.summary_field("total_tokens").try_cast("long"), F.lit(0))
    return s.withColumns({"total_tokens": F.when(total > 0, total).otherwise(stored), "first_user": F.coalesce(ss.summary_field("first_user"), F.lit("")), "last_response": F.coalesce(ss.summary_field("last_response"), F.lit("")), "error": F.coalesce(ss.summary_field("error"), F.lit(""))})


def repaired_summary(cached: DataFrame, records: DataFrame) -> DataFrame:
    """Cached summaries with texts, times and agent read anew from each session's first and last record; totals stay."""
    ends = records.join(records.groupBy("session_id").agg(F.min("record_index").alias("_a"), F.max("record_index").alias("_b")), "session_id").where("record_index = _a OR record_index = _b").drop("_a", "_b")
    fresh = st.session_summaries(rc.described(ends)).select(F.col("session_id").alias("id"), F.col("first_user").alias("_u"), F.col("last_response").alias("_r"), F.col("agent").alias("_g"))
    return cached.join(fresh, "id", "left").withColumns({"first_user": F.coalesce(F.nullif("_u", F.lit("")), "first_user"), "last_response": F.coalesce(F.nullif("_r", F.lit("")), "last_response"), "agent": F.col("_g")}).drop("_u", "_r", "_g")


def run_totals(described: DataFrame) -> DataFrame:
    """What a finished run reports: calls, calls by model, tokens and its status. Failed probes alone do not fail a run that
    had a success."""
    p, s = F.col("path"), F.col("status")
    models = described.where("model <> ''").groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("_n")).groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "_n")))).alias("models_used"))
    sums = [F.coalesce(F.sum(F.col(f"usage.{u}")), F.lit(0)).alias(t) for t, u in zip(st.TOKENS, ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))]
    failed = F.max(tx.is_error(p, s, F.col("error"))) | (F.max(tx.is_auxiliary_error(p, s)) & ~F.max(tx.is_primary_success(p, s)))
    out = described.groupBy("session_id").agg(F.count(F.lit(1)).alias("api_calls"), *sums, failed.alias("has_error")).join(models, "session_id", "left")
    return out.withColumn("status", ss.run_status(F.col("api_calls"), F.col("has_error")))


def kb_search(docs: DataFrame, vectors: DataFrame, query: str, embedder: Callable = rt.hash_embedder, group: str = "client", client: str | None = None, kind: str | None = None, **options) -> DataFrame:
    """The search with the query embedded here, within one client or kind if asked."""
    within = None
    for column, value in (("client", client), ("kind", kind)):
        if value is not None:
            within = F.col(column) == value if within is None else within & (F.col(column) == value)
    return rt.search(docs, vectors, query, [float(x) for x in embedder([query])[0]], group, within=within, **options)


def kb_recall(messages: DataFrame, vectors: DataFrame, query: str, limit: int = 5, min_score: float | None = None, **options) -> DataFrame:
    """The best remembered messages with where they come from (messages: id, text, session_id, client, seen_at)."""
    hits = kb_search(messages, vectors, query, group="session_id", **options)
    return rt.recall_memories(hits.join(messages.select("id", "client", "seen_at"), "id"), limit, min_score).withColumn("text", tx.truncate(F.col("text"), 300))


def kb_recent(seen: DataFrame, messages: DataFrame, sessions: int = 5, messages_per_session: int = 3, client: str | None = None) -> DataFrame:
    return kb.recent_overview(seen, messages, sessions, messages_per_session, client=client)


def kb_status(rows: DataFrame, embedder: tuple[str, int] | None = None, reranker: str | None = None) -> dict:
    return {"rows": [r.asDict() for r in kb.index_stats(rows).collect()], "embedder": embedder, "reranker": reranker}


def diff_candidates(entries: DataFrame, scope: str, idx: int) -> DataFrame:
    """Earlier entries of a run that one may be compared with: by model, the most recent model and entry first."""
    from pyspark.sql import Window

    before = entries.where((F.col("scope") == scope) & (F.col("idx") < idx))
    return before.withColumn("_latest", F.max("idx").over(Window.partitionBy("model"))).orderBy(F.desc("_latest"), F.desc("idx")).drop("_latest")
