"""Session and record operators: filters, listing, boundaries, liveness, retention, deletion.

``sessions`` has the columns of schemas.SESSIONS, of which id, updated_at, started_at, date_key, client, status,
record_count and summary are used here; ``records`` those of schemas.RECORDS. Times are ISO text.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions import text as tx
from spanmill.functions.record import CLIENT_LABELS

STATUSES = ("active", "complete", "error", "empty")
DATE = r"^\d{4}-\d{2}-\d{2}$"
#: Seconds after which an active session without records, or with some, counts as stale.
STALE_EMPTY, STALE_ACTIVE = 15 * 60, 24 * 3600
PAGE_LIMIT, MAX_PAGE = 100, 500


@dataclass(frozen=True)
class SessionQuery:
    """A listing's filters; empty ones filter nothing."""

    date: str = ""
    status: str = ""
    clients: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    search: str = ""


def build_query(date: str | None = None, status: str | None = None, agent: str | None = None, search: str | None = None, known_agents: Sequence[str] = ()) -> SessionQuery:
    """Filters from what a caller typed: bad dates and statuses are dropped, an agent's key is resolved to clients and labels."""
    import re

    date = date if date and (re.match(DATE, date) or date == "legacy") else ""
    status = status if status in STATUSES else ""
    clients, labels = resolve_agent(agent or "", known_agents)
    return SessionQuery(date, status, clients, labels, (search or "").strip())


def agent_key(label: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", "-", label.lower()).strip("-") or "unknown"


def resolve_agent(key: str, known_agents: Sequence[str] = ()) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(clients, labels) that an agent key stands for: known clients first, else labels found in the data."""
    key = key.strip().lower()
    if key in ("", "all"):
        return (), ()
    clients = {c for c, label in CLIENT_LABELS.items() if agent_key(label) == key}
    labels = {CLIENT_LABELS[c] for c in clients}
    if not clients and key != "unknown":
        clients = labels = {a for a in known_agents if agent_key(a) == key}
    if key == "unknown":
        clients, labels = {"", "unknown"}, {"Unknown"}
    return tuple(sorted(clients)), tuple(sorted(labels))


def summary_field(name: str, col: str = "summary") -> Column:
    return F.get_json_object(F.col(col), f"$.{name}")


def has_error_summary() -> Column:
    return F.coalesce(summary_field("status") == "error", F.lit(False))


def status_is(status: str) -> Column:
    """An active session whose summary reports an error counts as error, not as active."""
    if status == "error":
        return (F.col("status") == "error") | ((F.col("status") == "active") & has_error_summary())
    if status == "active":
        return (F.col("status") == "active") & ~has_error_summary()
    return F.col("status") == status


def date_is(date: str) -> Column:
    if date == "legacy":
        return (F.col("date_key") == "legacy") | ~F.coalesce(F.col("legacy_rel_path"), F.lit("/")).contains("/")
    return F.col("date_key") == date


def agent_is(clients: Sequence[str], labels: Sequence[str]) -> Column:
    return F.lower(F.coalesce("client", F.lit(""))).isin(*[c.lower() for c in clients]) | F.coalesce(F.lower(summary_field("agent")).isin(*[x.lower() for x in labels]), F.lit(False))


SEARCHED = ("id", "client", "status", "date_key", "started_at", "updated_at", "summary")


def search(sessions: DataFrame, needle: str, *texts: DataFrame, columns: Sequence[str] = SEARCHED) -> DataFrame:
    """Sessions with needle in one of their columns, or in a payload of texts (session_id, payload), in any case."""
    low = F.lit(needle.lower())
    columns = [c for c in columns if c in sessions.columns]
    own = F.lit(False)
    for c in columns:
        own = own | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), low), F.lit(False))
    hits = sessions.where(own).select("id")
    for t in texts:
        hits = hits.unionByName(t.where(F.contains(F.lower("payload"), low)).select(F.col("session_id").alias("id")))
    return sessions.join(hits.distinct(), "id", "left_semi")


def filter_sessions(sessions: DataFrame, query: SessionQuery, *texts: DataFrame) -> DataFrame:
    out = sessions
    if query.date:
        out = out.where(date_is(query.date))
    if query.status:
        out = out.where(status_is(query.status))
    if query.clients or query.labels:
        out = out.where(agent_is(query.clients, query.labels))
    return search(out, query.search, *texts) if query.search else out


def newest_first() -> list[Column]:
    zero = F.lit("1970-01-01").cast("timestamp")
    return [F.coalesce(tx.instant(F.col("updated_at")), zero).desc(), F.coalesce(tx.instant(F.col("started_at")), zero).desc(), F.col("id").desc()]


def clamp_page(limit=None, offset=None, most: int = MAX_PAGE) -> tuple[int, int]:
    """A page's limit within 1..most and its offset from 0; what is no number takes the default."""

    def number(value, default):
        try:
            return int(value)
        except (TypeError, ValueError):
            return default

    return min(max(number(limit, PAGE_LIMIT), 1), most), max(number(offset, 0), 0)


def page(sessions: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sessions, newest first."""
    out = sessions.orderBy(*newest_first())
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit is not None else out


def record_page(records: DataFrame, session_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    out = records.where(F.col("session_id") == session_id).orderBy("record_index")
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit is not None else out


def records_of_date(records: DataFrame, sessions: DataFrame, date: str) -> DataFrame:
    """Records of a day's sessions in capture order."""
    import re

    if date != "legacy" and not re.match(DATE, date):
        raise ValueError(f"no date: {date!r}")
    day = sessions.where(date_is(date)).select(F.col("id").alias("session_id"), "started_at")
    return records.join(day, "session_id").orderBy("started_at", "session_id", "record_index")


def boundaries(records: DataFrame) -> DataFrame:
    """First and last payload of each session; last is null where both are the same text."""
    out = records.groupBy("session_id").agg(F.min_by("payload", "record_index").alias("first_payload"), F.max_by("payload", "record_index").alias("_last"), F.count(F.lit(1)).alias("records"))
    return out.select("session_id", "records", "first_payload", F.when(F.col("_last") != F.col("first_payload"), F.col("_last")).alias("last_payload"))


def logs_of(logs: DataFrame, session_id: str) -> DataFrame:
    return logs.where(F.col("session_id") == session_id).select("line_no", F.coalesce("logged_at", F.lit("")).alias("logged_at"), F.coalesce("message", F.lit("")).alias("message")).orderBy("line_no")


def find_app_session(sessions: DataFrame, records: DataFrame, needle: str, client: str = "codexapp") -> DataFrame:
    """The fullest session of an app whose first record mentions needle; among equals the newest."""
    first = boundaries(records).select(F.col("session_id").alias("id"), "first_payload")
    hits = sessions.where(F.col("client") == client).join(first, "id").where(F.contains("first_payload", F.lit(needle)))
    return hits.orderBy(F.desc("record_count"), *newest_first()).limit(1).drop("first_payload")


def list_dates(sessions: DataFrame, today: str | None = None) -> DataFrame:
    """Valid dates, newest first, and today's; legacy tells whether sessions without one exist."""
    dates = sessions.select("date_key").where(F.col("date_key").rlike(DATE)).distinct()
    if today:
        dates = dates.union(sessions.sparkSession.createDataFrame([(today,)], "date_key string")).distinct()
    return dates.orderBy(F.desc("date_key"))


def snapshot(sessions: DataFrame) -> DataFrame:
    return sessions.select("id", F.struct("updated_at", "record_count", "status").alias("state"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that two snapshots do not agree on: added, removed or changed."""
    a, b = before.withColumnRenamed("state", "_old"), after.withColumnRenamed("state", "_new")
    both = a.join(b, "id", "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select("id", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed").alias("change"))


def is_stale(as_of: Column) -> Column:
    """An active session past its window; a time that cannot be read counts as long ago."""
    age = F.unix_micros(as_of) / 1e6 - tx.instant_seconds(F.col("updated_at"))
    return (F.col("status") == "active") & (age >= F.when(F.coalesce("record_count", F.lit(0)) == 0, STALE_EMPTY).otherwise(STALE_ACTIVE))


def final_status() -> Column:
    return F.when(has_error_summary(), "error").when(F.coalesce("record_count", F.lit(0)) == 0, "empty").otherwise("complete")


def finalize_stale(sessions: DataFrame, as_of: Column, protected: Sequence[str] = ()) -> DataFrame:
    """Stale sessions get the status they end with; protected ones stay active."""
    stale = is_stale(as_of) & (~F.col("id").isin(*protected) if protected else F.lit(True))
    return sessions.withColumn("status", F.when(stale, final_status()).otherwise(F.col("status")))


def run_status(api_calls: Column, has_error: Column) -> Column:
    """The status a run ends with; without a summary it is complete."""
    return F.when(api_calls == 0, "empty").when(has_error, "error").otherwise("complete")


def retention_victims(sessions: DataFrame, keep: int, as_of: Column, protected: Sequence[str] = ()) -> DataFrame:
    """Ids to delete so that at most keep sessions stay: the oldest that are neither protected nor freshly active."""
    guarded = (F.col("status") == "active") & ~is_stale(as_of)
    if protected:
        guarded = guarded | F.col("id").isin(*protected)
    excess = max(0, sessions.count() - keep)
    return sessions.where(~guarded).orderBy(F.coalesce(tx.instant(F.col("started_at")), F.lit("1970-01-01").cast("timestamp")), "id").limit(excess).select("id")


def delete_sessions(sessions: DataFrame, ids: DataFrame, *dependents: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """What is left of sessions and of tables with a session_id, and for each id asked for whether it was there."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    left = [d.join(gone, d["session_id"] == F.col("_id"), "left_anti") for d in dependents]
    report = gone.join(sessions.select(F.col("id").alias("_id"), F.lit(True).alias("_there")), "_id", "left").select(F.col("_id").alias("id"), F.coalesce("_there", F.lit(False)).alias("deleted"))
    return sessions.join(gone, sessions["id"] == F.col("_id"), "left_anti"), left, report


def delete_date(sessions: DataFrame, date: str, *dependents: DataFrame, protected: Sequence[str] = ()) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """delete_sessions for a day's sessions (or those without a day: legacy) that are neither active nor protected."""
    import re

    if date != "legacy" and not re.match(DATE, date):
        raise ValueError(f"no date: {date!r}")
    return delete_sessions(sessions, sessions.where(date_is(date) & deletable(protected)).select("id"), *dependents)


def create_sessions(sessions: DataFrame, fresh: DataFrame) -> DataFrame:
    """sessions with fresh ones (started_at, and what else is known of them): active, without records, of the day on which they
    began; an id is made where none is given. Ids that are there already stay as they are."""
    begun = tx.instant(F.col("started_at"))
    made = fresh if "id" in fresh.columns else fresh.withColumn("id", F.lit(None).cast("string"))
    made = made.withColumns({"id": F.coalesce("id", F.uuid()), "date_key": F.date_format(begun, "yyyy-MM-dd"), "updated_at": F.col("started_at"), "status": F.lit("active"), "record_count": F.lit(0).cast("long")})
    return sessions.unionByName(made.join(sessions.select("id"), "id", "left_anti"), allowMissingColumns=True)


def _merged_json():
    """A function of two columns of JSON objects: the second over the first, key by key; what is no object counts as empty."""
    def objects(texts):
        for text in texts:
            try:
                value = json.loads(text) if isinstance(text, str) else None
            except ValueError:
                value = None
            yield value if isinstance(value, dict) else {}

    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(a | b, ensure_ascii=False) for a, b in zip(objects(old), objects(new))])

    return F.pandas_udf(run, "string")


def finalize_sessions(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """sessions with what a run told at its end (id, ended_at, summary): its summary over the stored one, and the status that
    follows from its api_calls and has_error; a run that told nothing is complete."""
    told = ends.select("id", F.col("ended_at").alias("_at"), F.col("summary").alias("_told"), F.lit(True).alias("_ended"))
    joined = sessions.join(told, "id", "left")
    nothing = F.coalesce(F.trim("_told").isin("", "{}", "null"), F.lit(True))
    calls, failed = F.get_json_object("_told", "$.api_calls").try_cast("long"), F.coalesce(F.get_json_object("_told", "$.has_error") == "true", F.lit(False))
    status = F.when(nothing, "complete").otherwise(run_status(F.coalesce(calls, F.lit(0)), failed))
    merged = F.when(nothing, F.col("summary")).otherwise(_merged_json()(F.col("summary"), F.col("_told")))
    new = {"status": status, "summary": merged, "updated_at": F.coalesce("_at", "updated_at")}
    return joined.withColumns({k: F.when(F.col("_ended"), v).otherwise(F.col(k)) for k, v in new.items()}).select(*sessions.columns)


def store_summaries(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """sessions with summary, updated_at and status replaced where summaries (id, summary, updated_at, status) have them."""
    told = summaries.select("id", *[F.col(c).alias(f"_{c}") for c in ("summary", "updated_at", "status")], F.lit(True).alias("_told"))
    joined = sessions.join(told, "id", "left")
    return joined.withColumns({c: F.when(F.col("_told"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("summary", "updated_at", "status")}).select(*sessions.columns)


def deletable(protected: Sequence[str] = ()) -> Column:
    live = F.col("status") == "active"
    return ~(live | F.col("id").isin(*protected)) if protected else ~live


def append_records(records: DataFrame, fresh: DataFrame, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """records with fresh ones (session_id, timestamp, payload, ...) after each session's last index."""
    last = records.groupBy("session_id").agg(F.max("record_index").alias("_last"))
    numbered = fresh.join(last, "session_id", "left").withColumn("record_index", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1)
    return records.unionByName(numbered.drop("_last"), allowMissingColumns=True)


def non_partial(records: DataFrame, marker: str = "%codex_app_partial%") -> DataFrame:
    """Records without the marker, a LIKE pattern whose _ stands for any character; null payloads go as well."""
    return records.where(~F.col("payload").like(marker))
