"""One Arrow pass over records: everything that listings, statistics and indexes read of a record's JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.functions import chunking, record as rec, redact
from spanmill.session import JSON_BATCH_BYTES, text_batches

DESCRIBED = (
    "session_id string, record_index long, turn long, turn_label string, timestamp string, request_id string, duration_ms long, method string, path string, host string, status long, transport string, provider string, model string, agent string, "
    "usage struct<input_tokens:long,output_tokens:long,total_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>, error string, first_user string, latest_user string, response_text string, "
    "message_count long, tool_count long, output_count long, has_system boolean, system_hint string, tool_names array<string>, prints array<string>, previous_response_id string, response_id string, thread string, snapshot_score long"
)
_NAMES = [part.split(" ")[0] for part in DESCRIBED.replace("struct<input_tokens:long,output_tokens:long,total_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>", "s").split(", ")]
_USAGE = ("input_tokens", "output_tokens", "total_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def _whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def describe(payload: str | None) -> dict:
    """The described fields of one record; an unreadable payload gives empty ones."""
    r = rec.parse(payload)
    r = r if isinstance(r, dict) else {}
    body = rec.unwrap(rec.request_body(r))
    usage = rec.usage(r)
    system, developer, _ = rec.prompts(r)
    said = rec.messages(r)
    return {
        "turn": _whole(r.get("turn")), "turn_label": str(r["turn"]) if r.get("turn") is not None else None, "timestamp": rec.string(r.get("timestamp")), "request_id": rec.string(r.get("request_id")), "duration_ms": _whole(r.get("duration_ms")),
        "method": rec.string(rec.dig(r, "request", "method")), "path": rec.path_of(r), "host": rec.host_of(r), "status": _whole(rec.dig(r, "response", "status")) or 0, "transport": rec.string(r.get("transport")), "provider": rec.provider(r), "model": rec.model(r), "agent": rec.agent(r),
        "usage": {u: _whole(usage.get(u)) for u in _USAGE}, "error": rec.error_text(r), "first_user": rec.first_user_text(body), "latest_user": rec.latest_user_text(r), "response_text": rec.record_response_text(r),
        "message_count": len(said), "tool_count": len(rec.tools(r)), "output_count": len(rec.output_blocks(r)), "has_system": bool(system or developer), "system_hint": (system or developer)[:200], "tool_names": rec.tool_names(r), "prints": [rec.fingerprint(m) for m in said],
        "previous_response_id": rec.string(body.get("previous_response_id")), "response_id": rec.string(rec.dig(r, "response", "body", "id")), "thread": rec.thread_key(r), "snapshot_score": rec.snapshot_score(r),
    }


def described(records: DataFrame) -> DataFrame:
    """records (session_id, record_index, payload) with the fields of DESCRIBED."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"session_id": s, "record_index": i, **describe(p)} for s, i, p in zip(pdf["session_id"], pdf["record_index"], pdf["payload"])]
            yield pd.DataFrame(rows, columns=_NAMES).astype({"turn": "Int64", "duration_ms": "Int64"})

    text_batches(records.sparkSession, JSON_BATCH_BYTES)
    return records.select("session_id", F.col("record_index").cast("long").alias("record_index"), "payload").mapInPandas(run, DESCRIBED)


def eventstream_rows(bodies: DataFrame, key: str = "request_id", text: str = "body") -> DataFrame:
    """Event rows (request_id, seq, event, data) of stored binary event streams, named as the messages API does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, e["event"], json.dumps(e["data"], ensure_ascii=False)) for k, t in zip(pdf["key"], pdf["body"]) for i, e in enumerate(rec.eventstream(t))]
            yield pd.DataFrame(out, columns=["request_id", "seq", "event", "data"])

    text_batches(bodies.sparkSession, JSON_BATCH_BYTES)
    return bodies.select(F.col(key).cast("string").alias("key"), F.col(text).alias("body")).mapInPandas(run, "request_id string, seq long, event string, data string")


def messages(records: DataFrame, most: int | None = chunking.MAX_CHARS) -> DataFrame:
    """The user and assistant messages of records that are worth indexing, in pieces of at most most characters; whole with None."""
    schema = "session_id string, record_index long, message_index long, model string, role string, timestamp string, content_hash string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for session, index, payload in zip(pdf["session_id"], pdf["record_index"], pdf["payload"]):
                r = rec.parse(payload)
                if not isinstance(r, dict):
                    continue
                said = rec.assistant_message(r)
                for role, texts in (("user", rec.user_messages(r)), ("assistant", [said] if said else [])):
                    parts = [p for t in texts for p in (chunking.pieces(t, most) if most else [t])]
                    out += [(session, index, n, rec.model(r), role, rec.string(r.get("timestamp")), chunking.message_hash(p), p) for n, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    text_batches(records.sparkSession, JSON_BATCH_BYTES)
    return records.select("session_id", F.col("record_index").cast("long").alias("record_index"), "payload").mapInPandas(run, schema)


def snapshots(records: DataFrame) -> DataFrame:
    """The prompt version of each session: from its record of the best score, the first among equals; sessions whose records
    show no prompt have none."""
    schema = "session_id string, provider string, model string, system_prompt string, developer_prompt string, user_prompt string, tools string, content_hash string, seen_at string"
    scored = described(records).select("session_id", "record_index", "snapshot_score").where("snapshot_score > 0")
    best = scored.groupBy("session_id").agg(F.max_by("record_index", F.struct("snapshot_score", -F.col("record_index"))).alias("record_index"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for session, payload in zip(pdf["session_id"], pdf["payload"]):
                r = rec.parse(payload) or {}
                system, developer, user = rec.prompts(r)
                tools = rec.tools(r)
                out.append((session, rec.provider(r), rec.model(r), system, developer, user, json.dumps(tools, ensure_ascii=False), chunking.version_hash(rec.agent(r), rec.model(r), system, developer, tools), rec.string(r.get("timestamp"))))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return records.join(best, ["session_id", "record_index"]).select("session_id", "payload").mapInPandas(run, schema)


def chunks(versions: DataFrame) -> DataFrame:
    """kind, title and text of the chunks of prompt versions (content_hash, system_prompt, developer_prompt, tools)."""
    schema = "snapshot string, place int, kind string, title string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, system, developer, tools in zip(pdf["content_hash"], pdf["system_prompt"], pdf["developer_prompt"], pdf["tools"]):
                out += [(h, i, *c) for i, c in enumerate(chunking.snapshot_chunks(system, developer, rec.parse(tools) or []))]
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    text_batches(versions.sparkSession, JSON_BATCH_BYTES)
    return versions.select("content_hash", "system_prompt", "developer_prompt", "tools").mapInPandas(run, schema)


def sections(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Prompt chunks of plain texts."""
    schema = "id long, place int, title string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, n, *c) for i, t in zip(pdf["id"], pdf["text"]) for n, c in enumerate(chunking.prompt_chunks(t or ""))]
            yield pd.DataFrame(out, columns=["id", "place", "title", "text"])

    text_batches(texts.sparkSession, JSON_BATCH_BYTES)
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def redact_json():
    """A function of a column: JSON (or link, or form) texts with sensitive values marked."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: redact.redact_text(v) if isinstance(v, str) else v)

    return F.pandas_udf(run, "string")


def prompt_markdown():
    """A function of the columns system, developer, user and tools (JSON text): the prompt as Markdown."""

    def run(system: pd.Series, developer: pd.Series, user: pd.Series, tools: pd.Series) -> pd.Series:
        rows = zip(system, developer, user, tools)
        return pd.Series([chunking.prompt_markdown(s or "", d or "", u or "", rec.parse(t) or []) for s, d, u, t in rows])

    return F.pandas_udf(run, "string")
