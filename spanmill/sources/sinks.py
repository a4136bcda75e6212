"""Sinks: records as lines, compact bundles, Markdown and JSON documents, and logs."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanmill.functions import record as rec
from spanmill.operators.blobs import OWN, compact
from spanmill.session import JSON_BATCH_BYTES, text_batches

FORMATS = ("compact", "jsonl", "json", "markdown", "logs")
#: Characters of a user's text, an answer and a tool's input that a Markdown export shows.
SHOWN_USER, SHOWN_ANSWER, SHOWN_TOOL = 3000, 5000, 2000


def as_jsonl(records: DataFrame) -> DataFrame:
    """A line for each record, its JSON as it was captured, in order."""
    return records.orderBy("session_id", "record_index").select(F.col("payload").alias("value"))


def _ordered(held: list[tuple], by_turn: bool) -> list[dict]:
    rows = [(i, rec.parse(p)) for i, p in held]
    rows = [(i, r) for i, r in rows if isinstance(r, dict)]
    turn = lambda r: r["turn"] if isinstance(r.get("turn"), int) else 0
    return [r for _, r in sorted(rows, key=lambda x: (turn(x[1]) if by_turn else 0, x[0]))]


def _per_session(records: DataFrame, build, by_turn: bool = True) -> DataFrame:
    """session_id, value: build(records of the session). A session is one document and so is held whole; partitions are sorted by
    session, so a task holds one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((s, i, p) for pdf in batches for s, i, p in zip(pdf["session_id"], pdf["record_index"], pdf["payload"]))
        for session, group in groupby(rows, key=lambda row: row[0]):
            yield pd.DataFrame({"session_id": [session], "value": [build(_ordered([row[1:] for row in group], by_turn))]})

    text_batches(records.sparkSession, JSON_BATCH_BYTES)
    placed = records.select("session_id", "record_index", "payload").repartition("session_id").sortWithinPartitions("session_id")
    return placed.mapInPandas(run, "session_id string, value string")


def compact_bundle(records: list[dict]) -> str:
    blobs: dict[str, dict] = {}
    packed = [compact(r, lambda h, text, n: blobs.setdefault(h, {"kind": "json", "bytes": n, "value": rec.parse(text)})) for r in records]
    head = {"version": 1, "record_count": len(packed), "blob_count": len(blobs)}
    return json.dumps({OWN + "compact_trace__": head, "records": packed, "blobs": blobs}, ensure_ascii=False, separators=(",", ":"))


def as_compact(records: DataFrame) -> DataFrame:
    """A bundle for each session, every large value once."""
    return _per_session(records, compact_bundle, by_turn=False)


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "\n... (truncated)"


def markdown_document(records: list[dict]) -> str:
    usages = [rec.usage(r) for r in records]
    total = lambda k: sum(u[k] for u in usages if isinstance(u.get(k), int))
    models = sorted({m for r in records if (m := rec.model(r))})
    out = ["# Trace", "", f"- Turns: {len(records)}", f"- Models: {', '.join(models) or 'unknown'}", f"- Input tokens: {total('input_tokens')}", f"- Output tokens: {total('output_tokens')}", f"- Cached tokens: {total('cache_read_input_tokens')}"]
    for n, r in enumerate(records, 1):
        out += ["", f"## Turn {r.get('turn', n)}", "", f"{rec.model(r) or 'unknown'} · {rec.string(r.get('timestamp'))}"]
        for title, text, most in (("User", rec.latest_user_text(r), SHOWN_USER), ("Assistant", rec.record_response_text(r), SHOWN_ANSWER)):
            out += ["", f"### {title}", "", _cut(text, most)] if text else []
        for b in rec.output_blocks(r):
            if b.get("type") == "tool_use":
                out += ["", f"### Tool: {b.get('name')}", "", "```json", _cut(json.dumps(b.get("input"), ensure_ascii=False, indent=2), SHOWN_TOOL), "```"]
        if rec.error_text(r):
            out += ["", f"> Error: {rec.error_text(r)}"]
    return "\n".join(out) + "\n"


def json_document(records: list[dict]) -> str:
    turns = []
    for n, r in enumerate(records, 1):
        system, developer, _ = rec.prompts(r)
        turn = {"turn": r.get("turn", n), "timestamp": r.get("timestamp"), "model": rec.model(r), "messages": rec.messages(r), "response": rec.output_blocks(r), "usage": rec.usage(r)}
        turn |= {k: v for k, v in (("system", system or developer), ("tools", rec.tools(r)), ("error", rec.error_text(r))) if v}
        turns.append(turn)
    return json.dumps(turns, ensure_ascii=False, indent=2)


def as_markdown(records: DataFrame) -> DataFrame:
    return _per_session(records, markdown_document)


def as_json(records: DataFrame) -> DataFrame:
    return _per_session(records, json_document)


def as_logs(logs: DataFrame) -> DataFrame:
    """'time message' lines, or the message alone, in order."""
    stamp = F.coalesce("logged_at", F.lit(""))
    return logs.orderBy("session_id", "line_no").select(F.when(stamp != "", F.concat_ws(" ", stamp, F.coalesce("message", F.lit("")))).otherwise(F.coalesce("message", F.lit(""))).alias("value"))


def export(records: DataFrame, form: str | None = None, path: str | None = None) -> DataFrame:
    """records in a form, given or told from the path's ending; compact by default. With a path, it is written as text."""
    suffix = {"jsonl": "jsonl", "json": "json", "md": "markdown", "log": "logs"}.get((path or "").rsplit(".", 1)[-1])
    form = form or suffix or "compact"
    if form not in FORMATS:
        raise ValueError(f"unknown form {form!r}")
    out = {"compact": as_compact, "jsonl": as_jsonl, "json": as_json, "markdown": as_markdown, "logs": as_logs}[form](records)
    if path:
        out.select("value").write.mode("overwrite").text(path)
    return out


def write_sessions(sessions: DataFrame, path: str) -> None:
    """Sessions by day, so that a date filter reads its own folder only."""
    sessions.write.mode("append").partitionBy("date_key").parquet(path)


def blob_totals(blobs: DataFrame) -> DataFrame:
    return blobs.groupBy("session_id").agg(F.count(F.lit(1)).alias("blobs"), F.sum("size_bytes").alias("bytes"))


def log_lines(logs: DataFrame, fresh: DataFrame) -> DataFrame:
    """logs with fresh lines (session_id, logged_at, level, message) after each session's last."""
    last = logs.groupBy("session_id").agg(F.max("line_no").alias("_last"))
    w = Window.partitionBy("session_id").orderBy("logged_at", "message")
    numbered = fresh.join(last, "session_id", "left").withColumn("line_no", F.coalesce("_last", F.lit(0)) + F.row_number().over(w))
    return logs.unionByName(numbered.drop("_last"), allowMissingColumns=True)


class LogRows(logging.Handler):
    """Keeps what a program logs as log rows of a session, until drain() makes a table of them; the oldest go beyond a bound."""

    def __init__(self, session_id: str, most: int = 10_000):
        super().__init__()
        self.session_id, self.most, self.rows = session_id, most, []

    def emit(self, record: logging.LogRecord) -> None:
        at = time.strftime("%H:%M:%S", time.gmtime(record.created))
        self.rows.append((self.session_id, at, record.levelname, self.format(record)))
        del self.rows[: -self.most]

    def drain(self, spark: SparkSession) -> DataFrame:
        rows, self.rows = self.rows, []
        return spark.createDataFrame(rows, "session_id string, logged_at string, level string, message string")
