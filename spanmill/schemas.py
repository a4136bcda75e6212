"""Schemas of the trace tables."""

from __future__ import annotations

from pyspark.sql import types as T



#: Sessions: one row per recorded run; ``summary`` is JSON text in either of two shapes, see operators.sessions.
SESSIONS = "id string, started_at string, updated_at string, date_key string, client string, proxy_mode string, status string, record_count long, summary string, legacy_source_key string, legacy_rel_path string, cwd string"
RECORDS = "session_id string, record_index long, turn long, timestamp string, payload string"
LOGS = "session_id string, line_no long, logged_at string, level string, message string"
BLOBS = "session_id string, hash string, kind string, payload string, size_bytes long"
MESSAGES = "session_id string, record_index long, message_index long, client string, model string, role string, timestamp string, content_hash string, text string"
SNAPSHOTS = "content_hash string, client string, provider string, model string, system_prompt string, developer_prompt string, tools string, first_seen string, last_seen string, session_count long"
CHUNKS = "id long, snapshot string, kind string, title string, text string, state string, attempts int"
USAGE_KEYS = ("input_tokens", "output_tokens", "total_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def schema(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)
