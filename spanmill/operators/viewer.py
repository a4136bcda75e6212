"""What a trace viewer asks of a run: turns, filters, search, tasks, images, and which requests are worth keeping."""

from __future__ import annotations

import gzip
import json
import re
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions import expansion, record as rec
from spanmill.functions import text as tx

#: Beginnings of paths that a capture for prompts answers itself, and that it never does.
MODEL_PATHS = ("/v1/messages", "/v1/complete", "/model/", "/v1/responses", "/responses", "/v1/chat/completions", "/chat/completions", "/v1/completions", "/completions", "/v1/models", "/models", "/v1beta/models", "/v1alpha/models")
OTHER_PATHS = ("/v1/embeddings", "/embeddings", "/v1/files", "/files")
PROMPT_KEYS = ("system", "messages", "instructions", "input", "contents", "system_instruction")
ARCHIVES = (".tgz", ".tar.gz", ".zip", ".whl")
#: What in a system text names a task, first match wins.
TASKS = (("you are opencode", "OpenCode"), ("you are hermes", "Hermes"), ("you are codex", "Codex"), ("operating inside pi", "Pi"), ("pi, a coding agent harness", "Pi"), ("claude code", "Claude Code"), ("claude agent", "Claude Agent"), ("openclaw", "OpenClaw"), ("subagent", "Subagent"), ("sub-agent", "Subagent"), ("bash", "Bash"), ("explore", "Explore"), ("plan", "Plan"))


def turns(records: DataFrame) -> DataFrame:
    """session_id, turn_index, payload: records as single turns with their history. A run is taken in order and so held whole."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = expansion.expand(pdf.sort_values("record_index")["payload"])
        return pd.DataFrame({"session_id": [pdf["session_id"].iloc[0]] * len(out), "turn_index": range(len(out)), "payload": out})

    return records.select("session_id", "record_index", "payload").groupBy("session_id").applyInPandas(run, "session_id string, turn_index long, payload string")


def is_main_turn() -> Column:
    """A turn with a system text or more than one message (columns of functions.records)."""
    return F.col("has_system") | (F.col("message_count") > 1)


def is_title_request(system: Column) -> Column:
    return F.coalesce(system.rlike("(?i)generate a concise") & system.rlike(r'(?i)single\s+"title"\s+field'), F.lit(False))


def is_display_turn(path: Column, prefetch: Column = None) -> Column:
    """Paths that make a numbered turn: model calls, without token counts and model lists."""
    bare = tx.path_only(path)
    model = path.rlike(r"^/model/.*/(invoke|invoke-with-response-stream)$")
    wanted = bare.contains("/responses") | model | bare.rlike("^(/v1/messages|/v1/chat/completions|/chat/completions|/v1/completions|/completions)") | F.lower(bare).contains("generatecontent")
    out = wanted & ~bare.contains("/count_tokens") & ~bare.endswith("/models")
    return F.coalesce(out if prefetch is None else out & ~prefetch, F.lit(False))


def search_text(described: DataFrame) -> Column:
    """Everything of a record that a search looks through, in lower case (needs payload)."""
    return F.lower(F.concat_ws("\n", "model", "system_hint", "latest_user", "response_text", F.array_join("tool_names", " "), "payload"))


def filter_records(described: DataFrame, paths: Sequence[str] = (), search: str = "", tools: Sequence[str] = ()) -> DataFrame:
    """Records of some paths that contain a text (in any spelling of key:value) and call one of some tools, in order of turns."""
    out = described
    if paths:
        out = out.where(tx.path_only(F.col("path")).isin(*paths))
    if search:
        hay, hit = search_text(out), F.lit(False)
        for v in tx.query_variants(search):
            hit = hit | F.contains(hay, F.lit(v.lower()))
        out = out.where(hit)
    if tools:
        out = out.where(F.arrays_overlap("tool_names", F.array(*[F.lit(t) for t in tools])))
    return out.orderBy(tx.dotted_key(F.coalesce("turn_label", F.lit("0"))), "turn_label", "record_index")


def distinct_tools(described: DataFrame) -> DataFrame:
    return described.select(F.explode("tool_names").alias("tool")).distinct().orderBy("tool")


def sidebar(described: DataFrame) -> DataFrame:
    """The row that a list shows of each record."""
    return described.select("session_id", "record_index", "turn_label", "timestamp", "request_id", "model", "provider", "method", "path", "status", "duration_ms", "usage.*", "message_count", "tool_count", "output_count", "has_system", "system_hint", "tool_names", tx.preview(F.col("latest_user"), 56).alias("user_hint"), (F.col("error") != "").alias("failed"), stable_key().alias("key"))


def stable_key() -> Column:
    """A key that a record keeps across reloads."""
    return F.concat_ws("|", F.nullif("request_id", F.lit("")), F.coalesce(F.col("record_index").cast("string"), F.col("turn_label")))


def task_of(system: str, tools: Sequence[str]) -> tuple[str, str]:
    """Fingerprint and label of what a request is for."""
    low = system.lower()
    label = "simple" if not system and not tools else next((name for part, name in TASKS if part in low), "")
    if not label:
        line = next((x.strip() for x in system.split("\n") if x.strip() and not x.strip().lower().startswith("x-anthropic-billing-header:")), "")
        label = line[:20].strip() or f"{len(tools)} tools"
    return f"{system}|{','.join(sorted(tools))}", label


def tasks(records: DataFrame) -> DataFrame:
    """session_id, record_index, task (a hash of the fingerprint), label."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for session, index, payload in zip(pdf["session_id"], pdf["record_index"], pdf["payload"]):
                r = rec.parse(payload)
                r = r if isinstance(r, dict) else {}
                system, developer, _ = rec.prompts(r)
                print_, label = task_of(system or developer, [t["name"] for t in rec.tools(r)])
                out.append((session, index, hashlib.sha256(print_.encode("utf-8", "surrogatepass")).hexdigest(), label))
            yield pd.DataFrame(out, columns=["session_id", "record_index", "task", "label"])

    return records.select("session_id", F.col("record_index").cast("long").alias("record_index"), "payload").mapInPandas(run, "session_id string, record_index long, task string, label string")


def image_registry(records: DataFrame) -> DataFrame:
    """session_id, prompt, images: images that users sent, by the text they came with; an image (by its first 128 characters
    and its length) is listed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for session, index, payload in zip(pdf["session_id"], pdf["record_index"], pdf["payload"]):
                r = rec.parse(payload)
                for m in rec.messages(r) if isinstance(r, dict) else ():
                    if m.get("role") == "user":
                        prompt = re.sub(r"\s+", " ", rec.clean_content(m.get("content"), viewer=True)).strip()
                        out += [(session, index, prompt, image) for image in rec.images(m.get("content"))]
            yield pd.DataFrame(out, columns=["session_id", "record_index", "prompt", "image"])

    found = records.select("session_id", F.col("record_index").cast("long").alias("record_index"), "payload").mapInPandas(run, "session_id string, record_index long, prompt string, image string")
    once = found.groupBy("session_id", "prompt", F.substring("image", 1, 128).alias("_a"), F.length("image").alias("_b")).agg(F.min(F.struct("record_index", "image")).alias("_i"))
    return once.groupBy("session_id", "prompt").agg(F.transform(F.array_sort(F.collect_list("_i")), lambda x: x["image"]).alias("images"))


def stub(metadata: DataFrame) -> DataFrame:
    """Listing rows with whether cached tokens are part of the input, told from the model's name where the row does not say."""
    name = F.lower(F.coalesce("model", F.lit("")))
    claude = name.contains("claude") | (F.coalesce("cache_creation_input_tokens", F.lit(0)) > 0)
    return metadata.withColumn("cache_inside", ~claude)


def allowed_path(path: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return F.coalesce(out, F.lit(False))


def under(path: Column, prefixes: Sequence[str]) -> Column:
    """Whether a path is one of prefixes or lies below one, a colon counting as a slash."""
    bare = F.regexp_replace(F.substring_index(path, "?", 1), "/+$", "")
    return F.coalesce(bare.rlike("^(" + "|".join(re.escape(p) for p in prefixes) + ")([/:].*)?$"), F.lit(False)) if prefixes else F.lit(False)


def skip_record(host: Column, path: Column, media_type: Column, user_agent: Column, method: Column, hosts: Sequence[str] = (), prefixes: Sequence[str] = (), managers: Sequence[str] = ("npm/", "pip/", "yarn/", "pnpm/", "uv/", "cargo/")) -> Column:
    """Requests that are passed on without being recorded: some hosts and paths, archives, and package managers' metadata."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(media_type, F.lit("")), ";", 1)))
    low = F.lower(F.substring_index(F.coalesce(path, F.lit("/")), "?", 1))
    archive = low.rlike("(" + "|".join(re.escape(a) for a in ARCHIVES) + ")$")
    binary = kind.isin("application/octet-stream", "application/gzip", "application/x-gzip", "application/x-tar", "application/zip")
    manager = tx.contains_any(user_agent, managers) & F.upper(method).isin("GET", "HEAD") & kind.isin("application/json", "application/vnd.npm.install-v1+json", "text/html")
    skip_host = F.lower(host).isin(*hosts) if hosts else F.lit(False)
    return F.coalesce(skip_host | under(low, prefixes) | F.when(archive, binary).otherwise(manager), F.lit(False))


def capture_only(path: Column, body: Column) -> Column:
    """Requests that a capture for prompts answers itself: model paths, or bodies with a prompt."""
    bare = F.substring_index(F.coalesce(path, F.lit("")), "?", 1)
    prompt, nested = F.lit(False), F.lit(False)
    for k in PROMPT_KEYS:
        prompt = prompt | F.get_json_object(body, f"$.{k}").isNotNull()
        nested = nested | F.get_json_object(body, f"$.request.{k}").isNotNull()
    internal = bare.rlike("^/v1internal[:/]")
    vertex = bare.rlike(r"/publishers/anthropic/models/[^/]+:(rawPredict|streamRawPredict)$")
    return F.when(allowed_path(bare, OTHER_PATHS), False).when(vertex | allowed_path(bare, MODEL_PATHS), True).when(internal, F.lower(bare).contains("generatecontent")).otherwise(prompt | nested)


def prompt_bearing(body: Column) -> Column:
    """Bodies of socket requests (JSON text, at most one level inside a request field) that hold a prompt: a prompt field that is
    not empty, a text as input, or an input item that is no call's result. False for what is no JSON object."""
    value = F.try_parse_json(body)

    def given(path: str) -> Column:
        kind, text = F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.try_variant_get(value, path, "string")
        return F.when(kind == "STRING", text != "").otherwise(~text.isin("[]", "{}", "false", "0"))

    def says(item: Column) -> Column:
        part = lambda path: F.try_variant_get(item, path, "string")
        held = [F.schema_of_variant(F.try_variant_get(item, f"$.{k}", "variant")).isNotNull() for k in ("content", "text", "input_text")]
        told = part("$.role").isin("user", "developer", "system") | held[0] | held[1] | held[2]
        no_result = F.coalesce(part("$.type") != "function_call_output", F.lit(True))
        return F.coalesce(F.when(F.schema_of_variant(item) == "STRING", part("$").rlike(r"\S")).otherwise(told & no_result), F.lit(False))

    def bears(at: str) -> Column:
        fields = ("system", "instructions", "system_instruction", "systemInstruction", "messages", "contents", "prompt")
        asked = F.try_variant_get(value, f"{at}.input", "variant")
        whole = (F.schema_of_variant(asked) == "STRING") & F.try_variant_get(asked, "$", "string").rlike(r"\S")
        items = F.exists(F.try_variant_get(value, f"{at}.input", "array<variant>"), says)
        return F.coalesce(F.greatest(*[F.coalesce(c, F.lit(False)) for c in (*[given(f"{at}.{k}") for k in fields], whole, items)]), F.lit(False))

    return F.coalesce(capture_only(F.lit(""), body) & (bears("$") | bears("$.request")), F.lit(False))


def continues(body: Column) -> Column:
    """The five fields of a request that goes on from a response without a user's message, null for others."""
    fields = {k: F.get_json_object(body, f"$.{k}") for k in ("previous_response_id", "prompt_cache_key", "model", "store", "instructions")}
    asked = F.coalesce(F.get_json_object(body, "$.input").rlike(r'"role"\s*:\s*"user"'), F.lit(False))
    return F.when((F.coalesce(fields["previous_response_id"], F.lit("")) != "") & ~asked, F.struct(*[c.alias(k) for k, c in fields.items()]))


def unpack(body: bytes | None, encoding: str | None) -> bytes | None:
    """A body without its content encoding; one that cannot be unpacked stays as it is."""
    kind = (encoding or "").strip().lower()
    try:
        if body is None or kind in ("", "identity"):
            return body
        if kind == "gzip":
            return gzip.decompress(body)
        if kind == "deflate":
            return zlib.decompress(body)
        if kind == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    except Exception:  # noqa: BLE001  decoders raise many kinds
        pass
    return body


def unpack_bodies():
    """A function of the columns body and encoding."""

    def run(body: pd.Series, encoding: pd.Series) -> pd.Series:
        return pd.Series([unpack(bytes(b) if b is not None else None, e if isinstance(e, str) else None) for b, e in zip(body, encoding)])

    return F.pandas_udf(run, "binary")


def read_body(raw: bytes | str | None):
    """A request body: JSON, JSON in a JSON string if an object is inside, else text."""
    text = raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw or ""
    try:
        value = json.loads(text)
    except ValueError:
        return text
    inner = rec.parse(value) if isinstance(value, str) else None
    return inner if isinstance(inner, dict) else value


def turn_numbers(records: DataFrame) -> DataFrame:
    """records with number: their place in their run, from 1."""
    return records.withColumn("number", F.row_number().over(Window.partitionBy("session_id").orderBy("record_index")))
