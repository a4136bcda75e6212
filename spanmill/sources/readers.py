"""Readers: trace files in lines, arrays or compact bundles, directories of older runs, logs, and editor transcripts.

All read through Spark's file sources, so any store Spark reaches will do; files are read whole only where their form asks
for it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanmill.functions.record import dig, dicts, parse, string
from spanmill.session import JSON_BATCH_BYTES, text_batches
from spanmill.operators.blobs import TRACE_MARK, MissingBlob, marked, materialize

RECORDS = "path string, record_index long, payload string"


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, payload of the lines that hold a JSON object; blank, broken and other lines are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    return lines.where(F.trim("payload").startswith("{") & F.try_parse_json("payload").isNotNull())


def _records_of(text: str) -> list[dict]:
    """Records of a whole file: a bundle, an array, or lines."""
    whole = parse(text) if text.lstrip()[:1] in ("{", "[") else None
    head = marked(whole, TRACE_MARK)
    if head is not None:
        if dig(head, "version") != 1:
            raise ValueError(f"a bundle of version {dig(head, 'version')!r}")
        blobs = whole.get("blobs") or {}

        def load(digest: str):
            if digest not in blobs:
                raise MissingBlob(digest)
            blob = blobs[digest]
            if not isinstance(blob, dict):
                return blob
            return blob["value"] if "value" in blob else parse(blob.get("payload_json", blob.get("payload")))

        out = []
        for stored in dicts(whole.get("records")):
            try:
                out.append(materialize(stored, load))
            except MissingBlob:
                continue
        return out
    if isinstance(whole, list):
        return dicts(whole)
    return [r for line in text.splitlines() if isinstance(r := parse(line), dict)]


def read_traces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, record_index, payload of trace files of any form; a bundle of an unknown version fails the read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, i, json.dumps(r, ensure_ascii=False, separators=(",", ":"))) for p, t in zip(pdf["path"], pdf["value"]) for i, r in enumerate(_records_of(t))]
            yield pd.DataFrame(out, columns=["path", "record_index", "payload"])

    text_batches(spark, JSON_BATCH_BYTES)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, RECORDS)


def read_directory(spark: SparkSession, root: str, source_key: str, imported: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sessions, records) of a directory of older runs: <date>/trace_*.jsonl, logs beside them, and a manifest at the top.

    A run's client comes from the manifest, else from its first record; its start from its first record, else the
    manifest, else the file's time. Runs in imported (legacy_source_key, legacy_rel_path) are left out.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "trace_*.jsonl").text(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"^.*?" + re.escape(base.split("://")[-1]) + "/", "")
    rows = lines.select(rel.alias("rel_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("payload"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.where(F.trim("payload").startswith("{") & F.try_parse_json("payload").isNotNull())
    if imported is not None:
        done = imported.where(F.col("legacy_source_key") == source_key).select(F.col("legacy_rel_path").alias("rel_path")).distinct()
        rows = rows.join(done, "rel_path", "left_anti")
    records = rows.withColumn("record_index", (F.row_number().over(Window.partitionBy("rel_path").orderBy("_at")) - 1).cast("long"))
    manifest = read_manifest(spark, f"{base}/*manifest.json")
    field = lambda p: F.get_json_object("first", p)
    first = records.groupBy("rel_path").agg(F.min_by("payload", "record_index").alias("first"), F.max_by("payload", "record_index").alias("last"), F.count(F.lit(1)).alias("record_count"), F.max("modified").alias("modified"))
    parent = F.element_at(F.split("rel_path", "/"), -2)
    dated = F.when(F.contains("rel_path", F.lit("/")) & parent.rlike(r"^\d{4}-\d{2}-\d{2}$"), parent).otherwise(F.lit("legacy"))
    sessions = first.join(manifest, "rel_path", "left").select(
        F.sha2(F.concat_ws("/", F.lit(source_key), "rel_path"), 256).alias("id"), F.coalesce(field("$.timestamp"), "created_at", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("started_at"),
        F.coalesce(F.get_json_object("last", "$.timestamp"), "created_at", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated_at"), dated.alias("date_key"), F.coalesce(F.nullif("client", F.lit("")), field("$.capture.client"), F.lit("")).alias("client"),
        F.coalesce(field("$.capture.proxy_mode"), F.lit("")).alias("proxy_mode"), F.lit("complete").alias("status"), "record_count", F.lit(source_key).alias("legacy_source_key"), F.col("rel_path").alias("legacy_rel_path"),
    )
    return sessions, records.select(F.sha2(F.concat_ws("/", F.lit(source_key), "rel_path"), 256).alias("session_id"), "record_index", "payload")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """rel_path, client, created_at of the files that manifests list; back slashes become slashes. No manifest, no rows.

    A manifest is one small document, often with a hidden name, which Spark's readers pass over: it is read through the file
    system."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(path)
    files = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    texts = []
    for status in files.globStatus(glob) or ():
        stream = files.open(status.getPath())
        try:
            texts.append((jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"),))
        finally:
            stream.close()
    schema = "traces array<struct<client:string,created_at:string,metadata:struct<client:string>,files:array<string>>>"
    whole = spark.createDataFrame(texts, "value string").select(F.from_json("value", schema).alias("m"))
    traces = whole.select(F.explode("m.traces").alias("t"))
    files_ = traces.select(F.explode("t.files").alias("f"), F.coalesce("t.client", "t.metadata.client").alias("client"), F.col("t.created_at").alias("created_at"))
    return files_.select(F.translate("f", "\\", "/").alias("rel_path"), "client", "created_at").dropDuplicates(["rel_path"])


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line_no, logged_at, message of log lines that are not blank; a leading clock time is split off."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("_at")).where(F.trim("value") != "")
    numbered = lines.withColumn("line_no", F.row_number().over(Window.partitionBy("path").orderBy("_at")).cast("long"))
    stamp = F.regexp_extract("value", r"^(\d{2}:\d{2}:\d{2})\s+(.*)$", 1)
    return numbered.select("path", "line_no", stamp.alias("logged_at"), F.when(stamp != "", F.regexp_extract("value", r"^(\d{2}:\d{2}:\d{2})\s+(.*)$", 2)).otherwise(F.col("value")).alias("message"))


def _spoken(content) -> tuple[str, list[str]]:
    blocks = [{"type": "text", "text": content}] if isinstance(content, str) else dicts(content)
    text = "\n".join(re.sub(r"(?is)</?user_query>|<timestamp>.*?</timestamp>", "", string(b.get("text"))).strip() for b in blocks if b.get("type") == "text").strip()
    return text, [string(b.get("name")) for b in blocks if b.get("type") == "tool_use"]


def read_transcripts(spark: SparkSession, root: str, since: str | None = None, glob: str = "*.jsonl") -> DataFrame:
    """Steps of editor transcripts (*/agent-transcripts/*/*.jsonl): path, turn, step, role, text, tools, record_path.

    A user line begins a turn; assistant lines are its steps. Assistant lines before any user line are dropped. since (a
    time such as 2026-01-01T00:00:00) leaves older files out, glob is a pattern for their names. Folders may be named key=value, as
    Spark's writers do.
    """
    reader = spark.read
    if since:
        reader = reader.option("modifiedAfter", since)
    # Folders are listed by tasks, not one after another by the driver, as with a pattern for each level.
    found = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(f"{root.rstrip('/')}/*/agent-transcripts")
    lines = found.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "value").where(F.col("path").rlike("/agent-transcripts/[^/]+/[^/]+$"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, at, value in zip(pdf["path"], pdf["at"], pdf["value"]):
                line = parse(value)
                role = dig(line, "role")
                if role in ("user", "assistant"):
                    text, tools = _spoken(dig(line, "message", "content") if dig(line, "message", "content") is not None else dig(line, "content"))
                    out.append((path, at, role, text, tools))
            yield pd.DataFrame(out, columns=["path", "at", "role", "text", "tools"])

    said = lines.mapInPandas(run, "path string, at long, role string, text string, tools array<string>")
    w = Window.partitionBy("path").orderBy("at")
    turns = said.withColumn("turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).where("turn > 0")
    steps = turns.withColumn("step", F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(Window.partitionBy("path", "turn").orderBy("at")))
    session: Column = F.regexp_extract("path", r"agent-transcripts/(?:[^/=]+=)?([^/]+)/", 1)
    return steps.select("path", "turn", "step", "role", "text", "tools", F.concat(F.lit("/cursor/transcript/"), session, F.lit("/turn/"), F.col("turn").cast("string"), F.lit("/step/"), F.col("step").cast("string")).alias("record_path"))
