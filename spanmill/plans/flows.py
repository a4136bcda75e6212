"""Queries that go through files, streams and sockets: what is written, streamed or sent is read back and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions import records as rc
from spanmill.operators import knowledge as kb, viewer as vw
from spanmill.plans import catalogue as ct, tables as tb, traffic as tr
from spanmill.plans.catalogue import query
from spanmill.session import cut, shared_dir, table
from spanmill.sources import readers, sockets
from spanmill.streaming import jobs


def _files(spark):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path, path(shared_dir(spark)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _place(spark, rows: DataFrame, key: str, target) -> str:
    """Rows (key, value), in order, the rows of a key in one partition, as one text file for each key at target(root, key); the root."""
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    rows.select(key, "value").write.partitionBy(key).text(f"{root}-parts")
    path, files = _files(spark)
    for folder in files.listStatus(path(f"{root}-parts")):
        name = folder.getPath().getName()
        if "=" in name:
            part = next(f.getPath() for f in files.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            to = path(target(root, name.split("=", 1)[1]))
            files.mkdirs(to.getParent())
            files.rename(part, to)
    files.delete(path(f"{root}-parts"), True)
    return root


# Directories of older runs, and transcripts


@query(f"WITH {ct.S}, f AS (SELECT strftime(ts, '%Y-%m-%d') AS date, ts, event_id, event_type FROM e), g AS (SELECT date, count(*) AS record_count, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(event_type, (ts, event_id)) AS client FROM f GROUP BY 1) SELECT date || '/trace_0.jsonl' AS rel_path, date AS date_key, record_count, strftime(first_ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS started_at, strftime(last_ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS updated_at, CASE WHEN date = '2024-01-02' THEN 'listed' ELSE client END AS client FROM g WHERE date <> '2024-01-03'")
def legacy_sessions(spark, sf_dir):
    return _legacy(spark, sf_dir)[0].select(F.col("legacy_rel_path").alias("rel_path"), "date_key", "record_count", "started_at", "updated_at", "client")


@query(f"WITH {ct.S}, f AS (SELECT strftime(ts, '%Y-%m-%d') AS date, ts, event_id, event_type FROM e) SELECT date, row_number() OVER (PARTITION BY date ORDER BY ts, event_id) - 1 AS record_index, event_type FROM f WHERE date <> '2024-01-03'")
def legacy_records(spark, sf_dir):
    sessions, records = _legacy(spark, sf_dir)
    joined = records.join(sessions.select(F.col("id").alias("session_id"), "date_key"), "session_id")
    return joined.select(F.col("date_key").alias("date"), "record_index", F.get_json_object("payload", "$.capture.client").alias("event_type"))


def _legacy(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Events as a directory of daily runs with a manifest; one day has been imported before."""
    e = tb.events(spark, sf_dir)
    line = F.to_json(F.struct(tb.iso(F.col("ts")).alias("timestamp"), F.struct(F.col("event_type").alias("client")).alias("capture")))
    rows = e.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "ts", "event_id", line.alias("value")).repartition("date").sortWithinPartitions("date", "ts", "event_id")
    root = _place(spark, rows, "date", lambda r, date: f"{r}/{date}/trace_0.jsonl")
    manifest = '{"traces":[{"client":"listed","created_at":"2020-01-01T00:00:00Z","files":["2024-01-02\\\\trace_0.jsonl"]}]}'
    held = _place(spark, spark.createDataFrame([("m", manifest)], "k string, value string"), "k", lambda r, k: f"{r}/manifest.json")
    path, files = _files(spark)
    files.rename(path(f"{held}/manifest.json"), path(f"{root}/.manifest.json"))
    done = spark.createDataFrame([("old", "2024-01-03/trace_0.jsonl"), ("other", "2024-01-02/trace_0.jsonl")], "legacy_source_key string, legacy_rel_path string")
    return readers.read_directory(spark, root, "old", done)


@query("WITH t AS (SELECT conv_id, turn AS pos, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn FROM conversations WHERE role <> 'system'), s AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS step FROM t WHERE turn > 0) SELECT CAST(turn AS BIGINT) AS turn, CAST(step AS BIGINT) AS step, role, text, '/cursor/transcript/c' || conv_id || '/turn/' || CAST(turn AS BIGINT) || '/step/' || CAST(step AS BIGINT) AS record_path FROM s")
def transcript_steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct("role", F.struct(F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("<user_query>"), "text", F.lit("</user_query>")).alias("text"))).alias("content")).alias("message")))
    rows = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conv"), "turn", line.alias("value")).repartition("conv").sortWithinPartitions("conv", "turn").select("conv", "value")
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"  # a file a conversation, written by the tasks
    rows.write.partitionBy("conv").text(f"{root}/project/agent-transcripts")
    return readers.read_transcripts(spark, root, glob="*.txt").select("turn", "step", "role", "text", "record_path")


# Sockets: several responses in a record, each with its history


@query(f"WITH {tr.TRAFFIC}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS of FROM p) SELECT session_id, n - 1 AS turn_index, prior AS messages, coalesce(latest_user, '') AS latest_user, answer AS response_text, CASE WHEN of > 1 THEN '1.' || n ELSE '1' END AS turn_label, CASE WHEN of > 1 THEN 'ws' || conv_id || ':' || n ELSE 'ws' || conv_id END AS request_id FROM k")
def socket_turns(spark, sf_dir):
    """A conversation over one socket, with a request that generates nothing before it, as turns with their whole history."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    answers = F.filter("m", lambda x: x["role"] == "assistant")
    before = lambda a: F.coalesce(F.array_max(F.transform(F.filter("m", lambda x: (x["role"] == "assistant") & (x["turn"] < a["turn"])), lambda x: x["turn"])), F.lit(-1))
    ident = lambda turn: F.concat(F.lit("r"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    previous = lambda a: F.when(before(a) >= 0, ident(before(a)))
    asked = lambda a: F.to_json(F.struct(F.lit("response.create").alias("type"), F.lit("o").alias("model"), previous(a).alias("previous_response_id"), F.transform(F.filter("m", lambda x: (x["role"] == "user") & (x["turn"] < a["turn"]) & (x["turn"] > before(a))), lambda x: F.struct(F.lit("message").alias("type"), x["role"].alias("role"), x["text"].alias("content"))).alias("input")))
    head = lambda a: F.struct(ident(a["turn"]).alias("id"), previous(a).alias("previous_response_id"), F.array().cast("array<string>").alias("output"))
    item = lambda a: F.struct(F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.array(F.struct(F.lit("output_text").alias("type"), a["text"].alias("text"))).alias("content"))
    told = lambda a: F.concat_ws(",", F.to_json(F.struct(F.lit("response.created").alias("type"), head(a).alias("response"))), F.to_json(F.struct(F.lit("response.output_item.done").alias("type"), F.lit(0).alias("output_index"), item(a).alias("item"))), F.to_json(F.struct(F.lit("response.completed").alias("type"), head(a).alias("response"))))
    idle = '{"type":"response.create","model":"o","generate":false,"input":[]}'
    requests = F.concat(F.lit("[" + idle + ","), F.array_join(F.transform(answers, asked), ","), F.lit("]"))
    responses = F.concat(F.lit("["), F.array_join(F.transform(answers, told), ","), F.lit("]"))
    payload = F.concat(F.lit('{"turn":1,"request_id":"ws'), F.col("conv_id").cast("string"), F.lit('","transport":"websocket","request":{"path":"/v1/responses","ws_events":'), requests, F.lit('},"response":{"status":101,"ws_events":'), responses, F.lit("}}"))
    records = whole.where(F.size(answers) > 0).select(F.col("conv_id").cast("string").alias("session_id"), F.lit(0).cast("long").alias("record_index"), payload.alias("payload"))
    turns = vw.turns(records)
    d = rc.described(turns.withColumnRenamed("turn_index", "record_index"))
    return d.select("session_id", F.col("record_index").alias("turn_index"), F.col("message_count").alias("messages"), "latest_user", "response_text", "turn_label", "request_id")


@query(f"WITH {tr.TRAFFIC} SELECT session_id, record_index, 2 * prior - users AS messages, answer AS response_text FROM p WHERE d = 2")
def chained_turns(spark, sf_dir):
    """Requests that send only what is new and go on from the response before: with the history put back, in which each answer is a text
    and a call."""
    r = tr.traffic(spark, sf_dir).where("dialect = 'responses'")
    body = F.from_json(F.get_json_object("payload", "$.request.body.input"), "array<struct<type:string,role:string,content:array<struct<type:string,text:string>>>>")
    at = F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), F.size("_all")), lambda i: F.when(F.element_at("_all", i)["role"] == "assistant", i))), F.lit(0))
    slim = r.withColumn("_all", body).withColumn("_new", F.when(F.size("_all") > 0, F.slice("_all", at + 1, F.greatest(F.size("_all") - at, F.lit(0)))).otherwise(F.col("_all")))
    request = F.struct(F.lit("/v1/responses").alias("path"), F.struct(F.get_json_object("payload", "$.request.body.previous_response_id").alias("previous_response_id"), F.col("_new").alias("input")).alias("body"))
    payload = F.concat(F.lit('{"turn":'), F.col("record_index").cast("string"), F.lit(',"request":'), F.to_json(request), F.lit(',"response":'), F.get_json_object("payload", "$.response"), F.lit("}"))
    d = rc.described(vw.turns(slim.select("session_id", "record_index", payload.alias("payload"))).withColumnRenamed("turn_index", "record_index"))
    return d.select("session_id", F.col("turn").alias("record_index"), F.col("message_count").alias("messages"), "response_text")


# Sockets as captured: frames cut at any byte

FRAMES_SQL = """
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
    coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)
      OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
  FROM conversations WHERE role <> 'system'
)
SELECT CAST(conv_id AS VARCHAR) AS connection, CAST(part + 1 AS BIGINT) AS number,
  count(*) FILTER (role <> 'assistant') AS asked_messages, 3 * count(*) FILTER (role = 'assistant') AS told_messages,
  coalesce(string_agg(text, '|' ORDER BY turn) FILTER (role <> 'assistant'), '') AS asked,
  max('r' || conv_id || '-' || turn) FILTER (role = 'assistant') AS response_id,
  max(text) FILTER (role = 'assistant') AS answer
FROM c GROUP BY conv_id, part
"""


def _frames(spark, sf_dir) -> DataFrame:
    """Conversations as frames of 37 bytes at most, with a ping after each; some responses are ended twice."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    ident = F.concat(F.lit("r"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    said = F.coalesce("text", F.lit(""))
    question = F.struct(F.lit("response.create").alias("type"), F.array(F.struct(F.lit("user").alias("role"), said.alias("content"))).alias("input"))
    part = F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), said.alias("text"))).alias("content"))
    created = F.struct(F.lit("response.created").alias("type"), F.struct(ident.alias("id")).alias("response"))
    item = F.struct(F.lit("response.output_item.done").alias("type"), F.lit(0).alias("output_index"), part.alias("item"))
    done = F.struct(F.lit("response.completed").alias("type"), F.struct(ident.alias("id"), F.array(part).alias("output")).alias("response"))
    answers = F.array(F.to_json(created), F.to_json(item), F.to_json(done))
    again = F.when(F.col("turn") % 4 == 3, F.array(F.to_json(done))).otherwise(F.array().cast("array<string>"))
    texts = F.when(F.col("role") == "assistant", F.concat(answers, again)).otherwise(F.array(F.to_json(question)))
    sender = F.when(F.col("role") == "assistant", "server").otherwise("client")
    told = c.select(F.col("conv_id").cast("string").alias("connection"), "turn", sender.alias("sender"), F.posexplode(texts).alias("place", "text"))
    cuts = F.sequence(F.lit(1), F.greatest(F.octet_length("text"), F.lit(1)), F.lit(37))
    pieces = told.select("connection", "turn", "sender", "place", F.encode("text", "UTF-8").alias("bytes"), F.posexplode(cuts).alias("at_piece", "start"))
    last = F.col("start") + 37 > F.octet_length("bytes")
    data = F.struct(F.when(F.col("at_piece") == 0, 1).otherwise(0).alias("opcode"), last.alias("fin"), F.substring("bytes", F.col("start"), F.lit(37)).alias("data"))
    ping = F.struct(F.lit(9).alias("opcode"), F.lit(True).alias("fin"), F.encode(F.lit("ping"), "UTF-8").alias("data"))
    both = pieces.select("connection", "turn", "sender", "place", "at_piece", F.posexplode(F.array(data, ping)).alias("kind", "f"))
    seq = F.row_number().over(Window.partitionBy("connection").orderBy("turn", "place", "at_piece", "kind")).cast("long")
    rows = both.withColumn("seq", seq)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn"))
    return rows.select("connection", "seq", at.alias("at"), "sender", "f.opcode", "f.fin", "f.data")


def _read_frames(records: DataFrame) -> DataFrame:
    event = "struct<input:array<struct<content:string>>>"
    answer = "struct<id:string,output:array<struct<content:array<struct<text:string>>>>>"
    read = F.from_json("payload", f"request struct<ws_events:array<{event}>>, response struct<body:{answer},ws_events:array<struct<type:string>>>")
    r = records.select("connection", "number", read.alias("r"))
    asked = F.array_join(F.flatten(F.transform("r.request.ws_events", lambda e: e["input"]["content"])), "|")
    text = F.get(F.get(F.col("r.response.body.output"), F.lit(0))["content"], F.lit(0))["text"]
    return r.select("connection", "number", F.size("r.request.ws_events").cast("long").alias("asked_messages"), F.size("r.response.ws_events").cast("long").alias("told_messages"), asked.alias("asked"), F.col("r.response.body.id").alias("response_id"), text.alias("answer"))


@query(FRAMES_SQL)
def socket_frames(spark, sf_dir):
    """Frames to messages to records, in one batch."""
    return _read_frames(sockets.records(_frames(spark, sf_dir)))


@query(FRAMES_SQL)
def socket_frame_stream(spark, sf_dir):
    """The same frames in files of a growing log, so that messages and responses lie across batches; then each is closed."""
    frames = cut(_frames(spark, sf_dir))
    ends = frames.groupBy("connection").agg(F.max("seq").alias("seq"), F.max("at").alias("at"))
    close = ends.select("connection", F.col("seq") + 1, "at", F.lit("client"), F.lit(8), F.lit(True), F.encode(F.lit(""), "UTF-8"))
    folder = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    log, out, marks = (f"{folder}/{name}" for name in ("log", "records", "marks"))
    steps = (frames.where("seq <= 10"), frames.where("seq > 10 AND seq <= 45"), frames.where("seq > 45").union(close))
    for more in steps:
        more.write.mode("append").parquet(log)
        stream = sockets.record_stream(spark.readStream.schema(frames.schema).parquet(log))
        stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()
    return _read_frames(spark.read.parquet(out))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn,
  CASE turn % 6 WHEN 1 THEN false WHEN 3 THEN false ELSE regexp_matches(coalesce(text, ''), '\\S') END AS bearing
FROM conversations
""")
def prompt_bearing_requests(spark, sf_dir):
    """Which requests of a socket hold a prompt, in six shapes."""
    said = F.coalesce("text", F.lit(""))
    shapes = [
        F.struct(F.array(F.when(said.rlike(r"\S"), F.struct(F.lit("user").alias("role"), said.alias("content"))).otherwise(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content")))).alias("input")),
        F.struct(F.array(F.struct(F.lit("function_call_output").alias("type"), said.alias("text"))).alias("input")),
        F.struct(said.alias("input")),
        F.struct(F.array().cast("array<string>").alias("messages"), F.lit("m").alias("model")),
        F.struct(F.struct(F.array(said).alias("input")).alias("request")),
        F.struct(F.trim(F.regexp_replace(said, r"^\s+$", "")).alias("instructions"), F.array().cast("array<string>").alias("input")),
    ]
    body = F.lit(None).cast("string")
    for n, shape in enumerate(shapes):
        body = F.when(F.col("turn") % 6 == n, F.to_json(shape)).otherwise(body)
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), "turn", vw.prompt_bearing(body).alias("bearing"))


# Streams


def _stream_of(spark, rows: DataFrame, files: int = 1) -> DataFrame:
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("SELECT DISTINCT user_id, event_type FROM events")
def exactly_once(spark, sf_dir):
    """Events in several batches, each key published once."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id").repartition(3)
    path = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    checkpoint = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = jobs.tail(_stream_of(spark, e, files=1), jobs.merge_new(path, ["user_id", "event_type"], "published"), checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(path).select("user_id", "event_type")


# What an index scans


@query("WITH v AS (SELECT source, lang, count(*) AS session_count, min(doc_id) AS first_seen FROM documents WHERE source IS NOT NULL GROUP BY 1, 2), c AS (SELECT doc_id, source, lang FROM documents WHERE doc_id % 3 <> 0 AND source IS NOT NULL) SELECT c.doc_id, v.session_count, v.first_seen FROM c JOIN v ON c.source = v.source AND c.lang = v.lang WHERE v.lang = 'en'")
def chunk_scan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    version = F.concat_ws("|", "source", "lang")
    chunks = d.select(version.alias("snapshot"), "doc_id", F.lit("tool").alias("kind"), F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("indexed").alias("state"))
    versions = d.groupBy(version.alias("content_hash"), F.col("lang").alias("client")).agg(F.count(F.lit(1)).alias("session_count"), F.min("doc_id").alias("first_seen"))
    return kb.indexed_chunks(chunks, versions, client="en", kind="tool").select("doc_id", "session_count", "first_seen")


@query(f"WITH {ct.M} SELECT session_id, record_index FROM messages WHERE client = 'c1' AND record_index % 2 = 0")
def message_scan(spark, sf_dir):
    m = tb.messages(spark, sf_dir).withColumn("state", F.when(F.col("record_index") % 2 == 0, "indexed").otherwise("failed"))
    return kb.indexed_messages(m, "c1").select("session_id", "record_index")


@query(f"WITH {ct.S}, {ct.R}, w AS (SELECT session_id, record_index, lag(record_index) OVER (PARTITION BY session_id, event_type ORDER BY record_index) AS before FROM records) SELECT session_id, record_index, before FROM w WHERE before IS NOT NULL AND record_index - before = 1")
def repeated_kinds(spark, sf_dir):
    """Records right after one of their own kind."""
    r = tb.records(spark, sf_dir)
    before = F.lag("record_index").over(Window.partitionBy("session_id", "event_type").orderBy("record_index"))
    return r.withColumn("before", before).where("record_index - before = 1").select("session_id", "record_index", "before")
