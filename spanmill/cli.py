"""Command line: ``python -m spanmill.cli <command> ...``.

Exit codes: 0 done, 1 nothing found, 2 wrong use, 3 a store that has to be built anew.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spanmill.functions import records as rc
from spanmill.operators import api, extract as ex, knowledge as kb, models, retrieval as rt
from spanmill.session import build_session
from spanmill.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanmill")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("export", help="a trace file in another form")
    e.add_argument("source")
    e.add_argument("--format", choices=sinks.FORMATS)
    e.add_argument("--output", "-o")
    m = sub.add_parser("export-prompt", help="the prompt of a trace file as Markdown")
    m.add_argument("source")
    s = sub.add_parser("stats", help="usage by day, client, project and model of a sessions table")
    s.add_argument("sessions")
    s.add_argument("--from", dest="date_from")
    s.add_argument("--to", dest="date_to")
    i = sub.add_parser("index", help="messages of trace files with their vectors")
    i.add_argument("source")
    i.add_argument("store")
    q = sub.add_parser("search", help="a search over an index")
    q.add_argument("store")
    q.add_argument("query")
    q.add_argument("--limit", type=int, default=10)
    q.add_argument("--min-score", type=float)
    q.add_argument("--client")
    t = sub.add_parser("status", help="how much of an index is ready")
    t.add_argument("store")
    r = sub.add_parser("reindex", help="all vectors of an index anew")
    r.add_argument("store")
    d = sub.add_parser("purge", help="take a text out of an index for good, or let it in again")
    d.add_argument("store")
    d.add_argument("content_hash")
    d.add_argument("--client")
    d.add_argument("--role")
    d.add_argument("--undo", action="store_true")
    x = sub.add_parser("extract", help="messages and prompts of trace files that a base does not hold yet")
    x.add_argument("source")
    x.add_argument("base")
    x.add_argument("--client", default="")
    x.add_argument("--limit", type=int, help="sessions at most")
    v = sub.add_parser("timeline", help="prompt versions of trace files in order of appearance")
    v.add_argument("source")
    v.add_argument("--client")
    v.add_argument("--model")
    for command in (i, q, r):
        command.add_argument("--settings", help="a TOML file that names embedder and reranker")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return 0 if stop.code in (0, None) else 2
    spark = spark or build_session("spanmill")
    commands = {"export": export, "export-prompt": export_prompt, "stats": stats, "index": index, "search": search, "status": status, "reindex": reindex, "purge": purge, "extract": extract, "timeline": timeline}
    try:
        return commands[args.command](spark, args)
    except models.Unavailable as missing:
        print(missing, file=sys.stderr)
        return 2


def _records(spark, source: str):
    return readers.read_traces(spark, source).withColumnRenamed("path", "session_id")


def export(spark, args) -> int:
    records = _records(spark, args.source)
    if records.isEmpty():
        return 1
    out = sinks.export(records, args.format, args.output)
    if not args.output:
        for row in out.select("value").toLocalIterator():
            print(row["value"])
    return 0


def export_prompt(spark, args) -> int:
    found = rc.snapshots(_records(spark, args.source)).select(rc.prompt_markdown()("system_prompt", "developer_prompt", "user_prompt", "tools").alias("value")).collect()
    for row in found:
        print(row["value"])
    return 0 if found else 1


def stats(spark, args) -> int:
    try:
        views = api.stats_view(spark.read.parquet(args.sessions), args.date_from, args.date_to)
    except ValueError as wrong:
        print(wrong, file=sys.stderr)
        return 2
    for name, view in views.items():
        print(name)
        view.show(50, False)
    return 0


#: Where a table stands while another one takes its place.
ASIDE = "-former"


def _table(spark, path: str, schema: str):
    """A table, or no rows where there is none."""
    held, aside = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ASIDE))
    files = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(aside) and not files.exists(held):
        files.rename(aside, held)
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def _replace(spark, frame, path: str) -> None:
    """Write frame, which may read path, and put it in its place. The former table goes only once the new one is there; what an
    interrupted call has set aside is taken back by _table."""
    jvm, fresh = spark.sparkContext._jvm, f"{path}-{uuid.uuid4().hex}"
    frame.write.parquet(fresh)
    old, new, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, path + ASIDE))
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(old):
        files.delete(aside, True)
        files.rename(old, aside)
    files.rename(new, old)
    files.delete(aside, True)
    spark.catalog.refreshByPath(path)


STONES = "content_hash string, client string, role string"


def index(spark, args) -> int:
    """Writes messages with ids and vectors, without purged ones; the store says which embedder made them."""
    embedder = models.make_embedder(models.read_settings(args.settings))
    messages = rc.messages(_records(spark, args.source)).withColumn("client", F.lit(""))
    messages = kb.without_purged(messages, _table(spark, args.store + "-purged", STONES))
    unique = kb.unique_messages(messages.withColumn("seen_at", F.col("timestamp")), ["seen_at", "session_id", "record_index", "message_index"])
    rows = unique.withColumns({"id": F.xxhash64(*kb.KEY), "embedding": F.lit(None).cast("array<float>"), "state": F.lit("pending"), "attempts": F.lit(0)})
    models.index_pending(rows, embedder).withColumn("embedder", F.lit(embedder.name)).write.mode("overwrite").parquet(args.store)
    return 0


def reindex(spark, args) -> int:
    embedder = models.make_embedder(models.read_settings(args.settings))
    rows = spark.read.parquet(args.store)
    _replace(spark, models.reindex(rows, embedder).withColumn("embedder", F.lit(embedder.name)), args.store)
    counts = {r["state"]: r["count"] for r in spark.read.parquet(args.store).groupBy("state").count().collect()}
    print(f"indexed={counts.get('indexed', 0)} failed={counts.get('failed', 0)}")
    return 0


def purge(spark, args) -> int:
    """Takes a text's variants (or the one named) out of the store and remembers that; with --undo it may come in again."""
    stones = _table(spark, args.store + "-purged", STONES)
    if args.undo:
        left = kb.unpurge(stones, args.content_hash)
        gone = stones.count() - left.count()
        if gone:
            _replace(spark, left, args.store + "-purged")
        print(f"unpurged={gone}")
        return 0 if gone else 1
    rows = spark.read.parquet(args.store)
    kept, after = kb.purge(rows, stones, args.content_hash, args.client, args.role)
    gone = rows.count() - kept.count()
    if not gone and not (args.client is not None and args.role is not None):
        print(f"{args.content_hash} is not in the store; with --client and --role it is kept out for the future", file=sys.stderr)
        return 1
    _replace(spark, after, args.store + "-purged")
    if gone:
        _replace(spark, kept, args.store)
    print(f"purged={gone}")
    return 0


def extract(spark, args) -> int:
    """Takes what is new, and leaves out what the base's purged texts name."""
    records = _records(spark, args.source)
    sessions = records.groupBy("session_id").agg(F.lit(args.client).alias("client")).withColumnRenamed("session_id", "id")
    done = ex.extract(sessions, records, args.base, _table(spark, args.base + "-purged", STONES), args.limit)
    print("  ".join(f"{k}={v}" for k, v in done.items()))
    return 0 if done["sessions"] else 1


def timeline(spark, args) -> int:
    found = rc.snapshots(_records(spark, args.source)).withColumnRenamed("provider", "client")
    rows = kb.timeline(kb.versions(found, ["seen_at", "session_id"]), args.client, args.model).orderBy("client", "model", "version").collect()
    for r in rows:
        print(f"{r['client']}  {r['model']}  v{r['version']}  {r['first_seen']}  {r['last_seen']}  {r['session_count']}  {r['content_hash'][:12]}")
    return 0 if rows else 1


def search(spark, args) -> int:
    rows = spark.read.parquet(args.store)
    settings = models.read_settings(args.settings)
    embedder = models.make_embedder(settings)
    try:
        rt.check_identity((rows.select("embedder").first() or [embedder.name])[0], embedder.name)
    except ValueError as wrong:
        print(wrong, file=sys.stderr)
        return 3
    ready = rows.where("state = 'indexed'")
    found = api.kb_search(ready.select("id", "text", "session_id", "client"), ready.select("id", "embedding"), args.query, embedder.queries, group="session_id", client=args.client, limit=args.limit, min_score=args.min_score, reranker=models.make_reranker(settings), weights=settings.rrf_weights)
    hits = found.orderBy(F.desc("group_score"), "session_id", "place").collect()
    for r in hits:
        print(f"{r['score']:.3f}  {r['session_id']}  {r['text'][:200]}")
    return 0 if hits else 1


def status(spark, args) -> int:
    for row in api.kb_status(spark.read.parquet(args.store), ("hash-16", 16))["rows"]:
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
