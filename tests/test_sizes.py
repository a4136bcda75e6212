"""What keeps tasks, batches and the driver small on larger tables (FINDINGS_r03)."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F
from spanmill.functions import records as rc
from spanmill.operators import blobs, lineage as ln
from spanmill.session import JSON_BATCH_BYTES, shared_dir
from spanmill.sources import readers, sinks, sockets

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
RECORDS = "session_id string, record_index long, payload string"


@pytest.fixture
def record(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, str(64 << 20))
    yield spark.createDataFrame([("s", 0, '{"turn":1}')], RECORDS)
    spark.conf.set(KEY, before)


@pytest.mark.parametrize("step", [
    rc.described, rc.messages, rc.snapshots, blobs.compact_records, sinks.as_compact,
    lambda r: rc.sections(r, "record_index", "payload"),
    lambda r: sockets.records(r.sparkSession.createDataFrame([], sockets.FRAMES)),
])
def test_batches_of_json_are_bounded(spark, record, step):
    """F14 to F17, F19, F20, F22."""
    step(record)
    assert int(spark.conf.get(KEY).rstrip("b")) <= JSON_BATCH_BYTES


def test_transcripts_in_folders_as_spark_writes_them(spark, tmp_path):
    """nothing has to be renamed by the driver."""
    line = '{"role":"%s","message":{"content":"%s"}}'
    rows = [(c, line % (role, c + role)) for c in ("c1", "c2") for role in ("user", "assistant")]
    spark.createDataFrame(rows, "conv string, value string").coalesce(1).write.partitionBy("conv").text(f"{tmp_path}/project/agent-transcripts")
    got = {(r["record_path"], r["text"]) for r in readers.read_transcripts(spark, str(tmp_path), glob="*.txt").collect()}
    assert got == {(f"/cursor/transcript/{c}/turn/1/step/{n}", c + role) for c in ("c1", "c2") for n, role in enumerate(("user", "assistant"))}


def test_prefix_keys_are_two_longs(spark):
    """as decimals they took twice the memory."""
    e = spark.createDataFrame([("a", 0, ["x"]), ("a", 1, ["x", "y"])], "scope string, idx long, prints array<string>")
    assert ln.prefix_rows(e).schema["_key"].dataType.simpleString() == "struct<_k0:bigint,_k1:bigint>"


def test_logs_go_through_several_files(spark, tmp_path):
    """no task writes or numbers all lines."""
    from spanmill.plans import catalogue, traffic  # noqa: F401  it adds its queries

    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 50, start + dt.timedelta(seconds=i), f"kind {i % 3}", 1.0, "{}") for i in range(1000)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    before, adaptive = set(glob.glob(f"{shared_dir(spark)}/logs-*/part-*")), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(adaptive, "false")
    try:
        got = sorted(tuple(r) for r in catalogue.QUERIES["log_lines"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.set(adaptive, "true")
    assert len(set(glob.glob(f"{shared_dir(spark)}/logs-*/part-*")) - before) > 1
    assert got == sorted((str(u), n // 50 + 1, f"{t:%H:%M:%S}", kind) for n, u, t, kind, *_ in rows)


def test_sessions_are_read_off_sorted_partitions(spark, record):
    """no pandas group for each session."""
    plan = sinks.as_compact(record).withColumn("n", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan
