"""Structured Streaming: folding event streams, liveness, running summaries, live tail, indexing.

The folds are those of functions.folds, so a stream gives what a batch over the same events gives.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanmill.functions.folds import TERMINAL, finished, fold_event, parse_sse
from spanmill.operators.sessions import STALE_ACTIVE, STALE_EMPTY

#: Seconds without events after which an unfinished stream is given out as it is.
QUIET_SECONDS = 900


def fold_batch(events: DataFrame, key: str = "request_id", order: str = "seq") -> DataFrame:
    """key, document (JSON text, null if the events never begin one) of event rows (key, order, event, data).

    Events come by request and in order; a task holds one document and one Arrow batch, however many events a request has.
    Among events of one place the order is that of their texts; events without a key are one request.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, held = None, None

        def document() -> tuple:
            whole = finished(held)
            return open_key, None if whole is None else json.dumps(whole, ensure_ascii=False)

        for pdf in batches:
            ended = []
            for request, name, data in zip(pdf["key"], pdf["event"], pdf["data"]):
                if held is None or request != open_key:
                    ended += [] if held is None else [document()]
                    open_key, held = request, {}
                fold_event(held, name, _json(data))
            yield pd.DataFrame(ended, columns=["key", "document"])
        if held is not None:
            yield pd.DataFrame([document()], columns=["key", "document"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(order).alias("seq"), "event", "data")
    return rows.repartition("key").sortWithinPartitions("key", "seq", "event", "data").select("key", "event", "data").mapInPandas(run, "key string, document string")


def _json(text: Any) -> Any:
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return text


def fold_stream(events: DataFrame, key: str = "request_id", order: str = "seq", quiet_seconds: int = QUIET_SECONDS) -> DataFrame:
    """key, document, complete: a row when a stream ends, or when it has been quiet for long.

    Events of a stream are taken in order within a batch; what comes after the end begins a new document.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict = json.loads(state.get[0]) if state.exists else {}
        out = []

        def emit(complete: bool) -> None:
            document = finished(held)
            if document is not None:
                out.append((group[0], json.dumps(document, ensure_ascii=False), complete))
            held.clear()

        if state.hasTimedOut:
            emit(False)
        else:
            for pdf in frames:
                for name, data in pdf.sort_values("seq", kind="stable")[["event", "data"]].itertuples(index=False):
                    fold_event(held, name, _json(data))
                    if name in TERMINAL:
                        emit(True)
        if held:
            state.update((json.dumps(held, ensure_ascii=False),))
            state.setTimeoutDuration(quiet_seconds * 1000)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "document", "complete"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(order).alias("seq"), "event", "data")
    return rows.groupBy("key").applyInPandasWithState(run, "key string, document string, complete boolean", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sse_events(bodies: DataFrame, key: str = "request_id", text: str = "body") -> DataFrame:
    """Event rows of stored event-stream bodies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, n, d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for k, t in zip(pdf["key"], pdf["body"]) for i, (n, d) in enumerate(parse_sse(t or ""))]
            yield pd.DataFrame(out, columns=["request_id", "seq", "event", "data"])

    return bodies.select(F.col(key).cast("string").alias("key"), F.col(text).alias("body")).mapInPandas(run, "request_id string, seq long, event string, data string")


def once_within(events: DataFrame, keys: list[str], time: str, within: str = "1 hour") -> DataFrame:
    """Events of each key once; keys are forgotten after a time, which bounds the state."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def running_summary(records: DataFrame, key: str = "session_id") -> DataFrame:
    """Counts and tokens of each session so far, and the model used last; for update or complete output."""
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("record_count"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.max_by("model", "record_index").alias("model_last"), F.max("failed").alias("failed"), F.max("turn").alias("turn_count"), F.max("timestamp").alias("updated_at"))


def liveness(records: DataFrame, key: str = "session_id") -> DataFrame:
    """key, status, record_count: active with each batch of a session's records, then its end once it has been quiet too long.

    Rows without a payload open a session that has no record yet, which waits less. A later record revives a session.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, failed = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            state.remove()
            status = "error" if failed else "empty" if count == 0 else "complete"
        else:
            for pdf in frames:
                count += int(pdf["payload"].notna().sum())
                failed = bool(failed or pdf["failed"].fillna(False).any())
            state.update((int(count), failed))
            state.setTimeoutDuration((STALE_ACTIVE if count else STALE_EMPTY) * 1000)
            status = "active"
        yield pd.DataFrame({"session_id": [group[0]], "status": [status], "record_count": [count]})

    rows = records.select(F.col(key).cast("string").alias("session_id"), "payload", "failed")
    return rows.groupBy("session_id").applyInPandasWithState(run, "session_id string, status string, record_count long", "count long, failed boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)


def daily_counts(events: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Events of each day; a day is closed and forgotten once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day")).agg(F.count(F.lit(1)).alias("events")).select(F.to_date("window.start").alias("day"), "events")


def tail(records: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 1) -> DataStreamWriter:
    """Hands each micro-batch to publish(batch, number): a live view, a change notice, an index. Batches that are run again
    after a failure have the same number, so a publisher that keeps it delivers once."""
    return records.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(publish)


def follow(spark: SparkSession, log: str, schema: str, cursor: str, publish: Callable[[DataFrame, int], None], files: int = 100) -> int:
    """One consumer of a log of Parquet files to which others append: hands publish(rows, number) what has come since its last call,
    at most so many files at a time, and returns how many rows that were.

    A consumer is known by its cursor, a checkpoint folder of its own, so a slow one holds nobody up, a late one begins at the
    first file, and one that was interrupted gets its last batch again under the same number. The backlog is the log itself; what
    a consumer holds of it is one batch.
    """
    seen: list[int] = []

    def hand_on(batch: DataFrame, number: int) -> None:
        counted = Observation(f"rows-{uuid.uuid4().hex}")
        publish(batch.observe(counted, F.count(F.lit(1)).alias("n")), number)
        seen.append(counted.get["n"])

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    query = reader.parquet(log).writeStream.option("checkpointLocation", cursor).trigger(availableNow=True).foreachBatch(hand_on).start()
    query.awaitTermination()
    return sum(seen)


#: Parts that known keys are kept in; a batch reads those that its own keys fall in.
KEY_PARTS = 64


def merge_new(path: str, keys: list[str], done: str) -> Callable[[DataFrame, int], None]:
    """A publisher that appends rows whose keys are not at path yet; a batch number that is written already is passed over.

    Keys are kept beside the rows, dealt by hash: a batch reads the parts that its keys fall in, and no rows. Where keys may be
    forgotten after a time, once_within() does without."""
    known = f"{path}_keys"

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm

        def there(name: str) -> bool:
            target = jvm.org.apache.hadoop.fs.Path(name)
            return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

        target = f"{path}/batch={number}"
        if there(f"{target}/_SUCCESS"):
            return
        fresh = batch.dropDuplicates(keys).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(KEY_PARTS)).cast("int"))
        if there(known):
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema if f.name in keys) + ", batch long, _part int"
            parts = [r["_part"] for r in fresh.select("_part").distinct().collect()]  # at most KEY_PARTS
            # Keys that this batch itself left behind before a failure are no reason to leave its rows out.
            held = spark.read.schema(schema).parquet(known).where(F.col("_part").isin(*parts) & (F.col("batch") < number))
            fresh = fresh.join(held.select(*keys), keys, "left_anti")
        fresh.withColumn("batch", F.lit(number).cast("long")).select(*keys, "batch", "_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "_part").parquet(known)
        fresh.drop("_part").withColumn(done, F.lit(number)).write.mode("overwrite").parquet(target)

    return publish
