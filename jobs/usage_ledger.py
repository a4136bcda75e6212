"""Usage ledger: reads recorded traffic as it arrives and keeps, by day, a summary of each session.

    python jobs/usage_ledger.py --config jobs/usage_ledger.json [--source PATH] [--output PATH]

The source is a folder (or a pattern) of Parquet files to which files are added. Every call takes the files that are new
since the last one (Structured Streaming with a checkpoint, all that is available, then it ends) and writes the days that
they touch again. An interrupted call is gone on with by the next one; a call that finds nothing new changes nothing.

Output below ``output``: ``ledger/date=D`` for readers, ``states/date=D/batch=N`` for later calls, ``checkpoint``.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanmill.operators import ledger  # noqa: E402
from spanmill.session import build_session  # noqa: E402

log = logging.getLogger("jobs.usage_ledger")

#: Fields of the source that are read; others are left alone.
SCHEMA = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double"
#: The kind of a record whose value counts for each sum.
COUNTED = {"input_tokens": "view", "output_tokens": "click", "cache_read_tokens": "purchase", "cache_create_tokens": "signup"}


def records(events: DataFrame) -> DataFrame:
    """Traffic rows as the ledger takes them."""
    tokens = F.floor("value").cast("long")
    counts = [F.when(F.col("event_type") == kind, F.coalesce(tokens, F.lit(0))).otherwise(0).alias(name) for name, kind in COUNTED.items()]
    errors = F.when(F.col("event_type") == "error", 1).otherwise(0).alias("errors")
    return events.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), *counts, errors)


def run(spark: SparkSession, source: str, output: str, files_per_batch: int | None = None) -> dict:
    """Take what is new at source into the ledger at output; returns what was read and written by batch."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # days are those of UTC
    done: list[dict] = []
    try:
        reader = spark.readStream.schema(SCHEMA)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        stream = records(reader.parquet(source)).writeStream.option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True)
        query = stream.foreachBatch(lambda batch, number: done.append(ledger.merge_batch(batch, number, output))).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    log.info("%s: %s batches, %s records read from %s", output, len(done), sum(d["read"] for d in done), source)
    return {"batches": done, "read": sum(d["read"] for d in done)}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), "usage_ledger.json"))
    for name in ("source", "output", "master"):
        parser.add_argument(f"--{name}")
    args = parser.parse_args(argv)
    with open(args.config, encoding="utf-8") as f:
        settings = json.load(f)
    settings |= {k: v for k, v in vars(args).items() if k != "config" and v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = build_session("usage-ledger", settings.get("master"))
    try:
        run(spark, settings["source"], settings["output"], settings.get("files_per_batch"))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
