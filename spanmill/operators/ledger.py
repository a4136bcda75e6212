"""Session summaries that grow by batches: partial states that can be merged, and a ledger by day kept from them.

A partial state of a session's day holds sums, and the first and last record by (time, record id) with what is wanted of them, so
states of any split of the records merge to the state of all of them, in any order. States are stored by day and batch: a batch
that is run again after a failure replaces its own, and the ledger of the days that it touched is made anew from all of theirs.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Counts that a record may add to.
SUMS = ("records", "input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens", "errors")
KEYS = ("date", "session_id")
UNDATED = "undated"
STATE = ", ".join(["date string, session_id string", *(f"{c} long" for c in SUMS), "first struct<ts: timestamp, id: bigint, kind: string>, last struct<ts: timestamp, id: bigint, kind: string>"])


def partial(records: DataFrame) -> DataFrame:
    """States of records (session_id, id, ts, kind and SUMS without records). Records without a time are of the day UNDATED."""
    dated = records.withColumn("date", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit(UNDATED)))
    place = F.struct("ts", F.col("id").cast("long").alias("id"), "kind")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS[1:]]
    return dated.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("records"), *sums, F.min(place).alias("first"), F.max(place).alias("last"))


def merged(states: DataFrame) -> DataFrame:
    """One state of each session's day from several."""
    return states.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS], F.min("first").alias("first"), F.max("last").alias("last"))


def summaries(states: DataFrame) -> DataFrame:
    """What the ledger holds of merged states."""
    total = sum((F.col(c) for c in SUMS[2:5]), F.col(SUMS[1]))
    status = F.when(F.col("errors") > 0, "error").otherwise("complete")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return states.select("session_id", *SUMS, total.alias("total_tokens"), F.col("first.kind").alias("first_kind"), F.col("last.kind").alias("last_kind"), iso("first.ts").alias("started_at"), iso("last.ts").alias("updated_at"), status.alias("status"), "date")


def merge_batch(batch: DataFrame, number: int, folder: str) -> dict:
    """Take a batch of records (see partial) into the ledger below folder; the same number again replaces what it left.

    folder/states is by date and batch, folder/ledger by date. Only partitions of the batch's days are read and written.
    """
    spark = batch.sparkSession
    options = {"mode": "overwrite", "partitionOverwriteMode": "dynamic"}
    states = f"{folder}/states"
    partial(batch).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").options(**options).partitionBy("date", "batch").parquet(states)
    held = spark.read.schema(f"{STATE}, batch long").parquet(states)
    mine = held.where(F.col("batch") == number)
    days = {r["date"]: r["records"] for r in mine.groupBy("date").agg(F.sum("records").alias("records")).collect()}  # a row a day
    if days:
        # States of later batches than this one can only be there if they are replaced as well.
        touched = held.where(F.col("date").isin(*days) & (F.col("batch") <= number))
        summaries(merged(touched)).write.mode("overwrite").options(**options).partitionBy("date").parquet(f"{folder}/ledger")
    done = {"batch": number, "read": sum(days.values()), "days": len(days)}
    log.info("batch %s: read %s records, wrote the ledger of %s days to %s", number, done["read"], done["days"], folder)
    return done


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    schema = "session_id string, " + ", ".join(f"{c} long" for c in (*SUMS, "total_tokens")) + ", first_kind string, last_kind string, started_at string, updated_at string, status string, date string"
    return spark.read.schema(schema).parquet(f"{folder}/ledger")
