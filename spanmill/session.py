"""Session helpers: settings every entry point shares."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that results depend on, or that suit any cluster; sizes stay with the cluster's owner.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app_name: str = "spanmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; conf's keys use _ for dots (``spark_driver_memory="4g"``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a local session (as in tests)
    gets a folder of its machine; on a cluster, whose machines would not share it, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="spanmill-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is planned and computed within drops its shuffle files when it ends; they would else stay until the driver happens to
    collect its garbage. Frames that were made before are planned before: begin with a new one, as cut does."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation. Its shuffle files go."""
    shared_dir(df.sparkSession)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table that no later step reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows up to which broadcast_small() broadcasts; rows of keys and a few numbers stay under 20 MB.
SMALL_ROWS = 100_000


def broadcast_small(kept: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """kept (a computed table, see cut) with a broadcast hint if it is counted to have at most so many rows; else as it is."""
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


#: Bytes of an Arrow batch that operators over whole texts ask for: long texts then stay few at a time in a worker.
TEXT_BATCH_BYTES = 8 << 20


#: The same for functions that read JSON: what it becomes in Python takes several times its bytes.
JSON_BATCH_BYTES = 2 << 20


def text_batches(spark: SparkSession, most: int = TEXT_BATCH_BYTES) -> None:
    """Bound the session's Arrow batches by bytes, unless they are bound lower already. The setting stays with the session, as its
    lazy results are computed later; it changes how rows travel, not what they are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > most:
        spark.conf.set(key, str(most))
