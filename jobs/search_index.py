"""Search index: keeps the stored keyword index of a table of texts as the table is.

    python jobs/search_index.py --config jobs/search_index.json [--source PATH] [--output PATH]

Every call compares the texts at source with those of the index, reads what is new or has changed, and leaves out what is
gone. Its output is partitioned by segment and kind (see spanmill.operators.index); ``search`` of spanmill reads it. A call that
finds nothing to do writes nothing; one that was interrupted is done anew by the next.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanmill.operators import index  # noqa: E402
from spanmill.session import build_session  # noqa: E402

log = logging.getLogger("jobs.search_index")


def run(spark: SparkSession, source: str, output: str, id_column: str = "doc_id", text_column: str = "text", kinds: Sequence[str] = index.KINDS) -> dict:
    """Bring the index at output to the texts at source; returns what was done."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        docs = spark.read.parquet(source).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        done = index.refresh(docs, output, kinds)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    log.info("%s from %s: run %s, %s new texts, %s gone, segments folded: %s, written: %s", output, source, done["run"], done["new"], done["gone"], done["folded"], done["written"])
    return done


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), "search_index.json"))
    for name in ("source", "output", "master"):
        parser.add_argument(f"--{name}")
    args = parser.parse_args(argv)
    with open(args.config, encoding="utf-8") as f:
        settings = json.load(f)
    settings |= {k: v for k, v in vars(args).items() if k != "config" and v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = build_session("search-index", settings.get("master"))
    try:
        run(spark, settings["source"], settings["output"], settings["id_column"], settings["text_column"], settings["kinds"])
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
