"""Builders of small trace tables for tests."""

from spanmill.schemas import SESSIONS, schema


def sessions(spark, rows):
    names = [f.name for f in schema(SESSIONS)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SESSIONS)


def entries(spark, rows):
    return spark.createDataFrame([("s", i, r.get("rid", ""), r.get("prev", ""), r.get("thread", ""), r.get("model", "m"), r.get("main", True), r["p"]) for i, r in enumerate(rows)], "scope string, idx long, response_id string, previous_id string, thread string, model string, is_main boolean, prints array<string>")
