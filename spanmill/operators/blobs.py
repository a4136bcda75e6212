"""Content-addressed payloads: large repeated fields of records are stored once for each session and referred to.

A reference is an object with one marker key; refs lists the JSON pointers that were replaced, so that user data of the
same shape is left alone when records are put together again.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.chunking import blob_payload
from spanmill.functions.record import dig, parse
from spanmill.session import JSON_BATCH_BYTES, cut, text_batches

#: Least size, fields stored whole, and lists whose items are stored each.
MIN_BYTES, VERSION = 512, 1
WHOLE = (("request", "body", "instructions"), ("request", "body", "tools"), ("response", "body", "instructions"), ("response", "body", "tools"))
ITEMS = (("request", "body", "input"), ("request", "body", "messages"))
#: Markers of bundles from any writer end in these words.
TRACE_MARK, RECORD_MARK, REF_MARK = re.compile(r"__\w*compact_trace__"), re.compile(r"__\w*compact_record__"), re.compile(r"__\w*blob_ref__")
OWN = "__spanmill_"


def marked(value: Any, mark: re.Pattern) -> Any:
    """What stands under a marker key of value, None without one."""
    return next((v for k, v in value.items() if mark.fullmatch(k)), None) if isinstance(value, dict) else None


def is_ref(value: Any) -> bool:
    inner = marked(value, REF_MARK)
    return isinstance(value, dict) and len(value) == 1 and isinstance(inner, dict) and inner.get("version") == VERSION and inner.get("kind") == "json" and isinstance(inner.get("hash"), str)


def pointer(path: tuple) -> str:
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in path)


def from_pointer(text: str) -> list:
    parts = [p.replace("~1", "/").replace("~0", "~") for p in text.split("/")[1:]]
    return [int(p) if p.isdigit() else p for p in parts]


def replaced(document: Any, path: list, value: Any) -> Any:
    """A copy of document with value at path; a path that does not exist changes nothing."""
    if not path:
        return value
    if dig(document, *path[:1]) is None and not (isinstance(document, dict) and path[0] in document):
        return document
    out = copy.copy(document)
    out[path[0]] = replaced(document[path[0]], path[1:], value)
    return out


def compact(record: dict, store: Callable[[str, str, int], None]) -> dict:
    """record with large fields as references; store(hash, payload, bytes) takes them. A record without any stays as it is."""
    paths = [p for p in WHOLE if dig(record, *p) is not None]
    paths += [(*p, i) for p in ITEMS if isinstance(dig(record, *p), list) for i in range(len(dig(record, *p)))]
    out, refs = record, []
    for path in paths:
        text, size, digest = blob_payload(dig(record, *path))
        if size >= MIN_BYTES:
            store(digest, text, size)
            out = replaced(out, list(path), {OWN + "blob_ref__": {"version": VERSION, "kind": "json", "hash": digest, "bytes": size}})
            refs.append({"path": pointer(path), "hash": digest, "bytes": size})
    return {OWN + "compact_record__": {"version": VERSION, "encoding": "json-blob-ref", "refs": refs}, "record": out} if refs else record


class MissingBlob(KeyError):
    pass


def materialize(stored: dict, load: Callable[[str], Any]) -> dict:
    """The record again; load(hash) gives a blob's value or raises MissingBlob. Records stored without a list of
    references are searched at the usual places."""
    head = marked(stored, RECORD_MARK)
    record = stored.get("record") if head is not None else stored
    if head is not None and isinstance(head.get("refs"), list) and head["refs"]:
        paths = [from_pointer(r["path"]) for r in head["refs"] if isinstance(dig(r, "path"), str)]
    elif head is not None:
        paths = [list(p) for p in WHOLE] + [[*p, i] for p in ITEMS for i in range(len(dig(record, *p) or []))]
    else:
        paths = []
    for path in paths:
        value = dig(record, *path)
        if is_ref(value):
            record = replaced(record, path, load(marked(value, REF_MARK)["hash"]))
    return record


def compact_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with references, blobs): blobs once for each session and hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for session, index, payload in zip(pdf["session_id"], pdf["record_index"], pdf["payload"]):
                found: list[tuple] = []
                r = parse(payload)
                small = compact(r, lambda *b: found.append(b)) if isinstance(r, dict) else None
                out.append((session, index, payload if not found else json.dumps(small, ensure_ascii=False, separators=(",", ":")), [{"hash": h, "payload": t, "size_bytes": n} for h, t, n in {b[0]: b for b in found}.values()]))
            yield pd.DataFrame(out, columns=["session_id", "record_index", "payload", "blobs"])

    text_batches(records.sparkSession, JSON_BATCH_BYTES)
    both = records.select("session_id", F.col("record_index").cast("long").alias("record_index"), "payload").mapInPandas(run, "session_id string, record_index long, payload string, blobs array<struct<hash:string,payload:string,size_bytes:long>>")
    blobs = both.select("session_id", F.explode("blobs").alias("b")).select("session_id", "b.hash", F.lit("json").alias("kind"), "b.payload", "b.size_bytes").dropDuplicates(["session_id", "hash"])
    return both.drop("blobs"), blobs


def resolve_records(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """records with their blobs put back; a record with a missing or unreadable blob is left out.

    References are exploded, joined by (session, hash) and gathered for each record again.
    """

    def hashes(payloads: pd.Series) -> pd.Series:
        def of(text):
            stored = parse(text)
            found: list[str] = []
            if marked(stored, RECORD_MARK) is not None:
                try:
                    materialize(stored, lambda h: found.append(h))
                except (KeyError, TypeError):
                    pass
            return list(dict.fromkeys(found))

        return payloads.map(of)

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for session, index, payload, held in zip(pdf["session_id"], pdf["record_index"], pdf["payload"], pdf["held"]):
                values = {b["hash"]: parse(b["payload"]) for b in (held if held is not None else [])}
                try:
                    record = materialize(parse(payload), values.__getitem__)
                    out.append((session, index, json.dumps(record, ensure_ascii=False, separators=(",", ":"))))
                except (KeyError, TypeError):
                    continue
            yield pd.DataFrame(out, columns=["session_id", "record_index", "payload"])

    text_batches(records.sparkSession, JSON_BATCH_BYTES)
    listed = records.select("session_id", "record_index", "payload", F.pandas_udf(hashes, "array<string>")("payload").alias("_refs"))
    refs = listed.select("session_id", "record_index", F.explode("_refs").alias("hash"))
    held = refs.join(blobs.where("kind = 'json'").select("session_id", "hash", F.col("payload").alias("_p")), ["session_id", "hash"]).groupBy("session_id", "record_index").agg(F.collect_list(F.struct("hash", F.col("_p").alias("payload"))).alias("held"))
    plain = listed.where(F.size("_refs") == 0).select("session_id", "record_index", "payload")
    packed = listed.where(F.size("_refs") > 0).join(held, ["session_id", "record_index"], "left").select("session_id", "record_index", "payload", "held")
    return plain.unionByName(packed.mapInPandas(rebuild, "session_id string, record_index long, payload string"))


#: A reference as it stands in a payload's text.
REF_TEXT = r'"__\w*blob_ref__"\s*:\s*\{[^{}]*?"hash"\s*:\s*"([^"\\]+)"'


def references(payload: Column) -> Column:
    """Hashes that a payload's text refers to, wherever they stand in it, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(payload, F.lit("")), F.lit(REF_TEXT), F.lit(1)))


def reached_blobs(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """session_id, record_index, hash, depth: all blobs that a record needs, those its blobs refer to included, with the fewest
    steps to each. Hashes without a blob are reached as well, so what is missing can be seen.

    References are found by text, at any place and without a list of them. A round joins what is new to the blobs' own
    references; what a record has reached before is left out, so references in a circle end.
    """
    inner = cut(blobs.select("session_id", "hash", F.explode(references(F.col("payload"))).alias("_to")).distinct())
    fresh = cut(records.select("session_id", F.col("record_index").cast("long").alias("record_index"), F.explode(references(F.col("payload"))).alias("hash")).distinct())
    reached, depth = fresh.withColumn("depth", F.lit(1)), 1
    while not fresh.isEmpty():
        depth += 1
        onward = fresh.join(inner, ["session_id", "hash"]).select("session_id", "record_index", F.col("_to").alias("hash")).distinct()
        fresh = cut(onward.join(reached, ["session_id", "record_index", "hash"], "left_anti"))
        reached = cut(reached.unionByName(fresh.withColumn("depth", F.lit(depth))))
    return reached


def orphan_blobs(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs that no record needs, by way of other blobs neither."""
    return blobs.join(reached_blobs(records, blobs).select("session_id", "hash").distinct(), ["session_id", "hash"], "left_anti")


def text_blobs(texts: DataFrame, text: str = "text", least: int = MIN_BYTES) -> DataFrame:
    """Texts of least bytes and more once each, by hash: rows, size in bytes."""
    raw = F.col(text).cast("binary")
    return texts.where(F.octet_length(F.col(text)) >= least).groupBy(F.sha2(raw, 256).alias("hash")).agg(F.count(F.lit(1)).alias("uses"), F.max(F.octet_length(F.col(text))).cast("long").alias("size_bytes"))
