"""Captured socket frames as records: fragments to messages, messages to one record for each response.

A frame is (connection, seq, at, sender, opcode, fin, data): its place on its connection, its time, client or server, the
protocol's opcode, whether it ends a message, and its bytes. Messages may be cut at any byte, and control frames may stand between
fragments. A record holds what the client sent and the server answered since the record before, up to the message that
completes a response. A response completed twice counts once: the repeated end is left out, and what the server sent
before it is a record of its own. What is left when a connection ends is a last record.

Rows without connection, seq, sender or opcode are left out, as are binary messages, messages that never end, fragments
of no message, and what stands between a final fragment and the next start. Null data is empty, null fin is final, bytes
that are no UTF-8 are replaced. Rows that repeat a frame count once. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanmill.functions.folds import fold_events, fold_ws_request
from spanmill.session import JSON_BATCH_BYTES, cut, text_batches

#: Opcodes of the protocol, and the server's messages that end a response.
MORE, TEXT, BINARY, CLOSE = 0, 1, 2, 8
ENDS = ("response.completed", "response.done")
PATH = "/v1/responses"

#: Frames of a connection that are counted in one task; a longer connection is counted span by span.
SPAN = 10_000
#: Ended responses that a stream remembers of a connection, so that its state is bounded. A batch remembers all.
REMEMBERED = 1024
#: Seconds by the frames' own times that a stream waits for a connection's next frame before it takes it for ended.
QUIET_SECONDS = 3600

FRAMES = "connection string, seq long, at timestamp, sender string, opcode int, fin boolean, data binary"
RECORDS = "connection string, number long, payload string"


def _clean(frames: DataFrame, *more: Column) -> DataFrame:
    final, data = F.coalesce("fin", F.lit(True)), F.coalesce(F.col("data").cast("binary"), F.lit(b""))
    known = F.col("connection").isNotNull() & F.col("seq").isNotNull() & F.col("sender").isin("client", "server") & F.col("opcode").isNotNull()
    return frames.where(known).select(F.col("connection").cast("string").alias("connection"), F.col("seq").cast("long").alias("seq"), "sender", F.col("opcode").cast("int").alias("opcode"), final.alias("fin"), data.alias("data"), *more)


def running_counts(rows: DataFrame, keys: list[str], order: str, counts: dict[str, Column], inclusive: bool, span: int = SPAN) -> DataFrame:
    """rows with running counts of conditions in order within keys: counts of spans first, a window over those few, then a
    window within each span, so a key that holds most rows is spread over tasks."""
    placed = rows.withColumn("_span", F.floor(F.col(order) / span))
    sums = placed.groupBy(*keys, "_span").agg(*[F.count_if(c).alias(f"_in_{n}") for n, c in counts.items()])
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_span", *[F.coalesce(F.sum(f"_in_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in counts])
    here = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    total = {n: F.col(f"_before_{n}") + F.count_if(c).over(here) for n, c in counts.items()}
    return placed.join(before, [*keys, "_span"]).withColumns(total).drop("_span", *[f"_before_{n}" for n in counts])


def messages(frames: DataFrame, span: int = SPAN) -> DataFrame:
    """connection, sender, seq (of the frame that ended it), text of the text messages."""
    data = _clean(frames).where(F.col("opcode").isin(MORE, TEXT, BINARY)).withColumn("_span", F.floor(F.col("seq") / span))
    once = data.dropDuplicates(["connection", "sender", "_span", "seq"]).drop("_span")
    numbered = running_counts(once, ["connection", "sender"], "seq", {"n": F.col("opcode") != MORE}, True, span)
    part = F.struct("seq", F.hex("data").alias("data"))
    whole = numbered.where("n > 0").groupBy("connection", "sender", "n").agg(F.min_by("opcode", "seq").alias("kind"), F.min(F.when(F.col("fin"), F.col("seq"))).alias("seq"), F.array_sort(F.collect_list(part)).alias("parts"))
    read = F.array_join(F.transform(F.filter("parts", lambda p: p["seq"] <= F.col("seq")), lambda p: p["data"]), "")
    return whole.where((F.col("kind") == TEXT) & F.col("seq").isNotNull()).select("connection", "sender", "seq", F.make_valid_utf8(F.unhex(read).cast("string")).alias("text"))


def _end_key(text: Column) -> Column:
    """What tells ended responses apart, null for messages that end none."""
    value = F.try_parse_json(text)
    ident = F.nullif(F.try_variant_get(value, "$.response.id", "string"), F.lit(""))
    return F.when(F.try_variant_get(value, "$.type", "string").isin(*ENDS), F.coalesce(F.concat(F.lit("id "), ident), F.to_json(value)))


def records(frames: DataFrame, path: str = PATH, span: int = SPAN) -> DataFrame:
    """connection, number (from 1), payload of the records that a table of frames holds.

    Places are worked out on rows without texts; texts travel twice, from fragments to messages and from messages to records.
    """
    text_batches(frames.sparkSession, JSON_BATCH_BYTES)
    held = cut(messages(frames, span).withColumn("_key", F.when(F.col("sender") == "server", _end_key(F.col("text")))))
    ends = held.where(F.col("_key").isNotNull())
    first = F.row_number().over(Window.partitionBy("connection", "_key").orderBy("seq")) == 1
    slim = held.select("connection", "seq", "sender").join(ends.select("connection", "seq", first.alias("_first")), ["connection", "seq"], "left")
    ended, repeat = F.col("_first").isNotNull(), ~F.coalesce("_first", F.lit(True))
    placed = running_counts(slim, ["connection"], "seq", {"_group": F.coalesce("_first", F.lit(False)), "_part": ended}, False, span)
    placed = cut(placed.select("connection", "seq", "sender", "_group", "_part", repeat.alias("_repeat")))
    # A client's messages wait for the next new end, or for the end of the connection.
    closing = placed.groupBy("connection", "_group").agg(F.max(F.col("_part") + F.col("_repeat").cast("int")).alias("_close"))
    at = F.when(F.col("sender") == "client", F.col("_close")).otherwise(F.col("_part"))
    parts = placed.where(~F.col("_repeat")).join(closing, ["connection", "_group"]).select("connection", "seq", at.alias("_part"))
    numbers = running_counts(parts.select("connection", "_part").distinct(), ["connection"], "_part", {"number": F.lit(True)}, True, span)
    texts = lambda who: F.transform(F.array_sort(F.collect_list(F.when(F.col("sender") == who, F.struct("seq", "text")))), lambda m: m["text"])
    sent = held.join(parts, ["connection", "seq"]).groupBy("connection", "_part").agg(texts("client").alias("asked"), texts("server").alias("told"))
    return sent.join(numbers, ["connection", "_part"]).select("connection", "number", _payloads(path)("connection", "number", "asked", "told").alias("payload"))


def _payloads(path: str):
    def run(connection: pd.Series, number: pd.Series, asked: pd.Series, told: pd.Series) -> pd.Series:
        return pd.Series([record(c, int(n), list(a), list(t), path) for c, n, a, t in zip(connection, number, asked, told)], dtype=object)

    return F.pandas_udf(run, "string")


def _read(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return {"raw": text}


def record(connection: str, number: int, asked: list[str], told: list[str], path: str = PATH) -> str:
    """A record as JSON text, with the request and the response folded from their messages."""
    requests = [m if isinstance(m, dict) else {"raw": m} for m in map(_read, asked)]
    events = [_read(t) for t in told]
    answer = fold_events((e["type"], e) for e in events if isinstance(e, dict) and isinstance(e.get("type"), str))
    out = {
        "request_id": connection if number == 1 else f"{connection}_{number}",
        "turn": 1 if number == 1 else f"1.{number}",
        "transport": "websocket",
        "request": {"method": "WEBSOCKET", "path": path, "body": fold_ws_request(requests) or None, "ws_events": requests},
        "response": {"status": 101, "body": answer, "ws_events": events},
    }
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def _ended(text: str) -> str | None:
    value = _read(text)
    if not isinstance(value, dict) or value.get("type") not in ENDS:
        return None
    response = value.get("response")
    ident = response.get("id") if isinstance(response, dict) else None
    return f"id {ident}" if ident else json.dumps(value, sort_keys=True)


class Connection:
    """What a stream holds of a connection between two batches: open fragments, messages of no record yet, ended responses."""

    def __init__(self, connection: str, path: str, held: str | None = None):
        self.connection, self.path = connection, path
        empty = {"seen": None, "open": {}, "client": [], "server": [], "ended": [], "number": 0, "at": 0}
        self.held: dict = json.loads(held) if held else empty

    def take(self, seq: int, sender: str, opcode: int, fin: bool, data: bytes) -> Iterator[tuple[str, int, str]]:
        """Records that a frame completes; frames up to the last one taken are passed over."""
        held = self.held
        if held["seen"] is not None and seq <= held["seen"]:
            return
        held["seen"] = seq
        if opcode in (TEXT, BINARY):
            held["open"][sender] = [opcode, ""]
        if opcode not in (MORE, TEXT, BINARY) or sender not in held["open"]:
            return
        held["open"][sender][1] += data.hex()
        if fin:
            kind, read = held["open"].pop(sender)
            if kind == TEXT:
                yield from self._message(sender, bytes.fromhex(read).decode("utf-8", "replace"))

    def _message(self, sender: str, text: str) -> Iterator[tuple[str, int, str]]:
        held = self.held
        key = _ended(text) if sender == "server" else None
        if key is None or key not in held["ended"]:
            held[sender].append(text)
        if key is None:
            return
        if key in held["ended"]:
            yield from self._give_out([])
            return
        held["ended"] = [*held["ended"], key][-REMEMBERED:]
        asked, held["client"] = held["client"], []
        yield from self._give_out(asked)

    def _give_out(self, asked: list[str]) -> Iterator[tuple[str, int, str]]:
        told, self.held["server"] = self.held["server"], []
        if asked or told:
            self.held["number"] += 1
            number = self.held["number"]
            yield self.connection, number, record(self.connection, number, asked, told, self.path)

    def end(self) -> Iterator[tuple[str, int, str]]:
        asked, self.held["client"] = self.held["client"], []
        yield from self._give_out(asked)


def record_stream(frames: DataFrame, path: str = PATH, quiet_seconds: int = QUIET_SECONDS) -> DataFrame:
    """The records of a stream of frames, each once it is complete; the last of a connection when it is closed, or when frames
    of others are so many seconds ahead of its own last one.

    A connection's frames have to come in order from batch to batch; within one they may come in any. A frame that comes again
    is passed over; frames without a time, and such as lie quiet_seconds behind the newest, are left out. Results are those of
    records(), but for responses ended again after REMEMBERED others.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        connection = Connection(group[0], path, state.get[0] if state.exists else None)
        out, closed = [], state.hasTimedOut
        if not closed:
            rows = [row for pdf in batches for row in zip(*(pdf[c].tolist() for c in ("seq", "sender", "opcode", "fin", "data", "ms")))]
            for seq, sender, opcode, fin, data, _ in sorted(rows, key=lambda row: row[0]):
                out += connection.take(int(seq), sender, int(opcode), bool(fin), bytes(data))
                closed = closed or opcode == CLOSE
            last = max(connection.held["at"], max(int(row[-1]) for row in rows), state.getCurrentWatermarkMs() + 1)
            connection.held["at"] = last
        if closed:
            out += connection.end()
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((json.dumps(connection.held),))
            state.setTimeoutTimestamp(last)
        if out:
            yield pd.DataFrame(out, columns=["connection", "number", "payload"])

    timed = frames.where(F.col("at").isNotNull()).withWatermark("at", f"{quiet_seconds} seconds")
    rows = _clean(timed, F.col("at"), F.unix_millis("at").alias("ms"))
    return rows.groupBy("connection").applyInPandasWithState(run, RECORDS, "held string", "append", GroupStateTimeout.EventTimeTimeout)
