"""How requests of a run follow from one another: parents, chains, threads, groups, gaps, and differences.

``entries`` has scope (a run), idx (capture order from 0), response_id, previous_id, thread, model, is_main and prints
(fingerprints of the messages, functions.record.fingerprint).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.record import message_text, parse
from spanmill.session import cut


def prefix_rows(entries: DataFrame) -> DataFrame:
    """scope, idx, _len, _key, _n: a row for each prefix of an entry's messages with a hash of it, and the entry's number of messages.

    A message counts with its place in sums of hashes, two of them for 128 bits, so a prefix is one addition from the one before
    it, and the work grows with the messages.
    """
    each = entries.select("scope", "idx", F.size("prints").alias("_n"), F.posexplode("prints").alias("_i", "_p")).where("_n > 0")
    upto = Window.partitionBy("scope", "idx").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(F.xxhash64(F.lit(salt), "_i", "_p").cast("decimal(20, 0)")).over(upto).alias(f"_s{salt}") for salt in (0, 1)]
    summed = each.select("scope", "idx", "_n", (F.col("_i") + 1).alias("_len"), *sums)
    return summed.select("scope", "idx", "_n", "_len", F.struct(*[F.xxhash64(F.lit(salt), f"_s{salt}").alias(f"_k{salt}") for salt in (0, 1)]).alias("_key"))


def prefix_parent(entries: DataFrame) -> DataFrame:
    """scope, idx, parent: the earlier entry whose messages are the longest prefix; among equals the nearest.

    Linear in messages: each entry offers the hash of all its messages and asks for the hashes of its prefixes.
    """
    asks = prefix_rows(entries)
    offers = asks.where("_len = _n").select("scope", F.col("idx").alias("_p"), "_len", "_key")
    # An entry is offered once for each later one with the prefix: only the nearest earlier offer is needed, by a window.
    both = asks.select("scope", "_len", "_key", "idx", F.lit(None).cast("long").alias("_p")).unionByName(offers.select("scope", "_len", "_key", F.col("_p").cast("long").alias("idx"), F.col("_p").cast("long").alias("_p")))
    w = Window.partitionBy("scope", "_len", "_key").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_best", F.max("_p").over(w)).where("_p IS NULL AND _best IS NOT NULL")
    return found.groupBy("scope", "idx").agg(F.max_by("_best", F.struct("_len", "_best")).alias("parent"))


def prefix_child(entries: DataFrame) -> DataFrame:
    """scope, idx, child: the later entry of the fewest messages that begin with this one's; among equals the earliest.

    Linear in messages, as prefix_parent: a window over the entries with a prefix, latest first, no pairs.
    """
    prefixes = prefix_rows(entries)
    later = Window.partitionBy("scope", "_len", "_key").orderBy(F.desc("idx")).rangeBetween(Window.unboundedPreceding, -1)
    found = prefixes.withColumn("_best", F.min(F.struct("_n", F.col("idx").alias("child"))).over(later))
    return found.where("_len = _n AND _best IS NOT NULL").groupBy("scope", "idx").agg(F.min("_best.child").alias("child"))


def by_response(entries: DataFrame) -> DataFrame:
    """scope, idx, parent: the nearest earlier entry whose response is the one this entry goes on from."""
    old = entries.where("response_id <> ''").select("scope", F.col("response_id").alias("previous_id"), F.col("idx").alias("_p"))
    return entries.where("previous_id <> ''").select("scope", "idx", "previous_id").join(old, ["scope", "previous_id"]).where("_p < idx").groupBy("scope", "idx").agg(F.max("_p").alias("parent"))


def before_with_same(entries: DataFrame, key: str) -> DataFrame:
    """scope, idx, parent: the nearest earlier entry with the same non-empty key."""
    w = Window.partitionBy("scope", key).orderBy("idx")
    return entries.where((F.col(key) != "") & F.col(key).isNotNull()).select("scope", "idx", F.lag("idx").over(w).alias("parent")).where("parent IS NOT NULL")


def parents(entries: DataFrame) -> DataFrame:
    """entries with parent and how: response, thread, prefix or model (a fall-back: the nearest main turn of the model)."""
    ways = [("response", by_response(entries)), ("thread", before_with_same(entries, "thread")), ("prefix", prefix_parent(entries)), ("model", before_with_same(entries.where("is_main"), "model"))]
    out = entries
    for name, found in ways:
        out = out.join(found.withColumnRenamed("parent", f"_{name}"), ["scope", "idx"], "left")
    how = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n, _ in ways])
    return out.withColumns({"parent": F.coalesce(*[F.col(f"_{n}") for n, _ in ways]), "how": how}).drop(*[f"_{n}" for n, _ in ways])


def chains(links: DataFrame) -> DataFrame:
    """From links (id, parent): for each id its root, and its depth below it. A parent that is no id ends the chain; ids of
    a cycle have no root (null). Pointers double, so rounds grow with the logarithm of the longest chain."""
    ids = links.select("id").distinct()
    jump = links.join(ids.withColumnRenamed("id", "parent").withColumn("_known", F.lit(True)), "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("up"), F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("depth"))
    jump = cut(jump.select("id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("root"), "depth"))
    most = max(1, links.count()).bit_length() + 1
    for _ in range(most):
        if jump.where("up IS NOT NULL").isEmpty():
            break
        far = jump.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        jump = cut(jump.join(far, "up", "left").select("id", F.when(F.col("_root").isNull(), F.col("_up")).alias("up"), F.coalesce("root", "_root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
    return jump.select("id", "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"))


def pair_calls(calls: DataFrame, results: DataFrame, scope: Sequence[str] = ("scope",)) -> DataFrame:
    """Each call (scope, call_id, at) with the first unused result of its id; results left over stand alone."""
    keys = [*scope, "call_id"]
    w = Window.partitionBy(*keys).orderBy("at")
    a = calls.withColumn("_n", F.row_number().over(w)).withColumnRenamed("at", "call_at")
    b = results.withColumn("_n", F.row_number().over(w)).withColumnRenamed("at", "result_at")
    return a.join(b, [*keys, "_n"], "full_outer").drop("_n")


def time_gaps(entries: DataFrame, scope: str = "scope", order: str = "idx", at: str = "ts", least: int = 60) -> DataFrame:
    """entries with gap: seconds since the entry before, where that is a minute and more; null where either has no time."""
    before = F.lag(at).over(Window.partitionBy(scope).orderBy(order))
    gap = (F.unix_micros(F.col(at)) - F.unix_micros(before)) / 1e6
    return entries.withColumn("gap", F.when(gap >= least, gap))


def display_turns(entries: DataFrame, candidate: Column, scope: str = "scope", order: str = "idx") -> DataFrame:
    """entries with turn: candidates numbered from 1 in capture order, null for others."""
    n = F.sum(F.when(candidate, 1).otherwise(0)).over(Window.partitionBy(scope).orderBy(order))
    return entries.withColumn("turn", F.when(candidate, n).cast("long"))


def islands(entries: DataFrame, key: str, scope: str = "scope", order: str = "idx") -> DataFrame:
    """entries with group: runs of consecutive entries with the same key, numbered from 1; null keys go on with the run."""
    w = Window.partitionBy(scope).orderBy(order)
    filled = entries.withColumn("_k", F.last(key, ignorenulls=True).over(w))
    fresh = F.coalesce(~F.col("_k").eqNullSafe(F.lag("_k").over(w)), F.lit(True))
    started = filled.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(fresh.cast("int")))
    return started.withColumn("group", F.sum("_new").over(w)).drop("_k", "_new")


#: Turns that a request for a title may stand from the group it names, and what a group that begins later counts more.
TITLE_REACH, LATER = 2, 0.25


def title_groups(titles: DataFrame, starts: DataFrame, reach: int = TITLE_REACH) -> DataFrame:
    """scope, at, start: for each request that names a conversation (scope, at) the nearest beginning of a group (scope, start), at
    most reach turns away; one that comes later counts a quarter turn more. Those that none is near to are left out.

    Each request looks at the places around it, so this is a join by equal places and no range join.
    """
    looks = titles.select("scope", "at", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)).alias("start"))
    far = F.abs(F.col("start") - F.col("at")) + F.when(F.col("start") > F.col("at"), LATER).otherwise(0.0)
    return looks.join(starts.select("scope", "start").distinct(), ["scope", "start"]).groupBy("scope", "at").agg(F.min_by("start", F.struct(far, "start")).alias("start"))


def session_groups(entries: DataFrame) -> DataFrame:
    """scope, idx, group of a run's entries (user_text, user_at, messages, is_title, app_key), in capture order.

    An entry goes on with the group before it if it has no user text of its own, or the same text at the same place of a
    longer conversation; entries of one app session share a group wherever they stand. Requests that only name a
    conversation join the group at most two turns away, the nearest (a group that begins later counts a quarter more).

    What an entry decides by is the last text before it, so all of it is windows, and a group is known by where it begins.
    """
    run = Window.partitionBy("scope").orderBy("idx")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    rows = entries.select("scope", "idx", F.col("is_title").alias("_title"), F.nullif("user_text", F.lit("")).alias("_text"), "user_at", "messages", F.nullif("app_key", F.lit("")).alias("_app"), (F.row_number().over(run) - 1).alias("at"))
    turns = rows.where("NOT _title").withColumn("_last", F.last(F.when(F.col("_text").isNotNull(), F.struct("_text", "user_at")), ignorenulls=True).over(before))
    same = (F.col("_last._text") == F.col("_text")) & (F.col("messages") > 1) & F.col("_last.user_at").eqNullSafe(F.col("user_at"))
    goes_on = (F.row_number().over(run) > 1) & (F.col("_text").isNull() | F.coalesce(same, F.lit(False)))
    begins = F.when(F.col("_app").isNotNull(), F.min("at").over(Window.partitionBy("scope", "_app"))).when(~goes_on, F.col("at"))
    turns = turns.withColumn("_begins", begins).select("scope", "idx", "at", F.last("_begins", ignorenulls=True).over(run).alias("start"))
    titles = rows.where("_title").select("scope", "idx", "at")
    named = titles.join(title_groups(titles, turns), ["scope", "at"], "left").select("scope", "idx", "at", F.coalesce("start", "at").alias("start"))
    group = F.dense_rank().over(Window.partitionBy("scope").orderBy("start"))
    return turns.unionByName(named).select("scope", "idx", group.cast("long").alias("group"))


# Differences of two requests


def _values(text: Any) -> Any:
    found = parse(text) if isinstance(text, str) and text.strip()[:1] in ("{", "[") else None
    return text if found is None else found


def diff_lines(old: str, new: str, context: int = 4) -> list[tuple[str, str]]:
    """Lines marked ' ', '-', '+' or '…' (folded); equal heads and tails are set aside, the rest is paired by place."""
    a, b = old.split("\n"), new.split("\n")
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]))) if x != y), min(len(a), len(b)) - head)
    fold = lambda lines, front: lines if len(lines) <= context else ([("…", str(len(lines) - context))] + lines[-context:] if front else lines[:context] + [("…", str(len(lines) - context))])
    out = fold([(" ", x) for x in a[:head]], True)
    left, right = a[head : len(a) - tail], b[head : len(b) - tail]
    for i in range(max(len(left), len(right))):
        out += [("-", left[i])] if i < len(left) else []
        out += [("+", right[i])] if i < len(right) else []
    return out + fold([(" ", x) for x in a[len(a) - tail :]], False) if tail else out


def diff_characters(old: str, new: str) -> tuple[str, str, str, str]:
    """Common head, what goes, what comes, common tail of a changed line."""
    n = min(len(old), len(new))
    head = next((i for i in range(n) if old[i] != new[i]), n)
    tail = next((i for i in range(n - head) if old[len(old) - 1 - i] != new[len(new) - 1 - i]), n - head)
    return old[:head], old[head : len(old) - tail], new[head : len(new) - tail], old[len(old) - tail :]


def diff_requests(old: dict, new: dict) -> dict:
    """What changed from one request to the next: messages kept, changed, dropped and added, tools, and other fields."""
    a, b = ([(m.get("role"), message_text(m)) for m in body.get("messages") or [] if isinstance(m, dict)] for body in (old, new))
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]))) if x != y), min(len(a), len(b)) - head)
    left, right = a[head : len(a) - tail], b[head : len(b) - tail]
    changed, dropped, added = 0, 0, 0
    while left and right:
        if left[0][0] == right[0][0]:
            changed += left[0] != right[0]
            left, right = left[1:], right[1:]
        elif len(right) > 1 and right[1][0] == left[0][0]:
            added, right = added + 1, right[1:]
        else:
            dropped, left = dropped + 1, left[1:]
    names = lambda body: [t.get("name") or (t.get("function") or {}).get("name") for t in body.get("tools") or [] if isinstance(t, dict)]
    fields = sorted(k for k in {*old, *new} - {"messages", "system", "tools", "input", "contents"} if json.dumps(_values(old.get(k)), sort_keys=True) != json.dumps(_values(new.get(k)), sort_keys=True))
    return {"kept": head + tail, "changed": changed, "dropped": dropped + len(left), "added": added + len(right), "system_changed": old.get("system") != new.get("system"), "tools_added": [n for n in names(new) if n not in names(old)], "tools_removed": [n for n in names(old) if n not in names(new)], "fields": fields}


DIFF_SCHEMA = "scope string, idx long, parent long, kept int, changed int, dropped int, added int, system_changed boolean, tools_added array<string>, tools_removed array<string>, fields array<string>"


def diff_pairs(pairs: DataFrame) -> DataFrame:
    """diff_requests for rows (scope, idx, parent, old, new) with bodies as JSON text."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [{"scope": r.scope, "idx": r.idx, "parent": r.parent, **diff_requests(parse(r.old) or {}, parse(r.new) or {})} for r in pdf.itertuples()]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DIFF_SCHEMA.split(", ")])

    return pairs.select("scope", "idx", "parent", "old", "new").mapInPandas(run, DIFF_SCHEMA)


def tool_changes(pairs: DataFrame) -> DataFrame:
    """Names added and removed between arrays old_tools and new_tools."""
    return pairs.withColumns({"added": F.array_except("new_tools", "old_tools"), "removed": F.array_except("old_tools", "new_tools")})
