"""One record may carry several responses of a socket, and a response may go on from another: records as single turns
with their whole history.

A turn's history is what its predecessors were asked and answered, oldest first, equal messages once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime, timezone
from typing import Any

from spanmill.functions import record as rec
from spanmill.functions.folds import merge_lists, split_ws_responses

#: Fields of a response that stand for its request's.
CARRIED = ("model", "instructions", "tools", "previous_response_id", "prompt_cache_key", "tool_choice", "parallel_tool_calls", "text", "reasoning")


def flat(event: dict) -> dict:
    """A stream event whose payload may stand under data."""
    data = rec.event_data(event)
    return data if data.get("type") else {**data, "type": rec.event_type(event)}


def response_of(run: list[dict], kind: str) -> dict:
    return next((e["response"] for e in run if e.get("type") == kind and isinstance(e.get("response"), dict)), {})


def outputs(run: list[dict]) -> list[dict]:
    done = sorted((e for e in run if e.get("type") == "response.output_item.done" and isinstance(e.get("item"), dict)), key=lambda e: e.get("output_index") or 0)
    return [e["item"] for e in done] or rec.dicts(response_of(run, "response.completed").get("output"))


def is_prefetch(asked: dict, answered: dict, items: list) -> bool:
    """A turn that was told to generate nothing, and did."""
    return (asked.get("generate") is False or answered.get("generate") is False) and not items and not (rec.dig(answered, "usage", "output_tokens") or 0)


def is_result(item: Any) -> bool:
    return rec.string(rec.dig(item, "type")).endswith(("_call_output", "tool_search_output"))


def request_for(record: dict, runs: list[list[dict]], n: int) -> dict:
    """The request of a record's n-th response: by the response it goes on from, else by order."""
    asked = [flat(e) for e in rec.dicts(rec.dig(record, "request", "ws_events"))]
    before = response_of(runs[n], "response.created").get("previous_response_id") or response_of(runs[n], "response.completed").get("previous_response_id")
    generating = [a for a in asked if a.get("generate") is not False]
    found = next((a for a in asked if before and a.get("previous_response_id") == before), None)
    for pool in (generating, asked):
        found = found or (pool[n] if n < len(pool) else None)
    if found:
        return found
    body = rec.dig(record, "request", "body")
    body = body if isinstance(body, dict) else {}
    only_results = isinstance(body.get("input"), list) and body["input"] and all(map(is_result, body["input"]))
    return {**body, "input": []} if n == 0 and only_results else body


class History:
    """Responses seen so far, each with what it was asked, what it answered and the response it goes on from."""

    def __init__(self):
        self.nodes: dict[str, tuple[str, list, list]] = {}

    def add(self, response_id: str, before: str, asked: Any, answered: list) -> None:
        if response_id:
            self.nodes[response_id] = (before, asked if isinstance(asked, list) else [], answered)

    def up_to(self, response_id: str) -> list:
        chain, seen = [], set()
        while response_id in self.nodes and response_id not in seen:
            seen.add(response_id)
            chain.append(self.nodes[response_id])
            response_id = chain[-1][0]
        return merge_lists([m for _, asked, answered in reversed(chain) for m in (*asked, *answered)], [])


def turns(records: Iterable[dict]) -> list[dict]:
    """Records of one run, in capture order, as displayable turns; records of other kinds pass through."""
    history, out = History(), []
    for record in records:
        runs = split_ws_responses([flat(e) for e in rec.dicts(rec.dig(record, "response", "ws_events"))])
        if "/responses" not in rec.path_of(record) and not runs:
            out.append(record)
        elif runs:
            out += _socket_turns(record, runs, history)
        else:
            out += _direct_turn(record, history)
    return out


def _direct_turn(record: dict, history: History) -> list[dict]:
    body, answer = rec.dig(record, "request", "body"), rec.dig(record, "response", "body")
    if not isinstance(body, dict):
        return [record]
    answer = answer if isinstance(answer, dict) else {}
    before = rec.string(body.get("previous_response_id")) or rec.string(answer.get("previous_response_id"))
    items = rec.dicts(answer.get("output"))
    hidden = is_prefetch(body, answer, items)
    prior = [] if hidden or not before else history.up_to(before)
    if prior:
        body = {**body, "input": merge_lists(prior, body.get("input"))}
        record = {**record, "request": {**record["request"], "body": body}}
    history.add(rec.string(answer.get("id")), before, body.get("input"), rec.item_messages(items))
    return [] if hidden else [record]


def _socket_turns(record: dict, runs: list[list[dict]], history: History) -> list[dict]:
    out = []
    for n, run in enumerate(runs):
        created, completed = response_of(run, "response.created"), response_of(run, "response.completed")
        items, asked = outputs(run), request_for(record, runs, n)
        before = rec.string(created.get("previous_response_id")) or rec.string(completed.get("previous_response_id"))
        prior = history.up_to(before) if before else []
        if not prior and n:  # responses of one socket without links: everything before in this record
            prior = merge_lists([m for k in range(n) for m in (*(request_for(record, runs, k).get("input") or []), *rec.item_messages(outputs(runs[k])))], [])
        body = {**asked, **{k: v for k in CARRIED if (v := (completed or created).get(k)) is not None}}
        body["input"] = merge_lists(prior, asked.get("input"))
        history.add(rec.string(completed.get("id")) or rec.string(created.get("id")), before, body["input"], rec.item_messages(items))
        if is_prefetch(created, completed, items):
            continue
        start, end = completed.get("created_at") or created.get("created_at"), completed.get("completed_at")
        several = len(runs) > 1
        turn = {**record, "request": {**(record.get("request") or {}), "body": body}, "response": {**(record.get("response") or {}), "body": completed, "ws_events": run}, "derived": several}
        if several:
            turn |= {"request_id": f"{record.get('request_id') or 'ws'}:{n + 1}", "turn": f"{record.get('turn') or '?'}.{n + 1}"}
        if start and end:
            turn["duration_ms"] = max(0, int((end - start) * 1000))
        if start:
            turn["timestamp"] = datetime.fromtimestamp(start, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        out.append(turn)
    return out


def expand(payloads: Iterable[str | None]) -> list[str]:
    """turns() from and to JSON text; unreadable payloads are left out."""
    read = [r for p in payloads if isinstance(r := rec.parse(p), dict)]
    return [json.dumps(t, ensure_ascii=False, separators=(",", ":")) for t in turns(read)]
