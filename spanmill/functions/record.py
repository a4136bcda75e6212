"""Reading one trace record, whatever the dialect of its bodies: provider, model, usage, texts, tools, outputs.

Plain functions over parsed JSON. They never raise on odd input: what is not of the expected kind counts as absent.
DataFrames reach them through functions.records (one Arrow pass for each table).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from typing import Any
from urllib.parse import unquote, urlsplit

from spanmill.functions.usage import merge_peak, normalize

JSON_DECODER = json.JSONDecoder()

#: Display names of known clients, and what in host, path or upstream gives one away, in order.
CLIENT_LABELS = {"claude": "Claude Code", "claude-code": "Claude Code", "codex": "Codex", "codexapp": "Codex App", "gemini": "Gemini", "kimi": "Kimi", "cursor": "Cursor", "qoder": "Qoder", "opencode": "OpenCode", "hermes": "Hermes", "antigravity": "Antigravity"}
SIGNALS = (
    (("antigravity", "codeium", "v1internal:streamgeneratecontent"), "Antigravity"),
    (("generativelanguage.googleapis.com", "streamgeneratecontent", "generatecontent"), "Gemini"),
    (("chatgpt.com/backend-api/codex", "/responses"), "Codex"),
    (("api.anthropic.com", "/v1/messages"), "Claude Code"),
    (("kimi", "moonshot"), "Kimi"),
    (("cursor",), "Cursor"),
    (("qoder",), "Qoder"),
    (("opencode",), "OpenCode"),
    (("mimo",), "MiMo Code"),
    (("hermes",), "Hermes"),
)
#: Tags and beginnings of texts that a harness put in a user's place.
INJECTED_TAGS = frozenset("artifacts additional_metadata environment_context session_context skills slash_commands subagents system-reminder user_information".split())
DROPPED_TAGS = frozenset("artifacts codex_internal_context environment_context local-command-caveat session_context skills slash_commands subagents system-reminder user_information".split())
DROPPED_STARTS = ("<system-reminder", "<command-message", "<local-command", "# AGENTS.md instructions", "<INSTRUCTIONS>", "# Files mentioned by the user:")
DROPPED_FORMS = re.compile(r"</?image(?:_input)?(?:\s+[^>]*)?>$|\[suggestion mode:|(?:web page content|page content|网页内容)\s*[:：]|\[image:\s*source:", re.I)
EXCEPTIONS = ("internalServerException", "modelStreamErrorException", "modelTimeoutException", "serviceUnavailableException", "throttlingException", "validationException")
TEXT_KEYS = ("text", "content", "output_text", "input_text")
MIN_ASSISTANT_CHARS = 20


def dig(value: Any, *path: str | int) -> Any:
    """value[path[0]][path[1]]..., or None where a step does not exist."""
    for step in path:
        if isinstance(value, dict) and isinstance(step, str):
            value = value.get(step)
        elif isinstance(value, list) and isinstance(step, int) and -len(value) <= step < len(value):
            value = value[step]
        else:
            return None
    return value


def dicts(value: Any) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def string(value: Any) -> str:
    return value if isinstance(value, str) else ""


def first_flag(*values: Any) -> bool | None:
    """The first value that is true or false itself, not something that merely counts as such."""
    return next((v for v in values if isinstance(v, bool)), None)


def parse(text: Any) -> Any:
    """The JSON value of a text, None if it is none."""
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def request_body(record: dict) -> dict:
    """The richest request object: the body, or one of the client's stream messages; the first among equals."""
    bodies = [b for b in (dig(record, "request", "body"), *dicts(dig(record, "request", "ws_events"))) if isinstance(b, dict)]
    return max(bodies, key=prompt_weight, default={})


def prompt_weight(body: dict) -> int:
    weights = {"tools": 10, "instructions": 8, "system": 8, "systemInstruction": 8, "messages": 6, "input": 6, "contents": 6, "prompt": 4, "model": 1}
    weight = sum(w for key, w in weights.items() if body.get(key))
    inner = body.get("request")
    return weight + (prompt_weight(inner) if isinstance(inner, dict) else 0)


def unwrap(body: dict) -> dict:
    """Some gateways put the body in a "request" field."""
    inner = body.get("request")
    return inner if isinstance(inner, dict) and not any(k in body for k in ("messages", "input", "contents")) else body


def path_of(record: dict) -> str:
    return string(dig(record, "request", "path"))


def host_of(record: dict) -> str:
    headers = dig(record, "request", "headers")
    for key in ("Host", "host"):
        if isinstance(dig(headers, key), str):
            return headers[key]
    try:
        return urlsplit(string(record.get("upstream_base_url"))).netloc
    except ValueError:
        return ""


def provider(record: dict) -> str:
    """anthropic, openai, gemini or unknown: by path, then by the keys of the body."""
    path, body = path_of(record).lower(), unwrap(request_body(record))
    by_path = (("/v1/messages", "anthropic"), ("/chat/completions", "openai"), ("/responses", "openai"), ("generatecontent", "gemini"), ("/converse", "anthropic"), ("/invoke", "anthropic"))
    looks_gemini = any(k in body for k in ("contents", "systemInstruction", "generationConfig"))
    if "/v1internal" in path and looks_gemini:
        return "gemini"
    for part, name in by_path:
        if part in path and "/v1internal" not in path:
            return name
    if looks_gemini:
        return "gemini"
    if any(k in body for k in ("input", "instructions", "previous_response_id")):
        return "openai"
    if "system" in body or any(isinstance(t.get("input_schema"), dict) for t in dicts(body.get("tools"))) or "anthropic_version" in body:
        return "anthropic"
    if "messages" in body:
        return "openai" if any(dig(t, "type") == "function" for t in dicts(body.get("tools"))) or any(m.get("role") == "system" for m in dicts(body["messages"])) else "anthropic"
    return "unknown"


# Texts


def plain_text(value: Any) -> str:
    """The visible text of a content value of any nesting."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        found = []
        for item in value:
            if isinstance(item, dict):
                inner = next((item[k] for k in TEXT_KEYS if isinstance(item.get(k), (str, list))), None)
                found.append(plain_text(inner))
            else:
                found.append(string(item))
        return "\n".join(filter(None, found)).strip()
    if isinstance(value, dict):
        inner = next((value[k] for k in TEXT_KEYS if isinstance(value.get(k), (str, list, dict))), None)
        return plain_text(inner)
    return ""


def parts_text(parts: Any) -> str:
    return "\n".join(p["text"] for p in dicts(parts) if isinstance(p.get("text"), str)).strip()


def clean_prompt(text: str, viewer: bool = False) -> str:
    """What the user typed, without what a harness wrapped around it; viewer: also without its image and request marks."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        inner = parse(text)
        if isinstance(inner, str) and inner:
            text = inner.strip()
    wrapped = re.search(r"(?is)<USER_REQUEST>\s*(.*?)\s*</USER_REQUEST>", text) or re.fullmatch(r"(?is)<session>\s*(.*?)\s*</session>", text)
    if wrapped:
        return wrapped[1].strip()
    if viewer:
        text = re.sub(r"(?i)\[image #\d+\]", "", text).strip()
        head = re.search(r"(?im)^## My request for [^:\n]*:\s*$", text)
        if head:
            text = text[head.end() :].strip()
        if DROPPED_FORMS.match(text):
            return ""
    tag = re.match(r"<([A-Za-z_-]+)>", text)
    if tag and tag[1].lower() in (INJECTED_TAGS | DROPPED_TAGS if viewer else INJECTED_TAGS):
        return ""
    return "" if text.startswith(("# AGENTS.md instructions", "<INSTRUCTIONS>")) else text


def is_tool_result(value: Any) -> bool:
    return isinstance(value, dict) and string(value.get("type")).lower() in ("tool_result", "function_call_output")


def clean_content(value: Any, viewer: bool = False) -> str:
    if not isinstance(value, list):
        return "" if is_tool_result(value) else clean_prompt(plain_text(value), viewer)
    kept = []
    for item in value:
        raw = "" if is_tool_result(item) else plain_text(item)
        text = clean_prompt(raw, viewer)
        if text and re.search(r"(?is)<USER_REQUEST>.*?</USER_REQUEST>", raw):
            return text
        kept += [text] if text else []
    return "\n".join(kept).strip()


def user_turns(body: dict, viewer: bool = False) -> Iterator[str]:
    """Cleaned texts of the user's turns in the order in which a body's places are looked at; empty ones left out."""
    for m in dicts(body.get("messages")):
        if string(m.get("role")).lower() == "user":
            yield clean_content(m.get("content"), viewer)
    given = body.get("input")
    if isinstance(given, str):
        yield clean_prompt(given, viewer)
    items = [given] if isinstance(given, dict) else dicts(given)
    for item in items:
        if string(item.get("role")).lower() == "user":
            yield clean_content(item.get("content") or item.get("text"), viewer)
    for item in items if isinstance(given, list) else ():
        kind = string(item.get("type")).lower()
        if not item.get("role") and kind not in ("function_call_output", "tool_result", "reasoning") and (kind in ("message", "input_text") or "content" in item):
            yield clean_content(item.get("content") or item.get("text"), viewer)
    inner = body.get("request")
    for c in dicts((inner if isinstance(inner, dict) else body).get("contents")):
        if string(c.get("role") or "user").lower() == "user":
            yield clean_content(c.get("parts"), viewer)
    if isinstance(body.get("prompt"), str):
        yield clean_prompt(body["prompt"], viewer)


def first_user_text(body: Any) -> str:
    if isinstance(body, str):
        return body
    return next(filter(None, user_turns(body)), "") if isinstance(body, dict) else ""


def latest_user_text(record: dict) -> str:
    found = [t for t in user_turns(request_body(record), viewer=True) if t]
    return found[-1] if found else ""


def response_text(body: Any) -> str:
    """The visible answer, from the first place that has one."""
    if isinstance(body, str):
        return body
    if not isinstance(body, dict):
        return ""
    places = (
        lambda: plain_text(body.get("content")),
        lambda: "\n".join(filter(None, (parts_text(dig(c, "content", "parts")) for c in dicts(body.get("candidates"))))).strip(),
        lambda: "\n".join(filter(None, (plain_text(dig(c.get("message") or c.get("delta"), "content")) for c in dicts(body.get("choices"))))).strip(),
        lambda: plain_text(dig(body, "output", "message", "content")),
        lambda: plain_text(body.get("output")),
        lambda: plain_text(body.get("response")),
    )
    return next(filter(None, (place() for place in places)), "")


def events(record: dict) -> list[dict]:
    return dicts(dig(record, "response", "sse_events")) or dicts(dig(record, "response", "ws_events"))


def event_payload(event: dict) -> dict:
    data = event.get("data", event)
    data = parse(data) if isinstance(data, str) else data
    if not isinstance(data, dict):
        return {}
    return data["response"] if isinstance(data.get("response"), dict) else data


def event_type(event: dict) -> str:
    return string(event.get("event")) or string(event.get("type")) or string(dig(event, "data", "type"))


def last_payload(record: dict, kind: str) -> dict:
    return next((event_payload(e) for e in reversed(events(record)) if event_type(e) == kind), {})


def record_response_text(record: dict) -> str:
    text = response_text(dig(record, "response", "body"))
    for event in reversed([] if text else events(record)):
        text = response_text(event_payload(event)) or plain_text(event.get("item")) or plain_text(event.get("part")) or string(event.get("text"))
        if text:
            break
    return text


# Stored event streams of the binary kind


def eventstream(body: Any) -> list[dict]:
    """Events in the text of a binary event stream: its JSON objects, with base64 parts opened and named as the messages API does."""
    if not isinstance(body, str) or '{"' not in body:
        return []
    found, at = [], body.find('{"')
    while at >= 0:
        try:
            value, at_end = JSON_DECODER.raw_decode(body, at)
        except ValueError:
            at = body.find('{"', at + 2)
            continue
        found += _opened(value)
        at = body.find('{"', at_end)
    return found


def _opened(value: Any) -> list[dict]:
    packed = dig(value, "bytes") or dig(value, "chunk", "bytes")
    if isinstance(packed, str):
        try:
            inner = parse(base64.b64decode(packed))
        except ValueError:
            return []
        return [{"event": string(inner.get("type")), "data": inner}] if isinstance(inner, dict) else []
    return [{"event": name, "data": data} for name, data in _messages_names(value)] if isinstance(value, dict) else []


def _messages_names(value: dict) -> list[tuple[str, dict]]:
    index = value.get("contentBlockIndex", 0)
    if isinstance(value.get("type"), str):
        return [(value["type"], value)]
    if any(k in value for k in EXCEPTIONS):
        return [("error", {"type": k, **(v if isinstance(v, dict) else {"message": v})}) for k, v in value.items() if k in EXCEPTIONS]
    if "role" in value:
        return [("message_start", {"type": "message_start", "message": {"role": value["role"], "content": []}})]
    if isinstance(value.get("start"), dict):
        use = dig(value, "start", "toolUse") or {}
        return [("content_block_start", {"type": "content_block_start", "index": index, "content_block": {"type": "tool_use", "id": string(dig(use, "toolUseId")), "name": string(dig(use, "name")), "input": {}}})]
    if isinstance(value.get("delta"), dict):
        d = value["delta"]
        if isinstance(d.get("text"), str):
            delta = {"type": "text_delta", "text": d["text"]}
        elif isinstance(d.get("toolUse"), dict):
            delta = {"type": "input_json_delta", "partial_json": string(d["toolUse"].get("input"))}
        elif isinstance(d.get("reasoningContent"), dict):
            delta = {"type": "thinking_delta", "thinking": string(d["reasoningContent"].get("text")), "signature": string(d["reasoningContent"].get("signature"))}
        else:
            delta = d
        return [("content_block_delta", {"type": "content_block_delta", "index": index, "delta": delta})]
    if "stopReason" in value:
        return [("message_delta", {"type": "message_delta", "delta": {"stop_reason": value["stopReason"]}})]
    if "usage" in value:
        return [("message_delta", {"type": "message_delta", "delta": {}, "usage": value["usage"]})]
    if "contentBlockIndex" in value:
        return [("content_block_stop", {"type": "content_block_stop", "index": index})]
    return []


def stream_errors(body: Any) -> list[dict]:
    return [e["data"] for e in eventstream(body) if e["event"] == "error"]


# Model, usage, errors, agent


def model(record: dict) -> str:
    body = dig(record, "request", "body")
    named = [dig(body, "model"), dig(body, "modelId"), dig(body, "request", "model"), dig(record, "response", "body", "model")]
    named += [dig(e, "data", "message", "model") for e in eventstream(dig(record, "response", "body"))[:3]]
    found = next((n for n in named if isinstance(n, str) and n), "")
    if found:
        return found
    path = path_of(record)
    for pattern in (r"/model/(.+)/(?:invoke|converse)", r"/models?/([^:?/]+)"):
        m = re.search(pattern, path)
        if m:
            return unquote(m[1])
    return ""


def usage(record: dict) -> dict:
    body = dig(record, "response", "body")
    found = dig(body, "usage") or dig(body, "usageMetadata")
    if not found:
        found = next((u for e in reversed(events(record)) if (u := event_payload(e).get("usage"))), None)
    if not found:
        stream = [e["data"] for e in eventstream(body)]
        found = merge_peak([dig(d, *p) for d in stream for p in (("usage",), ("message", "usage"))])
    return normalize(found or body)


def error_text(record: dict) -> str:
    places = (dig(record, "response", "error"), dig(record, "response", "body", "error"), dig(record, "response", "body", "error", "message"))
    return next((p for p in places if isinstance(p, str) and p), "")


def agent(record: dict, client: str = "") -> str:
    client = client or string(dig(record, "capture", "client"))
    if client:
        return CLIENT_LABELS.get(client.lower(), client)
    signal = " ".join((host_of(record), path_of(record), string(record.get("upstream_base_url")))).lower()
    return next((label for parts, label in SIGNALS if any(p in signal for p in parts)), "Unknown")


# Prompts and tools


def _role_texts(messages: Any, roles: tuple[str, ...]) -> str:
    return "\n\n".join(filter(None, (plain_text(m.get("content")).strip() for m in dicts(messages) if m.get("role") in roles)))


def prompts(record: dict) -> tuple[str, str, str]:
    """System, developer and user text of a request."""
    body, who = unwrap(request_body(record)), provider(record)
    if who == "gemini":
        user = "\n\n".join(filter(None, (parts_text(c.get("parts")) for c in dicts(body.get("contents")) if (c.get("role") or "user") == "user")))
        return parts_text(dig(body.get("systemInstruction") or body.get("system_instruction"), "parts")), "", user
    if who == "openai":
        given = body.get("input")
        system = "\n\n".join(filter(None, (string(body.get("instructions")).strip(), _role_texts(body.get("messages"), ("system",)), _role_texts(given, ("system",)))))
        developer = "\n\n".join(filter(None, (_role_texts(body.get("messages"), ("developer",)), _role_texts(given, ("developer",)))))
        user = "\n\n".join(filter(None, (_role_texts(body.get("messages"), ("user",)), given.strip() if isinstance(given, str) else _role_texts(given, ("user",)))))
        return system, developer, user
    return plain_text(body.get("system")), "", _role_texts(body.get("messages"), ("user",))


def tools(record: dict) -> list[dict]:
    """name, description and schema of every tool offered, whatever the dialect."""
    body = unwrap(request_body(record))
    found = []
    for tool in dicts(body.get("tools")) + dicts(dig(body, "toolConfig", "tools")):
        declared = tool.get("functionDeclarations") or tool.get("function_declarations")
        for t in dicts(declared) if declared else [tool.get("function") if isinstance(tool.get("function"), dict) else tool.get("toolSpec") if isinstance(tool.get("toolSpec"), dict) else tool]:
            schema = next((t[k] for k in ("input_schema", "parameters", "parametersJsonSchema", "inputSchema") if isinstance(t.get(k), dict)), {})
            schema = schema["json"] if isinstance(schema.get("json"), dict) else schema
            name = string(t.get("name")) or string(t.get("type")) or (next(iter(t), "") if declared is None else "")
            if name:
                found.append({"name": name, "description": string(t.get("description")), "schema": schema})
    return found


def parameter_names(schema: Any) -> list[str]:
    for place in (("input_schema", "properties"), ("parameters", "properties"), ("properties",)):
        found = dig(schema, *place)
        if isinstance(found, dict):
            return sorted(map(str, found))
    return []


def snapshot_score(record: dict) -> int:
    """How well a record shows the prompt of its session: tools weigh most, a probe of the model list rules itself out."""
    system, developer, user = prompts(record)
    probe = re.fullmatch(r"/(?:v1(?:alpha|beta)?/)?models(?:/[^/:]+)?/?", path_of(record).split("?")[0].lower())
    return 10 * len(tools(record)) + 100 * bool(system) + 60 * bool(developer) + 20 * bool(user) - 200 * bool(probe)


# Messages worth indexing


def keep_message(text: str) -> bool:
    text = text.strip()
    tag = re.match(r"<([A-Za-z_-]+)", text)
    return bool(text) and not (text.startswith(DROPPED_STARTS) or (tag and tag[1].lower() in DROPPED_TAGS) or DROPPED_FORMS.match(text))


def _joined(texts: Iterable[Any]) -> str:
    return "\n\n".join(t.strip() for t in texts if isinstance(t, str) and t.strip())


def user_messages(record: dict) -> list[str]:
    body, who = unwrap(request_body(record)), provider(record)
    found: list[str] = []
    if who == "anthropic":
        for m in dicts(body.get("messages")):
            if m.get("role") == "user":
                c = m.get("content")
                found.append(_joined(b.get("text") for b in dicts(c) if b.get("type") == "text") if isinstance(c, list) else plain_text(c))
    elif who == "openai":
        found += [plain_text(m.get("content")) for m in dicts(body.get("messages")) if m.get("role") == "user"]
        given = body.get("input")
        found += [given] if isinstance(given, str) else [plain_text(i.get("content")) for i in dicts(given) if i.get("type") in (None, "message") and i.get("role") in (None, "user")]
        found += [string(body.get("prompt"))]
    elif who == "gemini":
        found += [_joined(p.get("text") for p in dicts(c.get("parts"))) for c in dicts(body.get("contents")) if (c.get("role") or "user") == "user"]
    return [t.strip() for t in found if keep_message(t)]


def assistant_message(record: dict) -> str:
    body, who = dig(record, "response", "body"), provider(record)
    if who == "anthropic":
        text = _joined(b.get("text") for b in dicts(dig(body, "content")) if b.get("type") == "text")
    elif who == "openai":
        texts = [plain_text(dig(c, "message", "content")) for c in dicts(dig(body, "choices"))]
        for item in dicts(dig(body, "output")):
            if item.get("type") == "message":
                c = item.get("content")
                texts += [c] if isinstance(c, str) else [p.get("text") for p in dicts(c) if p.get("type") == "output_text"]
        text = _joined(texts)
    elif who == "gemini":
        text = _joined(p.get("text") for c in dicts(dig(body, "candidates")) for p in dicts(dig(c, "content", "parts")) if not p.get("thought"))
    else:
        text = ""
    return text if len(text) >= MIN_ASSISTANT_CHARS else ""


# Unified messages and outputs, for reading and for comparing


def _arguments(value: Any) -> Any:
    parsed = parse(value) if isinstance(value, str) else value
    return value if parsed is None else parsed


def _gemini_blocks(part: dict) -> list[dict]:
    if isinstance(part.get("functionCall"), dict):
        c = part["functionCall"]
        return [{"type": "tool_use", "id": string(c.get("id")), "name": string(c.get("name")) or "tool_use", "input": c.get("args") if isinstance(c.get("args"), dict) else {}}]
    if isinstance(part.get("functionResponse"), dict):
        r = part["functionResponse"]
        return [{"type": "tool_result", "tool_use_id": string(r.get("id")), "content": json.dumps(r.get("response"), ensure_ascii=False, separators=(",", ":"))}]
    if isinstance(part.get("text"), str):
        return [{"type": "thinking", "thinking": part["text"]} if part.get("thought") else {"type": "text", "text": part["text"]}]
    return []


def item_messages(items: Any) -> list[dict]:
    """Messages of a list of response items: calls are the assistant's, their outputs a tool's."""
    out = []
    for item in dicts(items):
        kind = string(item.get("type"))
        if kind.endswith("_call_output") or kind == "tool_search_output":
            out.append({"role": "tool", "content": [{"type": "tool_result", "tool_use_id": string(item.get("call_id")), "content": item.get("output")}]})
        elif kind.endswith("_call"):
            out.append({"role": "assistant", "content": [{"type": "tool_use", "id": string(item.get("call_id") or item.get("id")), "name": string(item.get("name")) or kind, "input": _arguments(item.get("arguments", item.get("input")))}]})
        elif kind in ("", "message") and item.get("role"):
            out.append({"role": item["role"], "content": item.get("content")})
    return out


def messages(record: dict, with_system: bool = False) -> list[dict]:
    """role and content of every message of a request, system messages aside unless asked for."""
    body = unwrap(request_body(record))
    out: list[dict] = []
    if isinstance(body.get("messages"), list):
        for m in dicts(body["messages"]):
            content = m.get("content")
            if m.get("role") == "tool":
                content = [{"type": "tool_result", "tool_use_id": string(m.get("tool_call_id")), "content": content}]
            calls = [{"type": "tool_use", "id": string(c.get("id")), "name": string(dig(c, "function", "name")), "input": _arguments(dig(c, "function", "arguments"))} for c in dicts(m.get("tool_calls"))]
            if calls:
                text = [{"type": "text", "text": content}] if isinstance(content, str) and content else content if isinstance(content, list) else []
                content = [*text, *calls]
            if content or m.get("role") in ("user", "assistant"):
                out.append({"role": m.get("role"), "content": content})
    elif isinstance(body.get("contents"), list):
        for c in dicts(body["contents"]):
            blocks = [b for p in dicts(c.get("parts")) for b in _gemini_blocks(p)]
            role = "tool" if blocks and all(b["type"] == "tool_result" for b in blocks) else "assistant" if c.get("role") == "model" else c.get("role") or "user"
            out.append({"role": role, "content": blocks})
    elif isinstance(body.get("input"), str):
        out.append({"role": "user", "content": body["input"]})
    else:
        out += item_messages(body.get("input"))
        if body.get("instructions") and any(m["role"] == "user" for m in out) and not any(m["role"] in ("system", "developer") for m in out):
            out.insert(0, {"role": "developer", "content": body["instructions"]})
    return out if with_system else [m for m in out if m["role"] not in ("system",)]


def join_adjacent(blocks: list[dict]) -> list[dict]:
    """Runs of text blocks, and of thinking blocks, become one each."""
    out: list[dict] = []
    for block in blocks:
        kind = block.get("type")
        if kind in ("text", "thinking") and out and out[-1].get("type") == kind:
            out[-1] = {**out[-1], kind: string(out[-1].get(kind)) + string(block.get(kind))}
        else:
            out.append(block)
    return out


def output_blocks(record: dict) -> list[dict]:
    """Content blocks of the answer, from the first place that has some."""
    body = dig(record, "response", "body")
    body = body if isinstance(body, dict) else {}
    found = join_adjacent([b for c in dicts(body.get("candidates")) for p in dicts(dig(c, "content", "parts")) for b in _gemini_blocks(p)])
    if found or isinstance(body.get("content"), list):
        return found or dicts(body["content"])
    for b in dicts(dig(body, "output", "message", "content")):
        if isinstance(b.get("toolUse"), dict):
            found.append({"type": "tool_use", "id": string(b["toolUse"].get("toolUseId")), "name": string(b["toolUse"].get("name")), "input": b["toolUse"].get("input")})
        elif isinstance(b.get("reasoningContent"), dict):
            inner = b["reasoningContent"].get("reasoningText") or b["reasoningContent"]
            found.append({"type": "thinking", "thinking": string(dig(inner, "text")), "signature": string(dig(inner, "signature"))})
        elif isinstance(b.get("text"), str):
            found.append({"type": "text", "text": b["text"]})
    if found:
        return join_adjacent(found)
    for c in dicts(body.get("choices")):
        m = c.get("message") or c.get("delta") or {}
        details = "\n\n".join(d["text"] for d in dicts(dig(m, "reasoning_details")) if isinstance(d.get("text"), str))
        thinking = next((t for t in (details, *[string(dig(m, k)) for k in ("reasoning_content", "reasoning", "thinking")]) if t), "")
        found += [{"type": "thinking", "thinking": thinking}] if thinking else []
        found += [{"type": "text", "text": t}] if (t := plain_text(dig(m, "content"))) else []
        found += [{"type": "tool_use", "id": string(t.get("id")), "name": string(dig(t, "function", "name")), "input": _arguments(dig(t, "function", "arguments"))} for t in dicts(dig(m, "tool_calls"))]
    if found:
        return found
    items = dicts(body.get("output"))
    if not items:
        done = [e for e in map(event_data, events(record)) if e.get("type") == "response.output_item.done"]
        items = [e["item"] for e in sorted(done, key=lambda e: e.get("output_index") or 0) if isinstance(e.get("item"), dict)] or dicts(last_payload(record, "response.completed").get("output"))
    for item in items:
        if item.get("type") == "reasoning":
            found += [{"type": "thinking", "thinking": t}] if (t := plain_text(item.get("summary"))) else []
        elif item.get("type") == "message":
            found += [{"type": "text", "text": t}] if (t := plain_text(item.get("content"))) else []
        else:
            found += [b for m in item_messages([item]) for b in m["content"]]
    return found


def event_data(event: dict) -> dict:
    data = event.get("data", event)
    data = parse(data) if isinstance(data, str) else data
    return data if isinstance(data, dict) else {}


def displayable(block: dict) -> bool:
    kind = block.get("type")
    if kind in ("text", "thinking"):
        return bool(string(block.get(kind)).strip())
    if kind == "tool_result":
        return bool(block.get("content") or block.get("tool_use_id"))
    return kind == "tool_use" or (kind == "image" and bool(block.get("source")))


def tool_names(record: dict) -> list[str]:
    """Names of the tools that the answer calls, in order, each once."""
    return list(dict.fromkeys(b["name"] for b in output_blocks(record) if b.get("type") == "tool_use" and b.get("name")))


def message_text(message: dict) -> str:
    """A message as one text: what counts when messages are compared."""
    content = message.get("content")
    if not isinstance(content, list):
        return plain_text(content)
    out = []
    for b in dicts(content):
        kind = b.get("type")
        if kind == "thinking":
            out.append("[thinking] " + string(b.get("thinking")))
        elif kind == "tool_use":
            out.append(f"[tool_use: {string(b.get('name'))}] " + json.dumps(b.get("input"), ensure_ascii=False, sort_keys=True))
        elif kind == "tool_result":
            out.append("[tool_result] " + (plain_text(b.get("content")) or json.dumps(b.get("content"), ensure_ascii=False)))
        else:
            out.append(plain_text(b))
    return "\n".join(filter(None, out))


def _without_cache_marks(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _without_cache_marks(v) for k, v in value.items() if k != "cache_control"}
    return [_without_cache_marks(v) for v in value] if isinstance(value, list) else value


def fingerprint(message: dict) -> str:
    """The role and a digest of the whole content, marks for caches aside; texts of any length count to their end."""
    content = _without_cache_marks(message.get("content"))
    text = content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, separators=(",", ":"))
    return f"{message.get('role')}:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def thread_key(record: dict) -> str:
    """session:thread from metadata that is JSON in JSON; empty if there is none."""
    meta = dig(unwrap(request_body(record)), "client_metadata") or dig(unwrap(request_body(record)), "metadata")
    for value in (meta.values() if isinstance(meta, dict) else ()):
        inner = parse(value) if isinstance(value, str) else value
        session, thread = dig(inner, "session_id"), dig(inner, "thread_id")
        if session and thread:
            return f"{session}:{thread}"
    return ""


def images(value: Any) -> list[str]:
    """Sources of the images anywhere in a content value: links, or data as data: URIs."""
    found: list[str] = []
    todo = [value]
    while todo:
        v = todo.pop(0)
        if isinstance(v, list):
            todo = v + todo
        elif isinstance(v, dict):
            source = v.get("source") if v.get("type") == "image" else None
            if isinstance(dig(source, "data"), str):
                found.append(f"data:{source.get('media_type') or 'image/png'};base64,{source['data']}")
            elif isinstance(dig(source, "url"), str):
                found.append(source["url"])
            url = dig(v, "image_url", "url") or v.get("image_url")
            if isinstance(url, str):
                found.append(url)
            if isinstance(dig(v, "inlineData", "data"), str):
                found.append(f"data:{v['inlineData'].get('mimeType') or 'image/png'};base64,{v['inlineData']['data']}")
            todo = [x for k, x in v.items() if k in ("content", "parts", "output") and isinstance(x, (list, dict))] + todo
    return list(dict.fromkeys(found))


def user_input(record: dict, last: bool = True) -> tuple[str, int, int]:
    """Text and place of the last (or first) message that a user typed, and the number of messages; ('', -1, n) if there is none."""
    said = messages(record)
    order = range(len(said) - 1, -1, -1) if last else range(len(said))
    found = ((clean_content(said[i].get("content"), viewer=True), i) for i in order if said[i].get("role") == "user")
    text, at = next(((t, i) for t, i in found if t), ("", -1))
    return text, at, len(said)


def app_session(record: dict) -> str:
    """The desktop app's session id, from metadata or a header."""
    body = unwrap(request_body(record))
    named = [dig(body, "metadata", "codex_app_session_id"), *[v for k, v in (dig(record, "request", "headers") or {}).items() if k.lower() in ("x-codex-app-session-id", "codex-app-session-id")]]
    return next((n for n in named if isinstance(n, str) and n), "")


def prompt_in_payload(text: str) -> str:
    """A prompt that is itself JSON with the text under a usual key."""
    inner = parse(text) if text.lstrip()[:1] == "{" else None
    return next((inner[k].strip() for k in ("prompt", "request", "instruction", "message", "query", "text", "title") if isinstance(dig(inner, k), str) and inner[k].strip()), text)


def unique_tools(found: list[dict]) -> list[dict]:
    """Tools by name, the first of each."""
    out: dict[str, dict] = {}
    for t in found:
        out.setdefault(t["name"], t)
    return list(out.values())


def display_name(tool: Any) -> str:
    return next((n for n in (dig(tool, "name"), dig(tool, "function", "name"), dig(tool, "id"), dig(tool, "type")) if isinstance(n, str) and n), "")


def embedder_identity(name: str) -> str:
    """org/name of an embedding model given by name or by its folder in a model cache."""
    m = re.search(r"models--([^/\\]+?)--([^/\\]+)", name)
    return f"{m[1]}/{m[2]}" if m else name
