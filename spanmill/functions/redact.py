"""Redaction of credentials by key, in documents, JSON texts, links and forms."""

from __future__ import annotations

import json
import re
from typing import Any
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

MARK = "[REDACTED]"
#: Keys, without separators and case, whose values go.
SENSITIVE = ("accesstoken", "apikey", "authorization", "authtoken", "bearertoken", "clientsecret", "cookie", "credential", "credentials", "idtoken", "password", "passwd", "privatekey", "refreshtoken", "secret", "sessiontoken", "setcookie", "token", "xapikey")
HOP_BY_HOP = frozenset("connection keep-alive proxy-authenticate proxy-authorization te trailers transfer-encoding upgrade".split())
MAX_DEPTH = 8
_FORM_KEY = re.compile(r"[A-Za-z0-9_.\-\[\]]+")


def bare(key: str) -> str:
    return re.sub(r"[^a-z0-9]", "", key.lower())


def is_sensitive(key: str) -> bool:
    return bare(key) in SENSITIVE or bare(key).endswith(("token", "secret", "password"))


def redact(value: Any, key: str = "", depth: int = 0) -> Any:
    """value with the values of sensitive keys marked at any depth; nulls stay, other kinds stay as they are."""
    if key and is_sensitive(key):
        return None if value is None else MARK
    if isinstance(value, dict):
        return {k: redact(v, str(k), depth) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v, "", depth) for v in value]
    return redact_text(value, depth) if isinstance(value, str) else value


def redact_text(text: str, depth: int = 0) -> str:
    """A text that is JSON, a link or a form, with its sensitive values marked; any other text unchanged."""
    head = text.strip()[:1]
    if not head or depth > MAX_DEPTH:
        return text
    if head in "{[":
        try:
            parsed = json.loads(text)
        except ValueError:
            parsed = None
        if parsed is not None and (clean := redact(parsed, depth=depth + 1)) != parsed:
            return json.dumps(clean, ensure_ascii=False, separators=(",", ":"))
    for attempt in (_link, _form):
        if (found := attempt(text, depth)) is not None:
            return found
    return text


def _pairs(query: str, depth: int, check=None) -> str | None:
    pairs = parse_qsl(query, keep_blank_values=True)
    if not pairs or (check and not all(check(k) for k, _ in pairs)):
        return None
    clean = [(k, MARK if is_sensitive(k) else _nested(v, depth)) for k, v in pairs]
    return None if clean == pairs else urlencode(clean)


def _nested(value: str, depth: int) -> str:
    flat = bare(value)
    hint = any(s in flat for s in (*SENSITIVE, "token", "secret", "password"))
    return redact_text(value, depth + 1) if hint and depth < MAX_DEPTH else value


def _link(text: str, depth: int) -> str | None:
    if "?" not in text:
        return None
    try:
        u = urlsplit(text)
    except ValueError:
        return None
    if not u.query or not (u.scheme or u.netloc or text[0] in "/?" or ("/" in u.path and "=" not in u.path)):
        return None
    query = _pairs(u.query, depth)
    return None if query is None else urlunsplit(u._replace(query=query))


def _form(text: str, depth: int) -> str | None:
    return _pairs(text, depth, lambda k: bool(_FORM_KEY.fullmatch(k))) if "=" in text else None


def headers(given: dict | None) -> dict:
    """Headers as stored: connection headers go, keys are cut to twelve characters, other secrets to a mark."""
    out = {}
    for k, v in (given or {}).items():
        name = k.lower()
        if name in HOP_BY_HOP:
            continue
        if name in ("authorization", "x-api-key"):
            out[k] = v[:12] + "..." if isinstance(v, str) and len(v) > 12 else "***"
        else:
            out[k] = "***" if is_sensitive(name) else v
    return out
