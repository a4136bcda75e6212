"""Prompts in sections, messages in pieces, and the hashes that tell versions apart."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from spanmill.functions.record import parameter_names

#: Fixed values.
MAX_CHARS, MIN_CHARS = 2000, 200
BOILERPLATE = frozenset({"environment", "context management", "harness", "session-specific guidance"})
PARAMETER_LABEL = "参数: "
HEADING = re.compile(r"(#{1,6})\s+(.*)")


def sections(text: str) -> list[tuple[str, str]]:
    """(title, body) at Markdown headings; what stands before the first has no title. Empty ones are left out."""
    marks: list[tuple[str, list[str]]] = [("", [])]
    for line in text.strip().splitlines():
        heading = HEADING.fullmatch(line)
        if heading:
            marks.append((heading[2].strip(), []))
        marks[-1][1].append(line)
    found = ((title, "\n".join(lines).strip()) for title, lines in marks)
    return [(title, body) for title, body in found if body]


def merge_small(parts: list[tuple[str, str]], least: int = MIN_CHARS) -> list[tuple[str, str]]:
    """Sections under least characters join the large one before them; at the start they wait for the first large one."""
    large = next((i for i, (_, body) in enumerate(parts) if len(body) >= least), None)
    if large is None:
        return parts
    title, body = parts[large]
    out = [(title, "\n\n".join([b for _, b in parts[:large]] + [body]))]
    for title, body in parts[large + 1 :]:
        if len(body) >= least:
            out.append((title, body))
        else:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{body}")
    return out


def pieces(body: str, most: int = MAX_CHARS) -> list[str]:
    """body in parts of at most most characters: whole paragraphs while they fit, longer ones cut hard."""
    if len(body) <= most:
        return [body]
    packs: list[list[str]] = [[]]
    room = most
    for paragraph in re.split(r"\n\s*\n", body):
        cost = len(paragraph) + 2
        if packs[-1] and cost > room:
            packs.append([])
            room = most
        packs[-1].append(paragraph)
        room -= cost
    joined = ["\n\n".join(p) for p in packs]
    return [j[i : i + most] for j in joined for i in range(0, len(j), most)]


def prompt_chunks(text: str) -> list[tuple[str, str]]:
    """(title, text) of a prompt's chunks, sections of pure boilerplate left out before and after merging."""
    plain = [s for s in sections(text or "") if s[0].lower() not in BOILERPLATE]
    return [(title, piece) for title, body in merge_small(plain) if title.lower() not in BOILERPLATE for piece in pieces(body)]


def tool_chunk(tool: dict) -> tuple[str, str]:
    names = parameter_names(tool.get("schema") or {}) or parameter_names({"properties": (tool.get("schema") or {}).get("properties")})
    lines = [tool["name"], tool.get("description") or "", PARAMETER_LABEL + ", ".join(names) if names else ""]
    return tool["name"], "\n".join(filter(None, lines))


def snapshot_chunks(system: str, developer: str, tools: list[dict]) -> list[tuple[str, str, str]]:
    """(kind, title, text) of all chunks of a prompt version."""
    return [("prompt_section", *c) for p in (system, developer) for c in prompt_chunks(p)] + [("tool", *tool_chunk(t)) for t in tools]


def normal_text(text: str | None) -> str:
    return "\n".join(map(str.rstrip, (text or "").splitlines())).strip()


def message_hash(text: str) -> str:
    return hashlib.sha256(normal_text(text).encode("utf-8", "surrogatepass")).hexdigest()


def version_hash(client: str, model: str, system: str, developer: str, tools: list[dict]) -> str:
    """A hash that trailing white space and the order of tools leave alone, and any change of a tool's schema moves."""
    described = [{"name": t["name"], "description": t.get("description") or "", "params": parameter_names(t.get("schema") or {}), "schema": json.dumps(t.get("schema") or {}, ensure_ascii=False, sort_keys=True)} for t in tools]
    whole = {"client": client, "model": model, "system": normal_text(system), "developer": normal_text(developer), "tools": sorted(described, key=lambda t: t["name"])}
    return hashlib.sha256(json.dumps(whole, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")).hexdigest()


def blob_payload(value: Any) -> tuple[str, int, str]:
    """Canonical JSON of a value, its size in bytes and its hash."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    raw = text.encode("utf-8", "surrogatepass")
    return text, len(raw), "sha256:" + hashlib.sha256(raw).hexdigest()


def prompt_markdown(system: str, developer: str, user: str, tools: list[dict]) -> str:
    """A prompt version as Markdown; headings inside are indented so that the four main ones stand alone."""
    indent = lambda text: re.sub(r"(?m)^(#{1,6}\s)", r"    \1", text)
    out = [f"# {title}\n\n{indent(text)}\n" for title, text in (("System", system), ("Developer", developer), ("User", user)) if text]
    if tools:
        out.append("# Tools\n")
        for t in sorted(tools, key=lambda t: t["name"]):
            out.append(f"## {t['name']}\n\n{indent(t.get('description') or '')}\n\n```json\n{json.dumps(t.get('schema') or {}, ensure_ascii=False, indent=2, sort_keys=True)}\n```\n")
    return "\n".join(out)
