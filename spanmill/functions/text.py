"""Text, path and label expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths by how much they matter in a listing. Fixed values.
PRIMARY_PATHS = ("/v1/messages", "/v1/responses", "/responses", "/chat/completions", "/completions", "streamgeneratecontent", "generatecontent")
AUXILIARY_PATHS = ("/token", "oauth", "userinfo", "quota", "experiments", "admincontrols", "features", "register", "manifest", "/metrics", "/log", "loadcodeassist", "fetchavailablemodels", "fetchuserinfo")
MODEL_PROBES = ("/models", "/v1/models", "/v1alpha/models", "/v1beta/models")
SENSITIVE_SUFFIXES = ("token", "secret", "password")


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def preview(text: Column, limit: int) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"(?U)\s+$", ""), F.lit("...")))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def attribution(seen_at: Column, client: Column, session: Column) -> Column:
    """'YYYY-MM-DD HH:MM · client · session abcdef' of an ISO time."""
    return F.concat(F.replace(F.substring(seen_at, 1, 16), F.lit("T"), F.lit(" ")), F.lit(" · "), client, F.lit(" · session "), F.substring(session, 1, 6))


def content_hash(text: Column) -> Column:
    """sha256 of the text with lines stripped at the right and the whole at both ends."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n|[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", "\n"), r"(?U)[\s&&[^\n]]+(?=\n|$)", "")
    return F.sha2(F.regexp_replace(F.regexp_replace(lines, r"(?U)^\s+", ""), r"(?U)\s+$", ""), 256)


def slug(label: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(key == "", F.lit("unknown")).otherwise(key)


def path_only(path: Column) -> Column:
    bare = F.substring_index(path, "?", 1)
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit("/unknown")).otherwise(bare)


def model_in_path(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"/models?/([^:?/]+)", 1)


def bedrock_model(path: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(path, F.lit("")), r"/model/(.+)/(?:invoke|converse)", 1)
    return F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def contains_any(text: Column, parts) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(re.escape(p) for p in parts)), F.lit(False))


def is_model_probe(path: Column) -> Column:
    bare = F.regexp_replace(F.substring_index(F.lower(path), "?", 1), "/+$", "")
    return F.coalesce(bare.isin(*MODEL_PROBES) | bare.rlike(r"^/(v1/)?models/[^/:]+$"), F.lit(False))


def is_primary(path: Column) -> Column:
    return contains_any(path, PRIMARY_PATHS)


def is_auxiliary(path: Column) -> Column:
    return is_model_probe(path) | contains_any(path, AUXILIARY_PATHS)


def is_error(path: Column, status: Column, error: Column) -> Column:
    return (F.coalesce(error, F.lit("")) != "") | ((F.coalesce(status, F.lit(0)) >= 400) & ~is_auxiliary(path))


def is_auxiliary_error(path: Column, status: Column) -> Column:
    return (F.coalesce(status, F.lit(0)) >= 400) & is_auxiliary(path)


def is_primary_success(path: Column, status: Column) -> Column:
    return F.coalesce(status.between(200, 399), F.lit(False)) & ~is_auxiliary(path)


def path_tier(path: Column) -> Column:
    """0 model calls, 1 what stands beside them, 2 the rest."""
    return F.when(is_primary(path), 0).when(is_auxiliary(path), 2).otherwise(1)


def model_tier(model: Column) -> Column:
    name = F.lower(model)
    return F.when(name.contains("opus"), 0).when(name.contains("sonnet"), 1).when(name.contains("haiku"), 3).otherwise(2)


def dotted_key(turn: Column) -> Column:
    """A sort key for turns such as 14.2: numbers by segment, what is no number counts as 0."""
    return F.transform(F.split(turn.cast("string"), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def count_matches(text: Column, query: str) -> Column:
    """Non-overlapping occurrences of query."""
    if not query:
        return F.lit(0).cast("long")
    hay = F.coalesce(text, F.lit(""))
    return F.floor((F.length(hay) - F.length(F.replace(hay, F.lit(query), F.lit("")))) / len(query)).cast("long")


def first_match(text: Column, variants: list[str]) -> Column:
    """Leftmost place (from 1) of any variant, null if none occurs."""
    places = [F.nullif(F.locate(v, text), F.lit(0)) for v in variants]
    return F.least(*places) if len(places) > 1 else places[0]


def query_variants(query: str) -> list[str]:
    """Spellings of key:value as it may stand in JSON, plain and escaped; other queries stand alone."""
    out = [query]
    m = re.fullmatch(r"\s*\"?([\w.-]+)\"?\s*:\s*\"?(.*?)\"?\s*", query, re.S)
    if m and m[2]:
        key, value = m[1], m[2]
        out += [f'"{key}":"{value}"', f'"{key}": "{value}"', f'\\"{key}\\":\\"{value}\\"', f'\\"{key}\\": \\"{value}\\"', f'"{key}":{value}', f'"{key}": {value}']
    return list(dict.fromkeys(out))


def is_sensitive_key(key: Column, names: tuple[str, ...]) -> Column:
    bare = F.regexp_replace(F.lower(key), "[^a-z0-9]", "")
    return bare.isin(*names) | bare.rlike("(" + "|".join(SENSITIVE_SUFFIXES) + ")$")


def instant(text: Column) -> Column:
    """An ISO time as timestamp; without zone it is UTC; null if it is none."""
    return F.try_to_timestamp(text)


def instant_seconds(text: Column) -> Column:
    """Seconds since 1970 as double; 0 for what is no time."""
    return F.coalesce(F.unix_micros(instant(text)) / 1e6, F.lit(0.0))


def gap_label(seconds: Column) -> Column:
    """Minutes below an hour, else hours to one decimal; null below a minute."""
    return F.when(seconds < 3600, F.concat(F.floor(seconds / 60 + 0.5).cast("string"), F.lit("m"))).otherwise(F.concat(F.format_number(seconds / 3600, 1), F.lit("h")))


#: Letters that lose their accents in words, what they become, and the characters of words.
ACCENTED, PLAIN, WORD_CHARS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy", r"[\p{L}\p{N}]"


def token_words(text: Column) -> Column:
    """Words of a keyword index: lower case, accents of Latin letters folded, everything else separates."""
    folded = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.regexp_extract_all(folded, F.lit(WORD_CHARS + "+"), F.lit(0))
