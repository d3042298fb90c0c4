"""Scalar column functions: matching with positions, redaction, normalization, labels.

All are compositions of built-in functions, so they stay inside generated code.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")


def _each_with(index_fn):
    """A two-argument lambda (PySpark counts default arguments as lambda parameters)."""
    return lambda x, i: index_fn(x, i)


_EDGE, _INSIDE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))", r"(?:(?<!\w)(?!\w)|(?<=\w)(?=\w))"
_TOKEN = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-9]+|[\s\S])|\[\^?\]?(?:\\[\s\S]|[^\]\\])*\]|[\s\S]")  # an escape, a class or a character
_WORD = re.compile(r"[A-Za-z0-9_]|\[(?:[a-z]-[a-z]|[A-Z]-[A-Z]|[0-9]-[0-9]|[A-Za-z0-9_])+\]")


@lru_cache(maxsize=1024)
def in_java(pattern: str) -> str:
    r"""``pattern`` with word edges as RE2 and SQL have them, of ASCII letters, digits and ``_`` only.

    Before version 19 Java's own ``\b`` takes any letter as part of a word, so that it finds no ``sudo`` in ``sudo\u00f1a``.
    Beside a character that is part of a word only the other side is looked at, which is quicker.
    """
    tokens = [*_TOKEN.findall(pattern), "", "", ""]
    out = []
    for n, t in enumerate(tokens[:-3]):
        if t == r"\b":
            begins = _WORD.fullmatch(tokens[n + 1]) and tokens[n + 2] not in ("?", "*") and tokens[n + 2 : n + 4] != ["{", "0"]
            ends = n and len(tokens[n - 1]) == 1 and _WORD.fullmatch(tokens[n - 1])
            t = r"(?<!\w)" if begins and not ends else r"(?!\w)" if ends and not begins else _EDGE
        out.append(_INSIDE if t == r"\B" else t)
    return "".join(out)


def all_matches(text: Column, pattern: str) -> Column:
    """Every non-overlapping match as array<struct<value, start, end>>; code points, end exclusive (F1)."""
    pattern = in_java(pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,start:int,end:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        item = F.struct(x["value"].alias("value"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(item)).alias("out"))

    pairs = F.arrays_zip(found.alias("value"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    empty = F.array().cast("array<struct<value:string,start:int,end:int>>")
    return F.when(text.isNull() | (F.size(found) == 0), empty).otherwise(F.aggregate(pairs, start, step, lambda s: s["out"]))


def context_window(text: Column, start: Column, end: Column, pad: int, most: int = 200) -> Column:
    """Text around a match: ``pad`` characters either side, trimmed, at most ``most`` long (F2)."""
    low = F.greatest(start - pad, F.lit(0))
    return F.left(F.trim(F.substring(text, low + 1, end + pad - low)), F.lit(most))


def redact_edges(value: Column) -> Column:
    """Longer than 12: first six and last four; else first four and an ellipsis."""
    return F.when(F.length(value) > 12, F.concat(F.left(value, F.lit(6)), F.lit("..."), F.right(value, F.lit(4)))).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("...")))


def redact_masked(value: Column) -> Column:
    """At most 8 characters: a mask; else four at each end."""
    return F.when(F.length(value) <= 8, F.lit("***")).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4))))


def redact_sized(value: Column) -> Column:
    """First four, last four and the length, for secret findings."""
    return F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4)), F.lit(" ("), F.length(value).cast("string"), F.lit(" chars)"))


def redact_cut(value: Column, most: int = 24) -> Column:
    """Values longer than ``most`` cut."""
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit("..."))).otherwise(value)


def fingerprint(salt: str, rule: Column, value: Column) -> Column:
    """First 16 hex digits of a salted SHA-256 of rule and raw value."""
    return F.left(F.sha2(F.concat_ws("|", F.lit(salt), rule, value), 256), F.lit(16))


def leak_direction(role: Column) -> Column:
    """Who shows a secret to whom."""
    r = F.lower(role)
    return (
        F.when(r.isin("assistant", "ai", "model"), "model_to_user")
        .when(r.isin("user", "human"), "user_to_model")
        .when(r.isin("tool", "function"), "tool_to_model")
        .otherwise("unknown")
    )


# Accepted timestamp layouts.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy-MM-dd",
)


def normalize_timestamp(raw: Column) -> Column:
    """Timestamp of ISO-like text or epoch seconds (above 1e9) or milliseconds (above 1e12); else null."""
    text = F.trim(raw.cast("string"))
    number = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.cast("double"))
    epoch = F.when(number > 1e12, F.timestamp_millis(number.cast("long"))).when(number > 1e9, F.timestamp_seconds(number))
    iso = F.when(text.rlike(r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}"), F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS]))
    return F.coalesce(epoch, iso)


def guess_artifact_type(name: Column) -> Column:
    """Artifact type from a file name; the first test that holds wins."""
    n = F.lower(name)
    return (
        F.when(n.rlike(r"\.(db|sqlite|sqlite3)$"), "database")
        .when(n.rlike(r"\.jsonl(\.zst|\.zstd)?$"), "conversation")
        .when(n.rlike(r"\.(log|out|err)$"), "log")
        .when(n.rlike(r"\.(json|ya?ml|toml|ini|cfg|conf|env)$"), "config")
        .when(n.rlike("history"), "history")
        .when(n.rlike("chat|conversation|session"), "conversation")
        .otherwise("unknown")
    )


def resolve_timestamp(content: Column, modified: Column, collected: Column) -> Column:
    """Content time, else file time, else collection time (F8)."""
    return F.coalesce(normalize_timestamp(content), modified, collected)


def log_line_timestamp(line: Column, default_year: int = 2025) -> Column:
    """Timestamp of a log line: ISO, bracketed ISO, or syslog with ``default_year``; else null."""
    iso = F.regexp_extract(line, r"([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
    syslog = F.regexp_extract(line, r"^([A-Z][a-z]{2} +[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
    dated = F.concat(F.lit(f"{default_year} "), F.regexp_replace(syslog, " +", " "))
    return F.coalesce(F.try_to_timestamp(F.translate(iso, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(dated, F.lit("yyyy MMM d HH:mm:ss")))


def webkit_time(micros: Column) -> Column:
    """Microseconds since 1601 as timestamp; 0 is null."""
    return F.when(micros != 0, F.timestamp_micros(micros - F.lit(11644473600000000)))


# What a text must hold to be of a severity, most severe first.
SEVERITY_PATTERNS = (
    ("critical", r"\b(sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{36,}|AKIA[A-Z0-9]{16}|xai-[A-Za-z0-9_-]{20,})\b"),
    ("critical", r"(?i)(jailbreak|do anything now|\bDAN mode\b|ignore (all )?previous instructions|bypass (your )?safety)"),
    ("high", r"(?i)\b(password|passwd|secret|credential|api[_-]?key|private[_-]?key|access[_-]?token)\b *[:=]"),
    ("high", r"(?i)(/etc/shadow|/etc/passwd|\.ssh/|id_rsa|\.aws/credentials|\.gnupg/)"),
    ("medium", r"(?i)\b(curl|wget|ssh|scp|netcat|telnet)\b|https?://"),
)
SYSTEM_INTERNALS = r"(?i)\b(system prompt|environment variable|sudo|chmod|registry|kernel)\b"


def infer_severity(text: Column, role: Column | None = None, may: list[Column] | None = None) -> Column:
    """First severity whose pattern the text holds; system internals count for users only.

    ``may`` has a test of each of ``SEVERITY_PATTERNS``, false only where it can't match.
    """
    t = F.coalesce(text, F.lit(""))
    out = None
    for n, (severity, pattern) in enumerate(SEVERITY_PATTERNS):
        held = t.rlike(in_java(pattern))
        found = may[n] & held if may else held
        out = F.when(found, severity) if out is None else out.when(found, severity)
    if role is not None:
        out = out.when((F.lower(role) == "user") & t.rlike(in_java(SYSTEM_INTERNALS)), "medium")
    return out.otherwise("info")


def _label(column: Column, values: dict, other) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(other))


# What severities count in the scores.
RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
SCORE = {"critical": 95, "high": 75, "medium": 50, "low": 25, "info": 10}
SCORE_ALTERNATE = {"critical": 90, "high": 70, "medium": 50, "low": 25, "info": 10}
STIX_CONFIDENCE = {"critical": 95, "high": 85, "medium": 65, "low": 40, "info": 20}
SHADOW_RISK = {"high": 8, "medium": 5, "low": 2}
HOST_RISK = {"critical": 30, "high": 20, "medium": 10, "low": 3, "info": 0}


def severity_rank(severity: Column) -> Column:
    return _label(severity, RANK, 0)


def severity_label(rank: Column) -> Column:
    return _label(rank, {v: k for k, v in RANK.items()}, "info")


def severity_score(severity: Column, alternate: bool = False) -> Column:
    return _label(severity, SCORE_ALTERNATE if alternate else SCORE, 10)


def stix_confidence(severity: Column) -> Column:
    return _label(severity, STIX_CONFIDENCE, 30)


def host_risk(severity: Column) -> Column:
    return _label(severity, HOST_RISK, 0)


def band(score: Column, edges: tuple[int, int, int] = (90, 70, 40)) -> Column:
    """Critical, High, Medium or Low."""
    top, high, mid = edges
    return F.when(score >= top, "Critical").when(score >= high, "High").when(score >= mid, "Medium").otherwise("Low")


def band_alternate(score: Column) -> Column:
    """Five bands at 80, 60, 40 and 20."""
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").when(score >= 20, "low").otherwise("info")


def raise_to_high(severity: Column) -> Column:
    """Seen on several platforms: anything short of critical becomes high."""
    return F.when(severity == "critical", severity).otherwise("high")


def raise_one(severity: Column) -> Column:
    """One level up."""
    return _label(severity, {"info": "low", "low": "medium", "medium": "high", "high": "critical", "critical": "critical"}, "low")


#: Unicode's space separators, which SQL's ``trim`` takes off; Spark's takes off plain spaces only.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def preview(text: Column, most: int = 120) -> Column:
    """First characters on one line (F16)."""
    return F.btrim(F.translate(F.left(text, F.lit(most)), "\n", " "), F.lit(SPACES))


def event_description(platform: Column, role: Column, text: Column) -> Column:
    """Sentence for a turn in a timeline."""
    r = F.lower(role)
    who = (
        F.when(r.isin("user", "human"), "User prompt")
        .when(r.isin("assistant", "ai", "model"), "Assistant response")
        .when(r.isin("tool", "function"), "Tool output")
        .when(r == "system", "System message")
        .otherwise("Message")
    )
    return F.concat(F.lit("["), platform, F.lit("] "), who, F.lit(": '"), preview(text, 80), F.lit("'"))


def join_content_parts(parts: Column) -> Column:
    """Texts of content parts, one a line."""
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def first_filled(values: Column, most: int) -> Column:
    """First non-empty of an array, cut."""
    kept = F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != ""))
    return F.left(F.when(F.size(kept) > 0, F.element_at(kept, 1)), F.lit(most))


TOOL_ARGUMENTS = ("command", "cmd", "shell_command", "file_path", "path", "url", "pattern", "query")


def tool_command_projection(arguments: Column, most: int = 2000) -> Column:
    """The telling argument of a tool call's JSON, else the JSON cut."""
    return F.coalesce(*[F.get_json_object(arguments, f"$.{k}") for k in TOOL_ARGUMENTS], F.left(arguments, F.lit(most)))


def extract_domain(text: Column) -> Column:
    """First host name that is neither an address nor localhost."""
    names = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,}"), F.lit(0))
    return F.get(F.filter(names, lambda n: ~n.rlike(r"^[0-9.]+$") & ~n.startswith("localhost")), 0)


def extract_port(text: Column) -> Column:
    """Trailing port number."""
    found = F.regexp_extract(text, r":([0-9]{1,5})\)?\s*$", 1)
    return F.when(found != "", found.cast("int"))


SENSITIVE_KEY = r"(?i)(key|secret|token|password|credential)"


def env_entries(text: Column) -> Column:
    """KEY=value lines as array<struct<key, sensitive, length>>; values are never kept."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(r"^(export +)?[A-Za-z_][A-Za-z0-9_]*=") & ~F.trim(x).startswith("#"))

    def entry(x: Column) -> Column:
        key = F.regexp_replace(F.trim(F.substring_index(x, "=", 1)), "^export +", "")
        return F.struct(key.alias("key"), key.rlike(SENSITIVE_KEY).alias("sensitive"), (F.length(x) - F.length(F.substring_index(x, "=", 1)) - 1).alias("length"))

    return F.transform(lines, entry)


# STIX comparison of each indicator type.
STIX_TEMPLATES = {
    "ip": "[ipv4-addr:value = '%s']",
    "ipv4": "[ipv4-addr:value = '%s']",
    "ipv6": "[ipv6-addr:value = '%s']",
    "domain": "[domain-name:value = '%s']",
    "url": "[url:value = '%s']",
    "email": "[email-addr:value = '%s']",
    "hash_md5": "[file:hashes.MD5 = '%s']",
    "hash_sha1": "[file:hashes.'SHA-1' = '%s']",
    "hash_sha256": "[file:hashes.'SHA-256' = '%s']",
    "filepath": "[file:name = '%s']",
    "command": "[process:command_line = '%s']",
    "api_key": "[x-credential:value = '%s']",
    "exfil_pattern": "[process:command_line = '%s']",
}


def stix_pattern(kind: Column, value: Column) -> Column:
    """STIX pattern by type, else by the value's shape."""
    v = F.regexp_replace(value, r"(['\\])", r"\\$1")
    out = F.when(F.lit(False), F.lit(""))
    for k, template in STIX_TEMPLATES.items():
        a, b = template.split("%s")
        out = out.when(kind == k, F.concat(F.lit(a), v, F.lit(b)))
    shape = lambda rx, k: (value.rlike(rx), F.concat(F.lit(STIX_TEMPLATES[k].split("%s")[0]), v, F.lit("']")))
    for test, made in (
        shape(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", "ip"),
        shape(r"^https?://", "url"),
        shape(r"^[0-9a-fA-F]{64}$", "hash_sha256"),
        shape(r"^[0-9a-fA-F]{40}$", "hash_sha1"),
        shape(r"^[0-9a-fA-F]{32}$", "hash_md5"),
        shape(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$", "domain"),
    ):
        out = out.when(test, made)
    return out.otherwise(F.concat(F.lit("[x-indicator:value = '"), v, F.lit("']")))


BASE64_BLOCK = r"[A-Za-z0-9+/]{40,}={0,2}"


def decode_base64_blocks(text: Column, whole_groups: bool = True) -> Column:
    """Decoded text of long base64 blocks; malformed ones are left out."""
    blocks = F.regexp_extract_all(text, F.lit(BASE64_BLOCK), F.lit(0))
    if whole_groups:
        blocks = F.filter(blocks, lambda b: F.length(b) % 4 == 0)
    return F.filter(F.transform(blocks, lambda b: F.make_valid_utf8(F.try_to_binary(b, F.lit("base64")).cast("string"))), lambda d: d.isNotNull())


# Invisible characters and Latin look-alikes.
ZERO_WIDTH = "​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯᠎﻿￹￺￻"
HOMOGLYPHS = "аеорсуіјһıɪ"


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def zero_width_positions(text: Column) -> Column:
    """Places of invisible characters, found only where there are any."""
    spots = F.transform(all_matches(text, f"[{ZERO_WIDTH}]"), lambda m: m["start"])
    return F.when(text.rlike(f"[{ZERO_WIDTH}]"), spots).otherwise(F.array().cast("array<int>"))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character."""
    letters = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    n = F.length(text)

    def share(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.transform(letters, share), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


# Ports on which local model services listen.
SERVICE_PORTS = {11434: "Ollama", 1234: "LM Studio", 8080: "llama.cpp / LocalAI", 7860: "Gradio / text-generation-webui", 5000: "text-generation-webui API", 8000: "vLLM", 4000: "LiteLLM", 3000: "Open WebUI", 5001: "KoboldCpp", 1337: "Jan", 8188: "ComfyUI", 3001: "AnythingLLM"}


def service_for_port(port: Column) -> Column:
    return _label(port, SERVICE_PORTS, None)
