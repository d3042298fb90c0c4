"""Pieces of the DuckDB twins: common table expressions over the driver's views."""

from __future__ import annotations

from gumshoe.operators import rules as R
from gumshoe.plans import planted


def lit(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) v({names}))"


DOCS = "ev AS (SELECT 'doc/' || doc_id AS source_file, source AS platform, text AS content FROM documents)"
WITH_PLANTED = f"ev AS (SELECT 'doc/' || doc_id AS source_file, source AS platform, text AS content FROM documents UNION ALL {values(planted.EVIDENCE, 'source_file, platform, content')})"
TURNS = (
    "turns AS (SELECT 'conversations' AS platform, 'conv/' || conv_id AS session_id, CAST(turn AS BIGINT) AS seq, role, CAST(NULL AS VARCHAR) AS model, text AS content, CAST(NULL AS VARCHAR) AS tool_command FROM conversations UNION ALL "
    f"SELECT platform, session_id, CAST(seq AS BIGINT), role, model, content, CAST(tool_command AS VARCHAR) FROM {values(planted.TURNS, 'platform, session_id, seq, role, model, content, tool_command')})"
)
RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"


def label(rank: str) -> str:
    return f"CASE {rank} WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END"


def scan(rules, source: str = "ev", keys: str = "source_file, platform", text: str = "content") -> str:
    """All matches of rules, as the detectors return them."""
    parts = [
        f"SELECT {keys}, {lit(r.id)} AS rule, {lit(r.kind)} AS kind, {lit(r.severity)} AS severity, CAST({r.confidence} AS DOUBLE) AS confidence, {lit(r.phase)} AS phase, unnest(regexp_extract_all({text}, {lit(r.pattern)})) AS value FROM {source}"
        for r in rules
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value <> ''"


def iocs(rules=R.IOC_RULES, name: str = "iocs") -> str:
    """CTE of indicators after the address, domain and path predicates."""
    return (
        f"{name} AS (SELECT * FROM ({scan(rules)}) WHERE NOT (kind = 'ip' AND regexp_matches(value, '^(10\\.|172\\.|192\\.168\\.|127\\.|0\\.)')) "
        "AND NOT (kind = 'domain' AND lower(value) IN ('example.com', 'localhost.com')) AND NOT (kind = 'filepath' AND length(value) <= 8))"
    )


def holds(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"
