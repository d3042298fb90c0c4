"""One timeline of collection, turns, logs, configurations and indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions import text as X
from gumshoe.functions.screen import candidates
from gumshoe.operators import rules as R
from gumshoe.operators.dedup import timeline_dedup

COLUMNS = ("timestamp", "platform", "artifact_type", "description", "severity", "source_path", "is_collection_event", "content_preview", "seq")

_SEVERITIES = [R.Rule(f"severity-{n}", "severity", p, s) for n, (s, p) in enumerate(X.SEVERITY_PATTERNS)]


def _events(df: DataFrame, time: Column, kind: Column, text: Column, severity: Column, path: Column, collected: bool, preview: Column, seq: Column) -> DataFrame:
    return df.select(
        time.alias("timestamp"), "platform", kind.alias("artifact_type"), text.alias("description"), severity.alias("severity"), path.alias("source_path"), F.lit(collected).alias("is_collection_event"),
        preview.alias("content_preview"), seq.cast("string").alias("seq"),
    )


def collection_events(manifest: DataFrame) -> DataFrame:
    """One event per collected file."""
    path = F.col("original_path")
    return _events(manifest, F.col("collected_at"), F.col("artifact_type"), F.concat(F.lit("Collected "), path), F.lit("info"), path, True, F.lit(""), F.concat(F.lit("0:"), path))


def turn_events(turns: DataFrame) -> DataFrame:
    """One event per conversation turn, severity inferred from its text."""
    return _events(
        turns, F.col("timestamp"), F.lit("conversation"), X.event_description(F.col("platform"), F.col("role"), F.coalesce("content", F.lit(""))), X.infer_severity(F.col("content"), F.col("role")),
        F.col("source_file"), False, X.preview(F.coalesce("content", F.lit(""))), F.concat(F.lit("1:"), "source_file", F.lit(":"), F.lpad(F.col("seq").cast("string"), 12, "0")),
    )


def log_events(lines: DataFrame, default_year: int = 2025) -> DataFrame:
    """One event per non-blank log line, timed by the line, else its file."""
    rows = lines.where(F.trim("line") != "")
    time = F.coalesce(X.log_line_timestamp(F.col("line"), default_year), F.col("modified_at"))
    return _events(rows, time, F.lit("log"), F.left("line", F.lit(200)), X.infer_severity(F.col("line")), F.col("source_file"), False, X.preview(F.col("line")), F.concat(F.lit("2:"), "source_file", F.lit(":"), F.lpad(F.col("line_no").cast("string"), 12, "0")))


def config_events(files: DataFrame) -> DataFrame:
    """One event per configuration file."""
    files, may = candidates(files.select("platform", "source_file", "modified_at", "content"), _SEVERITIES, "content", every=True)
    return _events(files, F.col("modified_at"), F.lit("config"), F.concat(F.lit("Configuration "), "source_file"), X.infer_severity(F.col("content"), may=may), F.col("source_file"), False, X.preview(F.col("content")), F.concat(F.lit("3:"), "source_file"))


def indicator_events(indicators: DataFrame, time: str = "event_time") -> DataFrame:
    """One event per indicator: the worse of its stated severity and that of its value."""
    stated, seen = X.severity_rank(F.col("severity")), X.severity_rank(X.infer_severity(F.col("value")))
    return _events(
        indicators, F.col(time), F.lit("indicator"), F.concat(F.lit("Indicator "), "kind", F.lit(": "), F.left("value", F.lit(80))), X.severity_label(F.greatest(stated, seen)), F.col("source_file"), False,
        X.preview(F.col("value")), F.concat(F.lit("4:"), "source_file", F.lit(":"), "kind", F.lit(":"), "value"),
    )


def unified_timeline(*parts: DataFrame) -> DataFrame:
    """All events, the best of equal ones (U1, W1); ``in_order`` sorts them for a display."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return timeline_dedup(every)


def in_order(events: DataFrame) -> DataFrame:
    """Events by time, real ones before collection records, then by their place."""
    return events.orderBy("timestamp", "is_collection_event", "seq")
