"""Sessions of conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.functions import text as X
from gumshoe.operators.correlate import worst


def sessions(turns: DataFrame) -> DataFrame:
    """Per (platform, session): turns, models, first model named, start, end, files."""
    named = F.when(F.col("model") != "", F.col("model"))
    return turns.groupBy("platform", "session_id").agg(
        F.count("*").alias("turn_count"), F.array_sort(F.collect_set(named)).alias("models"), F.min_by(named, F.when(named.isNotNull(), F.col("seq"))).alias("model"), F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"), F.array_sort(F.collect_set("source_file")).alias("source_files"),
    )


def session_risk(turns: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of each session, by the first session of their source file."""
    first = turns.groupBy("source_file").agg(F.min_by(F.struct("platform", "session_id"), "seq").alias("s")).select("source_file", F.col("s.platform").alias("platform"), F.col("s.session_id").alias("session_id"))
    rows = findings.drop("platform", "session_id", "seq").join(first, "source_file")
    return rows.groupBy("platform", "session_id").agg(
        F.count("*").alias("n_findings"), F.max(X.severity_score(F.col("severity"), alternate=True)).alias("risk_score"), worst().alias("risk_severity"), F.count_if(F.col("category") == "jailbreak").alias("jailbreak_attempts")
    )


def session_summary(turns: DataFrame, findings: DataFrame) -> DataFrame:
    """Turn counts by side, tool calls, attempts and risk of each session (A9); ``riskiest_first`` sorts them for a display."""
    role = F.lower("role")
    tool = F.col("tool_command").isNotNull() if "tool_command" in turns.columns else F.lit(False)
    counts = turns.groupBy("platform", "session_id").agg(
        F.count("*").alias("turns"), F.count_if(role.isin("user", "human")).alias("user_turns"), F.count_if(role.isin("assistant", "ai", "model")).alias("assistant_turns"), F.count_if(tool).alias("tool_calls")
    )
    joined = counts.join(session_risk(turns, findings), ["platform", "session_id"], "left")
    return joined.withColumns({"n_findings": F.coalesce("n_findings", F.lit(0)).cast("long"), "risk_score": F.coalesce("risk_score", F.lit(0)), "risk_severity": F.coalesce("risk_severity", F.lit("info")), "jailbreak_attempts": F.coalesce("jailbreak_attempts", F.lit(0)).cast("long")})


def riskiest_first(summary: DataFrame) -> DataFrame:
    """Sessions by risk, then findings."""
    return summary.orderBy(F.desc("risk_score"), F.desc("n_findings"), "platform", "session_id")
