"""Keyed deduplication and ordered (window-like) operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.operators.scans import carry_forward, sliding_sum


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key by ``order``: a combinable aggregate, no sort (A1)."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def cross_tool_dedup(turns: DataFrame, order: str = "seq") -> DataFrame:
    """Keep the first of equal user prompts per (content, model); ``also_in_tools`` lists later platforms in order.

    Other roles and blank prompts pass untouched.  Of each platform's copies only the first two
    can show in the result, so no more than these are gathered, however often a prompt occurs.
    """
    turns = turns.withColumn("also_in_tools", F.array().cast("array<string>"))
    prompt = (F.lower("role") == "user") & (F.trim(F.coalesce("content", F.lit(""))) != "")
    users = turns.where(prompt).withColumn("_key", F.trim("content")).withColumn("_model", F.coalesce("model", F.lit("")))
    rest = [c for c in turns.columns if c != "also_in_tools"]
    seen = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("platform").alias("p"))))
    copies = Window.partitionBy("_key", "_model", "platform").orderBy(order)
    users = users.withColumn("_nth", F.row_number().over(copies)).where("_nth <= 2")
    grouped = users.groupBy("_key", "_model").agg(F.min_by(F.struct(*rest), order).alias("r"), seen.alias("seen"))
    later = F.array_distinct(F.transform(F.slice(F.col("seen"), F.lit(2), F.greatest(F.size("seen") - 1, F.lit(0))), lambda s: s["p"]))
    kept = grouped.select(*[F.col(f"r.{c}").alias(c) for c in rest], later.alias("also_in_tools"))
    return kept.unionByName(turns.where(~F.coalesce(prompt, F.lit(False))))


def timeline_dedup(events: DataFrame) -> DataFrame:
    """Best event per (second, platform, artifact type, text): real over collection, longer, earlier.

    The survivor takes the key's least ``seq``, so ties in the timeline keep the first one's place.
    """
    key = F.coalesce(F.when(F.col("content_preview") != "", F.col("content_preview")), F.left("description", F.lit(80)))
    keyed = events.withColumn("_second", F.date_trunc("second", "timestamp")).withColumn("_key", key)
    rest = [c for c in events.columns if c not in ("platform", "artifact_type", "seq")]
    best = F.min_by(F.struct(*rest), F.struct(F.col("is_collection_event").cast("int"), -F.length("description"), F.col("seq")))
    grouped = keyed.groupBy("_second", "platform", "artifact_type", "_key").agg(best.alias("r"), F.min("seq").alias("seq"))
    return grouped.select("platform", "artifact_type", "seq", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*events.columns)


def model_carry_forward(df: DataFrame, partition: list[str], order: list[str], column: str = "model") -> DataFrame:
    """A missing model takes the last one named before it (W4); a long session is scanned by many tasks."""
    return carry_forward(df, partition, order, column, F.when(F.col(column) != "", F.col(column)))


def severity_share(df: DataFrame, column: str = "severity") -> DataFrame:
    """Count, share and running share of each severity, worst first."""
    from gumshoe.functions.text import severity_rank

    counts = df.groupBy(column).agg(F.count("*").alias("n")).withColumn("rank", severity_rank(F.col(column)))
    w = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(w)
    return counts.select(column, "n", F.round(100 * F.col("n") / total, 2).alias("share"), F.round(100 * F.sum("n").over(w.orderBy(F.desc("rank"))) / total, 2).alias("running_share"))


def first_rule_wins(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Of several catalog rows for a key, the first in catalog order."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_r")).select(*keys, *[F.col(f"_r.{v}").alias(v) for v in values])


def turn_window_escalation(turns: DataFrame, flag: str, partition: list[str], order: str, span: int = 5, least: int = 3) -> DataFrame:
    """Turns at which ``least`` of the last ``span`` turns of a session are flagged (W7); a long session is scanned by many tasks."""
    rows = sliding_sum(turns, partition, [order], F.col(flag).cast("int"), span, "flagged_in_window")
    return rows.where(F.col("flagged_in_window") >= least)


def chronological(df: DataFrame, *order: str) -> DataFrame:
    """Rows by time, then the given ties, for an export or a display."""
    return df.orderBy(*order)
