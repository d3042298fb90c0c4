"""Correlation of indicators across platforms, and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions import text as X
from gumshoe.operators.links import linked
from gumshoe.operators.sketches import distinct_sketches, heavy_hitters, merged_counts


def worst(severity: str = "severity") -> Column:
    """Most severe label of a group."""
    return F.max_by(severity, X.severity_rank(F.col(severity)))


def cross_platform_upgrade(iocs: DataFrame) -> DataFrame:
    """Indicators seen on two platforms or more become high at least; ``n_platforms`` is null for the others (A2)."""
    return _raised(iocs, X.raise_to_high)


def _raised(iocs: DataFrame, up: Callable[[Column], Column]) -> DataFrame:
    """Severities of indicators on several platforms, raised.

    Only keys on several platforms are joined back; Spark broadcasts them if what the aggregate
    gives is small, else joins by key and splits skewed partitions.
    """
    keys = iocs.groupBy("kind", "value").agg(F.count_distinct("platform").alias("n_platforms")).where("n_platforms >= 2")
    joined = iocs.join(keys, ["kind", "value"], "left")
    return joined.withColumn("severity", F.when(F.col("n_platforms").isNotNull(), up(F.col("severity"))).otherwise(F.col("severity")))


def cross_platform_indicator(indicators: DataFrame, most: int = 20) -> DataFrame:
    """One ``cross_platform`` row per indicator on two platforms or more, with the number of its files and at most ``most`` of them (A3)."""
    rows = indicators.withColumnRenamed("kind", "of_kind")
    grouped = rows.groupBy("of_kind", "value").agg(F.array_sort(F.collect_set("platform")).alias("platforms"), F.count("*").alias("n"), F.min_by("phase", "source_file").alias("phase")).where(F.size("platforms") >= 2)
    keys = grouped.select("of_kind", "value")
    files = linked(rows.join(keys, ["of_kind", "value"], "left_semi"), ["of_kind", "value"], "source_file", most).withColumnsRenamed({"n": "n_files", "sample": "files"})
    return grouped.join(files, ["of_kind", "value"]).withColumns({"kind": F.lit("cross_platform"), "severity": F.lit("critical"), "confidence": F.lit(0.95)})


def upgrade_indicators(indicators: DataFrame) -> DataFrame:
    """Indicators on several platforms go one level up, and their cross-platform rows are counted once."""
    return _raised(indicators, X.raise_one)


def shared_credentials(indicators: DataFrame) -> DataFrame:
    """Credential values on two platforms or more with their worst severity (A4)."""
    rows = indicators.where(F.col("kind") == "credential").groupBy("value")
    return rows.agg(F.array_sort(F.collect_set("platform")).alias("platforms"), F.count("*").alias("n"), worst().alias("severity")).where(F.size("platforms") >= 2)


def correlations(iocs: DataFrame, findings: DataFrame) -> DataFrame:
    """Indicators shared by platforms, and severities that several platforms have findings of (A5)."""
    shared = iocs.groupBy("kind", "value").agg(F.array_sort(F.collect_set("platform")).alias("platforms"), F.count("*").alias("n")).where(F.size("platforms") >= 2)
    shared = shared.select(F.lit("shared_indicator").alias("correlation"), F.col("kind").alias("key"), "value", "platforms", "n")
    levels = findings.groupBy("severity").agg(F.array_sort(F.collect_set("platform")).alias("platforms"), F.count("*").alias("n")).where(F.size("platforms") >= 2)
    levels = levels.select(F.lit("severity_pattern").alias("correlation"), F.col("severity").alias("key"), F.lit("").alias("value"), "platforms", "n")
    return shared.unionByName(levels)


def summaries(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each of ``columns`` and in all, in one pass of grouping sets."""
    sets = [[F.col(c)] for c in columns] + [[]]
    grouped = df.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    size = len(columns)
    named = F.when(F.col("g") == (1 << size) - 1, "all")
    key = F.when(F.col("g") == (1 << size) - 1, "all")
    for k, c in enumerate(columns):
        g = ((1 << size) - 1) ^ (1 << (size - 1 - k))
        named, key = named.when(F.col("g") == g, c), key.when(F.col("g") == g, F.coalesce(F.col(c), F.lit("unknown")))
    return grouped.select(named.alias("dimension"), key.alias("key"), "n")


def hunt_summary(found: DataFrame, turn_keys: list[str]) -> DataFrame:
    """Totals of a secret hunt: findings, flagged turns, distinct secrets, by severity and direction."""
    count_if = lambda c, v: F.count_if(F.col(c) == v).alias(f"n_{v}")
    return found.agg(
        F.count("*").alias("n_findings"), F.count_distinct(*turn_keys).alias("n_turns"), F.count_distinct("fingerprint").alias("n_secrets"),
        *[count_if("severity", v) for v in X.SEVERITIES], *[count_if("leak_direction", v) for v in ("model_to_user", "user_to_model", "tool_to_model", "unknown")],
    )


def hunt_estimates(found: DataFrame, turn_keys: list[str], by: list[str]) -> DataFrame:
    """One row of ``hunt_summary``'s totals with distinct counts from sketches of each share ``by``.

    Shares can be kept and merged later, as of days or platforms; ``hunt_summary`` counts exactly.
    """
    shares = distinct_sketches(found, {"n_turns": turn_keys, "n_secrets": ["fingerprint"]}, by)
    return merged_counts(shares, ["n_turns", "n_secrets"]).withColumnRenamed("rows", "n_findings")


def findings_summary(findings: DataFrame) -> DataFrame:
    """Counts by severity and by category."""
    return summaries(findings, ["severity", "category"])


def platform_graph(shared: DataFrame, platforms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): platforms, and distinct pairs that share a correlation, labelled by the first.

    Pairs are built from the sorted platform set of each correlation, which is
    bounded by the number of tools, not by the corpus.
    """
    sets = shared.groupBy("platforms").agg(F.min(F.struct("correlation", "key", "value")).alias("why"))
    left = sets.select("why", "platforms", F.posexplode("platforms").alias("i", "src"))
    pairs = left.select("why", "src", F.explode(F.slice("platforms", F.col("i") + 2, F.size("platforms"))).alias("dst"))
    edges = pairs.groupBy("src", "dst").agg(F.min("why").alias("why")).select("src", "dst", F.col("why.correlation").alias("label"), F.col("why.key").alias("key"))
    return platforms.select(F.col("platform").alias("node")).distinct(), edges


def platform_inventory(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """Artifacts, findings and worst severity of each platform that has artifacts (A10)."""
    have = artifacts.groupBy("platform").agg(F.count("*").alias("n_artifacts"))
    told = findings.groupBy("platform").agg(F.count("*").alias("n_findings"), worst().alias("max_severity"))
    return have.join(told, "platform", "left").withColumns({"n_findings": F.coalesce("n_findings", F.lit(0)).cast("long"), "max_severity": F.coalesce("max_severity", F.lit("info"))})


def daily_activity(events: DataFrame, time_col: str = "timestamp", days: int = 30) -> DataFrame:
    """Events per day of the last ``days`` days present."""
    daily = events.where(F.col(time_col).isNotNull()).groupBy(F.to_date(time_col).alias("day")).agg(F.count("*").alias("n"))
    return daily.orderBy(F.desc("day")).limit(days)


def model_usage(calls: DataFrame, column: str, most: int = 20) -> DataFrame:
    """Most frequent values of a model, status or error column."""
    return heavy_hitters(calls, column, most)


def top_techniques(matches: DataFrame, most: int = 8) -> DataFrame:
    """Techniques matched most (T7); there are no more of them than the catalog has, so all are counted."""
    return matches.groupBy("technique_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "technique_id").limit(most)


def capped(df: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """First ``most`` rows of a stated order, for reports; never an input of a score (T5)."""
    return df.orderBy(*order).limit(most)


def platform_union(a: Column, b: Column) -> Column:
    """Platforms in either set, in order (U4)."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))
