"""Inventories from tool files: models, chat logs, command histories, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.functions import text as X
from gumshoe.operators.links import beside, linked


def aider_history(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Headings, models and delimiter counts of markdown chat histories."""
    every = lambda p, g=0: F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(g))
    return df.select(
        "source_file", "platform", F.size(every(r"(?m)^#### ")).alias("n_prompts"), F.size(every(r"(?m)^# ")).alias("n_sessions"),
        F.array_sort(F.array_distinct(every(r"(?im)^> *(?:main )?model: *([A-Za-z0-9._/-]+)", 1))).alias("models"), F.size(every(r"(?m)^(?:<<<<<<<|=======|>>>>>>>)")).alias("n_delimiters"),
    )


def model_inventory(files: DataFrame) -> DataFrame:
    """Models and datasets of a cache by path, with commit and selected settings; custom code is high and T0025.

    ``files``: path and, for settings files, content.
    """
    path = F.col("path")
    kind = F.regexp_extract(path, r"/(models|datasets)--", 1)
    ident = F.regexp_replace(F.regexp_extract(path, r"/(?:models|datasets)--([^/]+)", 1), "--", "/")
    commit = F.regexp_extract(path, r"/snapshots/([0-9a-f]{7,40})", 1)
    v = F.try_parse_json("content")
    rows = files.withColumns(
        {"kind": kind, "model_id": ident, "commit": F.when(commit != "", commit), "model_type": F.try_variant_get(v, "$.model_type", "string"), "custom": F.coalesce(F.col("content").rlike(r'"auto_map"|trust_remote_code'), F.lit(False))}
    ).where("model_id <> ''")
    out = rows.groupBy("kind", "model_id").agg(F.count("*").alias("n_files"), F.max("commit").alias("commit"), F.max("model_type").alias("model_type"), F.bool_or("custom").alias("custom_code"))
    return out.withColumns({"severity": F.when(F.col("custom_code"), "high").otherwise("info"), "atlas": F.when(F.col("custom_code"), F.array(F.lit("AML.T0010"))).otherwise(F.array().cast("array<string>"))})


def chat_log_meta(docs: DataFrame) -> DataFrame:
    """Message count, model and character of chat logs, without their content."""
    v = F.try_parse_json("value")
    rows = docs.withColumn("v", v)
    n = F.coalesce(*[F.size(F.try_variant_get("v", p, "array<variant>")) for p in ("$.messages", "$.history", "$.visible", "$.internal", "$")])
    return rows.select(
        "source_file", F.coalesce(n, F.lit(0)).alias("n_messages"), F.coalesce(F.try_variant_get("v", "$.model", "string"), F.try_variant_get("v", "$.model_name", "string")).alias("model"),
        F.coalesce(F.try_variant_get("v", "$.character", "string"), F.try_variant_get("v", "$.name", "string")).alias("character"), X.normalize_timestamp(F.try_variant_get("v", "$.created_at", "string")).alias("created_at"),
    )


def cli_history(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Non-comment lines of command histories as rows, with the model each names."""
    rows = df.select("source_file", "platform", F.posexplode(F.split(text_col, r"\r?\n")).alias("seq", "line")).where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    model = F.regexp_extract("line", r"(?:--model|-m|run|pull)[ =]+([A-Za-z0-9._/:-]+)", 1)
    return rows.withColumns({"topic": F.left(F.trim("line"), F.lit(100)), "model": F.when(model != "", model)})


def cli_history_summary(lines: DataFrame, most: int = 20) -> DataFrame:
    """Lines, models and topics of command histories: counts, and at most ``most`` models and topics of each."""
    keys = ["platform", "source_file"]
    counts = lines.groupBy(*keys).agg(F.count("*").alias("n_lines"))
    models = linked(lines, keys, "model", most).withColumnsRenamed({"n": "n_models", "sample": "models"})
    topics = linked(lines, keys, "topic", most).withColumnsRenamed({"n": "n_topics", "sample": "topics"})
    return beside(beside(counts, models, keys), topics, keys)


def routing_rules(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Routes, model aliases with their upstream, and redacted keys of routing configurations."""
    t = F.col(text_col)
    every = lambda p, g: F.regexp_extract_all(t, F.lit(X.in_java(p)), F.lit(g))
    pair = r"(?m)model_name: *([A-Za-z0-9._/-]+)[^\n]*\n(?:[^\n]*\n){0,3}?[ ]*model: *([A-Za-z0-9._/-]+)"
    return df.select(
        "source_file", "platform", F.array_sort(F.array_distinct(every(r"(?im)(?:route|path|endpoint)[\"']?[ ]*[:=][ ]*[\"']?(/[A-Za-z0-9_./{}-]*)", 1))).alias("routes"),
        F.zip_with(every(pair, 1), every(pair, 2), lambda a, b: F.concat(a, F.lit(" -> "), b)).alias("aliases"), F.array_sort(F.array_distinct(F.transform(every(r"\b(sk-[A-Za-z0-9_-]{20,})\b", 1), X.redact_edges))).alias("keys"),
    )


def tool_call_count(turns: DataFrame) -> DataFrame:
    """Tool calls by session; results and thinking don't count."""
    return turns.groupBy("platform", "session_id").agg(F.sum("tool_calls").cast("long").alias("tool_calls"))
