"""Transcript ingestion: JSON lines and documents of several shapes to conversation turns.

Lines become ``VARIANT`` values; each shape is a projection of variant paths, so
parsing stays in the JVM.  Lines are numbered as in the whole file, however many
tasks read it (``sources.lines``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.functions import text as X
from gumshoe.operators.dedup import model_carry_forward
from gumshoe.sources.lines import numbered_lines

TURN_COLUMNS = ("timestamp", "platform", "role", "content", "model", "session_id", "source_file", "seq", "metadata", "tool_command", "tool_input", "tool_description", "workspace", "tool_calls")
ROLES = ("user", "assistant", "system", "tool", "function", "human", "ai", "bot")
_NULL = "cast(null as string)"


def read_jsonl(spark: SparkSession, path: str, good: bool = True) -> DataFrame:
    """Parsed lines: source_file, session_stem, line_no, value, v (variant); plain or zstd, every frame.

    Blank lines are skipped; malformed ones are left out, or returned instead if not ``good``.
    """
    lines = numbered_lines(spark, path).select("source_file", "file_name", "line_no", "value").where(F.trim("value") != "")
    parsed = lines.withColumn("v", F.try_parse_json("value")).withColumn("session_stem", F.regexp_replace("file_name", r"\.jsonl?(\.zst|\.zstd)?$", ""))
    return parsed.where(F.col("v").isNotNull() if good else F.col("v").isNull())


def get(path: str, kind: str = "string", of: str = "v") -> Column:
    """Value at a path of a variant, null where it is absent or of another type."""
    return F.try_variant_get(F.col(of), path, kind)


def raw_at(path: str, of: str = "v") -> Column:
    """Value at a path as JSON text."""
    return F.to_json(F.try_variant_get(F.col(of), path, "variant"))


def turns(df: DataFrame, **columns: Column) -> DataFrame:
    """Turn rows with the given columns; the rest are null."""
    kinds = {"timestamp": "timestamp", "seq": "long", "tool_calls": "int"}
    return df.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in TURN_COLUMNS])


_BLOCKS = "array<struct<type:string,text:string,thinking:string,name:string,id:string,input:variant,content:variant>>"


def parse_nested_blocks(lines: DataFrame, platform: str = "assistant-cli") -> DataFrame:
    """Records with message.content blocks: texts make the content, tool_use blocks the calls."""
    rows = lines.withColumn("blocks", get("$.message.content", _BLOCKS)).withColumn("plain", get("$.message.content"))
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.array().cast(_BLOCKS)))
    of = lambda kind: F.filter("blocks", lambda b: b["type"] == kind)
    uses = of("tool_use")
    text = X.join_content_parts(F.transform(of("text"), lambda b: b["text"]))
    inputs = F.transform(uses, lambda b: F.to_json(b["input"]))
    arg = lambda k: F.transform(uses, lambda b: F.try_variant_get(b["input"], k, "string"))
    known = rows.where((F.size("blocks") > 0) | F.col("plain").isNotNull())
    return turns(
        known, timestamp=X.normalize_timestamp(get("$.timestamp")), platform=F.lit(platform), role=F.lower(F.coalesce(get("$.message.role"), get("$.type"))), content=F.coalesce(F.when(F.size("blocks") == 0, F.col("plain")), text),
        model=get("$.message.model"), session_id=F.coalesce(get("$.sessionId"), F.col("session_stem")), source_file=F.col("source_file"), seq=F.col("line_no"), metadata=F.to_json("v"),
        tool_command=X.first_filled(F.concat(arg("$.command"), arg("$.cmd")), 4000), tool_input=X.first_filled(inputs, 4000), tool_description=X.first_filled(arg("$.description"), 2000),
        workspace=F.coalesce(get("$.cwd"), get("$.workspace")), tool_calls=F.size(uses),
    )


def parse_typed_events(lines: DataFrame, platform: str = "codex") -> DataFrame:
    """Event records: function_call is an assistant turn, outputs are tool turns, messages keep their role."""
    rows = lines.withColumn("p", F.coalesce(F.try_variant_get("v", "$.payload", "variant"), F.col("v")))
    p = lambda path, kind="string": get(path, kind, "p")
    kind = p("$.type")
    rows = rows.withColumn("kind", kind).where(kind.isin("function_call", "function_call_output", "exec_command_end", "message", "user_message", "agent_message"))
    call, out = F.col("kind") == "function_call", F.col("kind").isin("function_call_output", "exec_command_end")
    role = F.when(call, "assistant").when(out, "tool").when(F.col("kind") == "user_message", "user").when(F.col("kind") == "agent_message", "assistant").otherwise(F.coalesce(F.lower(p("$.role")), F.lit("assistant")))
    arguments = F.coalesce(p("$.arguments"), raw_at("$.arguments", "p"))
    parts = X.join_content_parts(F.transform(p("$.content", "array<struct<text:string>>"), lambda b: b["text"]))
    return turns(
        rows, timestamp=X.normalize_timestamp(F.coalesce(get("$.timestamp"), p("$.timestamp"))), platform=F.lit(platform), role=role,
        content=F.coalesce(p("$.output"), p("$.message"), p("$.text"), p("$.content"), parts, F.when(call, arguments), F.lit("")), model=p("$.model"), session_id=F.coalesce(get("$.session_id"), F.col("session_stem")),
        source_file=F.col("source_file"), seq=F.col("line_no"), metadata=F.to_json("v"), tool_command=F.coalesce(F.when(call, X.tool_command_projection(arguments)), p("$.command")), tool_input=F.when(call, F.left(arguments, F.lit(4000))),
        tool_description=F.when(call, p("$.name")), workspace=p("$.cwd"), tool_calls=call.cast("int"),
    )


def parse_envelope_sessions(lines: DataFrame, platform: str = "harness") -> DataFrame:
    """``{type, seq, time, data}`` records; session identity comes from the header record of the same file."""
    head = lines.where(get("$.type") == "session")
    head = head.groupBy("source_file").agg(F.min_by(F.struct(get("$.id").alias("id"), get("$.cwd").alias("cwd"), get("$.parentSession").alias("parent"), get("$.origin").alias("origin")), "line_no").alias("h"))
    rows = lines.join(head, "source_file", "left").withColumn("kind", get("$.type"))
    blocks = F.coalesce(get("$.data.content", "array<struct<type:string,text:string>>"), get("$.data.message.content", "array<struct<type:string,text:string>>"))
    rows = rows.withColumn("blocks", blocks).where(F.col("kind").isin("user", "user/message", "assistant", "assistant/message", "message", "tool/call", "tool/result"))
    call = F.col("kind") == "tool/call"
    result = (F.col("kind") == "tool/result") | F.exists("blocks", lambda b: b["type"].isin("tool-result", "tool_result"))
    role = F.when(call, "assistant").when(result, "tool").otherwise(F.lower(F.coalesce(get("$.data.role"), get("$.data.message.role"), F.split("kind", "/")[0])))
    text = X.join_content_parts(F.transform("blocks", lambda b: b["text"]))
    arguments = F.coalesce(get("$.data.arguments"), raw_at("$.data.arguments"))
    when = F.when(get("$.time", "double") > 1e11, F.timestamp_millis(get("$.time", "long"))).otherwise(X.normalize_timestamp(get("$.time")))
    meta = F.to_json(
        F.struct(
            F.col("h.parent").alias("parent_session"), F.col("h.origin").alias("origin"), F.coalesce(get("$.data.message.source.provider"), get("$.data.source.provider")).alias("provider"),
            get("$.data.usage.inputTokens", "long").alias("input_tokens"), get("$.data.usage.outputTokens", "long").alias("output_tokens"), get("$.data.callId").alias("call_id"),
        )
    )
    return turns(
        rows, timestamp=when, platform=F.lit(platform), role=role, content=F.coalesce(F.when(F.col("blocks").isNotNull(), text), get("$.data.content"), get("$.data.text"), get("$.data.output"), F.when(call, arguments), F.lit("")),
        model=F.coalesce(get("$.data.message.source.model"), get("$.data.source.model"), get("$.data.model")), session_id=F.coalesce("h.id", "session_stem"), source_file=F.col("source_file"), seq=F.coalesce(get("$.seq", "long"), F.col("line_no")),
        metadata=meta, tool_command=F.when(call, X.tool_command_projection(arguments)), tool_input=F.when(call, F.left(arguments, F.lit(4000))), tool_description=F.when(call, get("$.data.name")), workspace=F.col("h.cwd"), tool_calls=call.cast("int"),
    )


def _flat(lines: DataFrame, platform: Column) -> DataFrame:
    """Records that carry role and content themselves, tool fields promoted."""
    calls = "array<struct<name:string,description:string,input:variant,arguments:variant,function:struct<name:string,arguments:variant>>>"
    rows = lines.withColumn("calls", F.coalesce(get("$.tool_calls", calls), F.array(get("$.tool_use", calls[6:-1])), F.array().cast(calls)))
    rows = rows.withColumn("calls", F.filter("calls", lambda c: c.isNotNull()))
    given = F.transform("calls", lambda c: F.coalesce(c["input"], c["arguments"], c["function"]["arguments"]))
    arg = lambda k: F.transform(given, lambda a: F.try_variant_get(a, k, "string"))
    inputs = F.transform(given, lambda a: F.coalesce(F.try_variant_get(a, "$", "string"), F.to_json(a)))
    joined = lambda parts: F.nullif(X.join_content_parts(parts), F.lit(""))
    objects = lambda k: F.transform(get(f"$.{k}", "array<struct<text:string>>"), lambda p: p["text"])
    content = F.coalesce(*[c for k in ("content", "text", "message") for c in (joined(objects(k)), joined(get(f"$.{k}", "array<string>")), get(f"$.{k}"))])
    return turns(
        rows, timestamp=X.normalize_timestamp(F.coalesce(get("$.timestamp"), get("$.created_at"))), platform=platform, role=F.lower(F.coalesce(get("$.role"), get("$.sender"), get("$.author"))), content=content,
        model=F.coalesce(get("$.model"), get("$.model_name")), session_id=F.coalesce(get("$.session_id"), get("$.conversation_id"), get("$.chat_id"), F.col("session_stem")), source_file=F.col("source_file"), seq=F.col("line_no"), metadata=F.to_json("v"),
        tool_command=X.first_filled(F.concat(F.array(get("$.command")), arg("$.command"), arg("$.cmd")), 4000), tool_input=X.first_filled(F.concat(F.array(F.coalesce(get("$.input"), raw_at("$.input"))), inputs), 4000),
        tool_description=X.first_filled(F.concat(F.array(get("$.description")), F.transform("calls", lambda c: c["description"]), arg("$.description")), 2000),
        workspace=F.coalesce(*[get(f"$.{k}") for k in ("workspace", "cwd", "project", "repo", "directory", "git_branch")]), tool_calls=F.size("calls"),
    )


def parse_session_records(lines: DataFrame, platform: str = "hermes") -> DataFrame:
    """Flat records whose model carries over to the records after it in the file."""
    rows = _flat(lines, F.lit(platform)).where("role is not null or content is not null")
    return model_carry_forward(rows, ["source_file"], ["seq"])


def parse_generic_records(lines: DataFrame, platform: str | Column = "unknown") -> DataFrame:
    """Flat records of known roles."""
    return _flat(lines, F.lit(platform) if isinstance(platform, str) else platform).where(F.col("role").isin(*ROLES))


LISTS = ("messages", "turns", "conversation", "chat", "history")


def walk_messages(node, model: str | None = None, session: str | None = None) -> Iterator[tuple[dict, str | None, str | None]]:
    """Messages of a JSON tree with the model and session of the nearest object around them."""
    stack = [(node, model, session)]
    while stack:
        x, m, s = stack.pop()
        if isinstance(x, list):
            stack += [(y, m, s) for y in reversed(x)]
        elif isinstance(x, dict):
            if ("role" in x or "sender" in x or "author" in x) and any(k in x for k in ("content", "text", "message")) and not any(isinstance(x.get(k), list) for k in LISTS):
                yield x, x.get("model") or m, s
                continue
            m = x.get("model") if isinstance(x.get("model"), str) else m
            s = next((str(x[k]) for k in ("session_id", "chat_id", "id") if isinstance(x.get(k), (str, int))), s)
            stack += [(y, m, s) for y in reversed([v for v in x.values() if isinstance(v, (dict, list))])]


def parse_message_documents(docs: DataFrame, platform: str = "unknown") -> DataFrame:
    """Messages anywhere in whole JSON documents (source_file, value), however deep.

    The tree walk is the one step that built-in functions can't express; it runs
    over Arrow batches and yields one JSON line per message for ``_flat``.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b["source_file"], b["value"]):
                try:
                    tree = json.loads(text)
                except (TypeError, ValueError):
                    continue
                stem = str(path).rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for n, (m, model, session) in enumerate(walk_messages(tree)):
                    line = {**m, "model": m.get("model") or model, "session_id": m.get("session_id") or session or stem}
                    rows.append((path, stem, n, json.dumps({k: v for k, v in line.items() if v is not None})))
            yield pd.DataFrame(rows, columns=["source_file", "session_stem", "line_no", "value"])

    lines = docs.select("source_file", "value").mapInPandas(run, "source_file string, session_stem string, line_no long, value string")
    return parse_generic_records(lines.withColumn("v", F.try_parse_json("value")), platform)


def transcript_format(platform: Column, name: Column) -> Column:
    """Parser of a transcript by platform, then by file name; the first test that holds wins."""
    p, n = F.lower(F.coalesce(platform, F.lit(""))), F.lower(name)
    return (
        F.when(p.rlike("harness|dsh") | n.rlike("dsh"), "envelope")
        .when(p.rlike("hermes") | n.rlike("hermes"), "session")
        .when(p.rlike("claude") | n.rlike("claude|subagent"), "blocks")
        .when(p.rlike("codex") | n.rlike("codex|rollout"), "events")
        .when(n.rlike(r"\.json$"), "document")
        .when(n.rlike("session"), "session")
        .otherwise("generic")
    )


PARSERS = {"envelope": parse_envelope_sessions, "session": parse_session_records, "blocks": parse_nested_blocks, "events": parse_typed_events, "generic": parse_generic_records}


def dispatch_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Turns of all transcripts below ``path``, each file by its own parser."""
    lines = read_jsonl(spark, path).withColumn("format", transcript_format(F.element_at(F.split("source_file", "/"), -2), F.col("file_name")))
    out = None
    for name, parse in PARSERS.items():
        part = parse(lines.where(F.col("format") == name), name)
        out = part if out is None else out.unionByName(part)
    return out


# --- chat stores ---------------------------------------------------------------------------------------------------


def chat_store_join(messages: DataFrame, chats: DataFrame, platform: str = "ollama") -> DataFrame:
    """Messages with their chat's model where they name none."""
    c = chats.select(F.col("id").alias("chat_id"), F.col("model").alias("_model"), "title")
    rows = messages.join(c, "chat_id", "left")
    return turns(
        rows, timestamp=X.normalize_timestamp(F.col("created_at").cast("string")), platform=F.lit(platform), role=F.lower("role"), content=F.col("content"), model=F.coalesce(F.when(F.col("model_name") != "", F.col("model_name")), F.col("_model")),
        session_id=F.col("chat_id").cast("string"), source_file=F.lit(f"{platform}.messages"), seq=F.col("seq") if "seq" in messages.columns else F.lit(0), metadata=F.to_json(F.struct("title")),
    )


SLOTS = {
    "role": ("role", "sender", "author", "type"), "content": ("content", "text", "body", "message", "value"), "timestamp": ("timestamp", "created_at", "time", "date", "ts"),
    "model": ("model", "model_name", "llm"), "session_id": ("session_id", "conversation_id", "conv_id", "chat_id", "thread_id"),
}


def autodetect_message_table(df: DataFrame, platform: str, source: str) -> DataFrame:
    """Turns of a table by the first column that fits each slot (S13); null without a content column."""
    low = {c.lower(): c for c in df.columns}
    found = {slot: next((low[n] for n in names if n in low), None) for slot, names in SLOTS.items()}
    if not found["content"]:
        raise ValueError("no column holds message text")
    col = {k: F.col(v).cast("string") for k, v in found.items() if v}
    if "timestamp" in col:
        col["timestamp"] = X.normalize_timestamp(col["timestamp"])
    col["role"] = F.lower(col.get("role", F.lit("unknown")))
    seq = next((low[n] for n in ("seq", "turn", "id") if n in low), None)
    return turns(df, platform=F.lit(platform), source_file=F.lit(source), seq=F.col(seq) if seq else F.lit(0), **col)


def kv_store_messages(df: DataFrame, platform: str = "cursor") -> DataFrame:
    """Messages in JSON values of a key/value table; the key is the source."""
    docs = df.where(F.ltrim("value").rlike(r"^[\[{]")).select(F.concat(F.lit("db:"), "key").alias("source_file"), "value")
    return parse_message_documents(docs, platform)
