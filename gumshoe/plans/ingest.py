"""Registered queries that take transcripts and file lists through ingestion, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.functions import text as X
from gumshoe.operators import correlate, detect, inventory, lookup
from gumshoe.operators import rules as R
from gumshoe.plans import sql
from gumshoe.plans.registry import _ENTROPY as SECRET_ENTROPY
from gumshoe.plans.registry import _SECRET_ARMS as SECRET_ARMS
from gumshoe.plans.registry import ORACLES, evidence, load, query, turns
from gumshoe.sources import evidence as ev
from gumshoe.sources import transcripts
from gumshoe.sources.shared import scratch
from gumshoe.streaming import detect as stream


# --- transcripts ---------------------------------------------------------------------------------------------------

#: Folder of each transcript shape, by conversation number modulo four.
SHAPES = ("claude", "codex", "hermes", "other")


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(platform, value): every turn as a JSON line of its conversation's shape; every third turn holds a tool call."""
    c = load(spark, sf_dir, "conversations").where("text is not null")
    session, call = F.concat(F.lit("conv/"), "conv_id"), F.col("turn") % 3 == 0
    command = F.struct(F.concat(F.lit("ls "), "turn").alias("command"))
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"), F.when(F.lit(False), command).alias("input"))
    used = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("bash").alias("name"), command.alias("input"))
    blocks = F.struct(session.alias("sessionId"), F.struct("role", F.when(call, F.array(said, used)).otherwise(F.array(said)).alias("content")).alias("message"))
    message = F.struct(
        F.when(call, "function_call").otherwise("message").alias("type"), F.when(~call, F.col("role")).alias("role"), F.when(~call, F.col("text")).alias("content"), F.when(call, "bash").alias("name"), F.when(call, F.to_json(command)).alias("arguments")
    )
    events = F.struct(session.alias("session_id"), message.alias("payload"))
    flat = F.struct("role", F.col("text").alias("content"), session.alias("session_id"), F.lit("m1").alias("model"))
    other = F.struct("role", "text", session.alias("chat_id"), F.when(call, F.array(F.struct(F.lit("bash").alias("name"), command.alias("input")))).alias("tool_calls"))
    shape = F.pmod("conv_id", F.lit(4))
    value = F.when(shape == 0, F.to_json(blocks)).when(shape == 1, F.to_json(events)).when(shape == 2, F.to_json(flat)).otherwise(F.to_json(other))
    return c.select(F.element_at(F.array(*map(F.lit, SHAPES)), (shape + 1).cast("int")).alias("platform"), value.alias("value"))


def transcripts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "transcripts")
    transcript_lines(spark, sf_dir).write.partitionBy("platform").option("maxRecordsPerFile", 20_000).text(path)
    return transcripts.dispatch_transcripts(spark, path)


_TURNS = (
    "t AS (SELECT 'conv/' || conv_id AS session_id, role AS said_by, text, turn, turn % 3 = 0 AS call, conv_id % 4 AS shape, ['blocks', 'events', 'session', 'generic'][CAST(conv_id % 4 + 1 AS INT)] AS platform FROM conversations WHERE text IS NOT NULL), "
    "r AS (SELECT session_id, platform, CASE WHEN shape = 1 AND call THEN 'assistant' ELSE said_by END AS role, CASE WHEN shape = 1 AND call THEN '{\"command\":\"ls ' || turn || '\"}' ELSE text END AS content, "
    "CASE WHEN shape <> 2 AND call THEN 1 ELSE 0 END AS calls FROM t)"
)


@query(f"WITH {_TURNS} SELECT platform, session_id, role, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) FILTER (calls = 1) AS n_commands FROM r GROUP BY ALL")
def transcript_turns(spark, sf_dir):
    """Transcripts of four shapes, written as JSON lines and read by their folders' parsers."""
    found = transcripts_read(spark, sf_dir)
    return found.groupBy("platform", "session_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.count_if(F.col("tool_command").startswith("ls ")).alias("n_commands"))


@query(f"WITH {_TURNS} SELECT platform, session_id, CAST(sum(calls) AS BIGINT) AS tool_calls FROM r GROUP BY ALL")
def tool_calls_by_session(spark, sf_dir):
    """Tool calls of each session of the transcripts."""
    return inventory.tool_call_count(transcripts_read(spark, sf_dir))


@query(
    "SELECT 'sess-' || conv_id AS session_id, '/work/' || (conv_id % 5) AS workspace, role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CASE WHEN role = 'assistant' THEN 10 + turn ELSE 0 END) AS BIGINT) AS tokens "
    "FROM conversations WHERE text IS NOT NULL GROUP BY ALL"
)
def envelope_turns(spark, sf_dir):
    """A header record a conversation and enveloped messages, with identity, workspace and token usage from the records."""
    c = load(spark, sf_dir, "conversations").where("text is not null")
    name = F.concat(F.lit("sess-"), "conv_id")
    head = c.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("line_no"), F.to_json(F.struct(F.lit("session").alias("type"), name.alias("id"), F.concat(F.lit("/work/"), F.pmod("conv_id", F.lit(5))).alias("cwd"))).alias("value"))
    usage = F.when(F.col("role") == "assistant", F.struct((F.lit(10) + F.col("turn")).alias("inputTokens")))
    data = F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"), usage.alias("usage"))
    body = c.select("conv_id", (F.col("turn") + 1).cast("long").alias("line_no"), F.to_json(F.struct(F.lit("message").alias("type"), F.col("turn").alias("seq"), data.alias("data"))).alias("value"))
    lines = head.unionByName(body).select(F.concat(F.lit("f/"), "conv_id").alias("source_file"), F.lit("stem").alias("session_stem"), "line_no", "value", F.parse_json("value").alias("v"))
    found = transcripts.parse_envelope_sessions(lines)
    tokens = F.coalesce(F.get_json_object("metadata", "$.input_tokens").cast("long"), F.lit(0))
    return found.groupBy("session_id", "workspace", "role").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.sum(tokens).alias("tokens"))


# --- files of any size ---------------------------------------------------------------------------------------------


@query("SELECT doc_id % 2 = 0 AS packed, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, true AS gapless FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def jsonl_lines(spark, sf_dir):
    """Documents written as plain and as compressed JSON lines and read back with their line numbers, which have no gap in any file."""
    path = scratch(spark, "jsonl")
    docs = load(spark, sf_dir, "documents").where("text is not null")
    for packed, how in ((False, "none"), (True, "gzip")):
        docs.where((F.col("doc_id") % 2 == 0) == packed).select(F.to_json(F.struct("source", "text")).alias("value")).write.option("compression", how).text(f"{path}/{how}")
    lines = transcripts.read_jsonl(spark, path)
    gapless = lines.groupBy("source_file").agg((F.max("line_no") + 1 == F.count_distinct("line_no")).alias("ok")).agg(F.bool_and("ok").alias("gapless"))
    rows = lines.select(F.contains("source_file", F.lit("/gzip/")).alias("packed"), transcripts.get("$.source").alias("source"), F.length(transcripts.get("$.text")).alias("size"))
    return rows.groupBy("packed", "source").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).join(F.broadcast(gapless))


_LINES = "l AS (SELECT 'platform=' || source AS platform, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"
_LINE_SEVERITY = "CASE " + " ".join(f"WHEN regexp_matches(line, {sql.lit(p)}) THEN '{s}'" for s, p in X.SEVERITY_PATTERNS) + " ELSE 'info' END"


def text_files(spark: SparkSession, sf_dir: str, tag: str) -> str:
    """Texts of all documents as lines of files, in a folder for each source."""
    path = scratch(spark, tag)
    load(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("platform"), F.col("text").alias("value")).write.partitionBy("platform").text(path)
    return path


@query(f"WITH {_LINES} SELECT platform, {_LINE_SEVERITY} AS severity, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars, true AS dated FROM l WHERE trim(line) <> '' GROUP BY ALL")
def log_lines(spark, sf_dir):
    """Texts written as log files and read back line by line; undated lines take the file's time."""
    lines = ev.read_logs(spark, text_files(spark, sf_dir, "logs"))
    return lines.groupBy("platform", X.infer_severity(F.col("line")).alias("severity")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"), F.bool_and(F.col("timestamp").isNotNull()).alias("dated"))


@query(f"WITH {sql.DOCS}, {sql.iocs(R.NETWORK)} SELECT 'platform=' || platform AS platform, rule, value, count(*) AS n FROM iocs GROUP BY ALL")
def piece_indicators(spark, sf_dir):
    """Network indicators of files read in overlapping pieces of whole lines, each counted once."""
    pieces = ev.artifact_pieces(spark, text_files(spark, sf_dir, "pieces"), size=1 << 16)
    found = detect.ioc_network(pieces.where("content is not null"), positions=True, id_cols=("source_file", "platform", "piece_offset"))
    once = found.select("source_file", "platform", "rule", "value", (F.col("piece_offset") + F.col("start")).alias("at")).distinct()
    return once.groupBy("platform", "rule", "value").agg(F.count("*").alias("n"))


@query("SELECT 'platform=' || source AS platform, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(strlen(text) + 1) AS BIGINT) AS text_bytes, CAST(sum(strlen(text) + 1) AS BIGINT) AS manifest_bytes, true AS same_files FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def evidence_folder(spark, sf_dir):
    """Folders of texts and their manifests, written and read back: the same files, the same sizes."""
    path = scratch(spark, "folder")
    docs = load(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("platform"), F.col("text").alias("value"))
    docs.write.partitionBy("platform").option("maxRecordsPerFile", 50).text(f"{path}/files")
    listed = ev.load_evidence_dir(spark, f"{path}/files", "part-*")
    entry = F.struct(F.col("source_file").alias("original_path"), "platform", "artifact_type", "size_bytes", F.col("modified_at").cast("string").alias("collected_at"))
    shares = listed.groupBy("platform", F.pmod(F.xxhash64("source_file"), F.lit(16))).agg(F.to_json(F.struct(F.collect_list(entry).alias("files"))).alias("value"))
    shares.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/manifests")
    texts = ev.read_artifact_text(spark, f"{path}/files", glob="part-*").select("source_file", F.octet_length("content").alias("text_bytes"))
    told = ev.load_manifest(spark, f"{path}/manifests").select(F.col("original_path").alias("source_file"), F.col("size_bytes").alias("manifest_bytes"))
    both = listed.join(texts, "source_file", "full").join(told, "source_file", "full")
    same = F.coalesce((F.col("size_bytes") == F.col("text_bytes")) & (F.col("size_bytes") == F.col("manifest_bytes")), F.lit(False))
    return both.groupBy("platform").agg(*[F.sum(c).cast("long").alias(n) for c, n in (("size_bytes", "bytes"), ("text_bytes", "text_bytes"), ("manifest_bytes", "manifest_bytes"))], F.bool_and(same).alias("same_files"))


# --- streams -------------------------------------------------------------------------------------------------------


@query(f"WITH {sql.DOCS}, i AS ({sql.scan(R.NETWORK + R.HASHES)}) SELECT 'platform=' || platform AS platform, kind, count(DISTINCT value) AS n FROM i GROUP BY ALL")
def stream_indicators(spark, sf_dir):
    """Indicators of a stream of files, each once however many batches hold it."""
    path, out = text_files(spark, sf_dir, "stream"), scratch(spark, "stream-out")
    found = stream.stream_indicators(stream.read_text_stream(spark, path, files=20), R.NETWORK + R.HASHES)
    once = stream.stream_dedup(found, delay="1 day", keys=("kind", "value", "platform"))
    stream.drain(once, out, scratch(spark, "stream-log"))
    return spark.read.parquet(out).groupBy("platform", "kind").agg(F.count("*").alias("n"))


@query(ORACLES["turn_window_escalation"])
def stream_escalations(spark, sf_dir):
    """Turns arriving in two lots, flagged and counted by a stateful stream; equal to the batch operator's SQL."""
    path, out = scratch(spark, "turns"), scratch(spark, "turns-out")
    flag = F.lit(False)
    said = F.concat_ws("\n", "content", "tool_command")
    for r in R.TURN_RULES:
        flag = flag | said.rlike(X.in_java(r.pattern))
    rows = turns(spark, sf_dir).select("platform", "session_id", "seq", flag.alias("flag"), F.timestamp_seconds(F.lit(1735689600) + 60 * F.col("seq")).alias("timestamp"))
    for early in (True, False):
        rows.where((F.col("seq") < 3) == early).write.mode("append").parquet(path)
    arriving = spark.readStream.schema(rows.schema).parquet(path)
    with stream.keyed_state(spark):
        stream.drain(stream.stream_escalation(arriving, 5, 2), out, scratch(spark, "turns-log"))
    return spark.read.parquet(out).select("platform", "session_id", "seq", "flagged_in_window")


# --- names and filters ---------------------------------------------------------------------------------------------


def _one_of(column: str, *values: str):
    """One of ``values`` by a number modulo their count."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(column), F.lit(len(values))) + 1).cast("int"))


@query(
    "SELECT ['database', 'conversation', 'log', 'config', 'history', 'conversation', 'unknown', 'config', 'conversation'][CAST(doc_id % 9 + 1 AS INT)] AS artifact_type, count(*) AS n, count(DISTINCT source) AS n_platforms FROM documents GROUP BY ALL"
)
def artifact_types(spark, sf_dir):
    """artifact types of file names."""
    names = load(spark, sf_dir, "documents").select("source", F.concat("source", F.lit("-"), "doc_id", _one_of("doc_id", ".db", ".jsonl", ".LOG", ".yaml", "_history", "-chat", ".bin", ".json", ".jsonl.zst")).alias("name"))
    return names.groupBy(X.guess_artifact_type(F.col("name")).alias("artifact_type")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_platforms"))


@query(
    "SELECT CASE WHEN page_id % 3 = 0 THEN NULL ELSE lower(regexp_extract(url, '://([^/:?#]+)', 1)) END AS domain, CASE WHEN page_id % 2 = 0 THEN CAST(1000 + page_id % 50 AS INT) END AS port, count(*) AS n FROM pages GROUP BY ALL"
)
def hosts_and_ports(spark, sf_dir):
    """host and port of connection lines."""
    host = F.when(F.col("page_id") % 3 == 0, "127.0.0.1").otherwise(F.regexp_extract("url", "://([^/:?#]+)", 1))
    line = F.concat(F.lit("TCP "), host, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(":"), (F.lit(1000) + F.col("page_id") % 50).cast("string"))).otherwise(""))
    lines = load(spark, sf_dir, "pages").select(line.alias("line"))
    return lines.groupBy(X.extract_domain(F.col("line")).alias("domain"), X.extract_port(F.col("line")).alias("port")).agg(F.count("*").alias("n"))


@query(
    "SELECT * FROM (SELECT 'env_var' AS filter, source, count(*) FILTER (doc_id % 5 IN (0, 2, 4)) AS n FROM documents GROUP BY source UNION ALL SELECT 'image', source, count(*) FILTER (doc_id % 5 IN (0, 2, 4)) FROM documents GROUP BY source "
    "UNION ALL SELECT 'llama', source, count(*) FILTER (doc_id % 4 IN (0, 2)) FROM documents GROUP BY source UNION ALL SELECT 'linux', source, count(*) FILTER (doc_id % 3 = 1) FROM documents GROUP BY source "
    "UNION ALL SELECT 'toggles', source, count(*) FILTER (doc_id % 5 IN (2, 4)) FROM documents GROUP BY source) WHERE n > 0"
)
def collection_filters(spark, sf_dir):
    """Rows that each collection predicate passes, by platform."""
    rows = load(spark, sf_dir, "documents").select(
        "source", _one_of("doc_id", "OPENAI_API_KEY", "PATH", "hf_token", "HOME", "Azure_OpenAI_Endpoint").alias("env"), _one_of("doc_id", "ollama/ollama:1", "postgres:16", "ghcr.io/open-webui/open-webui", "nginx", "VLLM/vllm-openai").alias("image"),
        _one_of("doc_id", "llama-cli -m x", "ls -l", "ollama run LLAMA3", "pwd").alias("line"), _one_of("doc_id", "macOS", "Linux", "windows").alias("source_os"), _one_of("doc_id", "conversation", "log", "config", "deep_text", "database").alias("artifact_type"),
    )
    parts = {
        "env_var": rows.where(lookup.ai_env_var(F.col("env"))), "image": rows.where(lookup.ai_image(F.col("image"))), "llama": lookup.llama_history(rows), "linux": lookup.on_os(rows, "Linux"), "toggles": lookup.collection_toggles(rows, chat_history=False, logs=False),
    }
    every = lookup.chain(*[df.select(F.lit(name).alias("filter"), "source") for name, df in parts.items()])
    return every.groupBy("filter", "source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def largest_documents(spark, sf_dir):
    """T5: the first rows of a stated order, for a report."""
    return correlate.capped(load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), 25, F.desc("n_chars"), "doc_id")


# --- secrets -------------------------------------------------------------------------------------------------------


_FOUND = (
    f"WITH {sql.WITH_PLANTED}, s AS (SELECT *, {SECRET_ENTROPY} AS e FROM ({SECRET_ARMS}) WHERE NOT regexp_matches(v, {sql.lit(R.PLACEHOLDER)})), "
    "k AS (SELECT *, left(v, 4) || '...' || right(v, 4) || ' (' || length(v) || ' chars)' AS redacted FROM s WHERE e >= least)"
)


@query(f"{_FOUND} SELECT rule, 'api_key' AS kind, 'critical' AS severity, platform, count(*) AS n, count(DISTINCT redacted) AS n_values FROM k GROUP BY ALL")
def secret_indicators(spark, sf_dir):
    """Secrets as redacted indicators, by rule and platform."""
    found = detect.ioc_secret(evidence(spark, sf_dir, True))
    return found.groupBy("rule", "kind", "severity", "platform").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query(f"{_FOUND} SELECT redacted, rule, count(*) AS n, count(DISTINCT source_file) AS n_files, 'critical' AS severity FROM k GROUP BY ALL")
def code_secrets(spark, sf_dir):
    """Secrets of source files by redacted form."""
    found = detect.scan_code_secrets(evidence(spark, sf_dir, True))
    return found.select("redacted", "rule", "n", "n_files", "severity")
