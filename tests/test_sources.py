"""Sources, sinks and streams on files of our own with the shapes of FIXTURES.md."""

import json

import pytest
import zstandard
from pyspark.sql import functions as F

from gumshoe.operators import detect, inventory
from gumshoe.operators import rules as R
from gumshoe.plans import planted
from gumshoe.sources import evidence as E
from gumshoe.sources import sinks
from gumshoe.sources import transcripts as T
from gumshoe.streaming import detect as S


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n")
    return str(path)


BLOCKS = [
    {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "listing"}, {"type": "tool_use", "id": "1", "name": "sh", "input": {"command": "ls"}}, {"type": "tool_use", "id": "2", "name": "w", "input": {"file_path": "/a"}}]}},
    {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "id": "1", "content": "x"}]}},
    {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "3", "name": "sh", "input": {"command": "pwd"}}]}},
    {"type": "user", "message": {"role": "user", "content": "plain words"}},
]
EVENTS = [
    {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": "pwd"}), "timestamp": "2024-05-01T10:00:00Z"},
    {"type": "function_call_output", "output": "/tmp"},
    {"type": "exec_command_end", "command": "pwd", "exit_code": 0},
    {"type": "token_count", "n": 3},
]
ENVELOPE = [
    {"type": "session", "id": "S1", "cwd": "/w", "parentSession": "S0", "origin": "sub", "time": 1714557600000},
    {"type": "user", "seq": 1, "time": 1714557601000, "data": {"role": "user", "content": [{"type": "text", "text": "go"}]}},
    {"type": "assistant", "seq": 2, "time": 1714557602000, "data": {"message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}], "source": {"provider": "pp", "model": "mm"}}, "usage": {"inputTokens": 12, "outputTokens": 3}}},
    {"type": "tool/call", "seq": 3, "time": 1714557603000, "data": {"name": "sh", "callId": "c", "arguments": "{\"command\": \"ls\"}"}},
    {"type": "tool/result", "seq": 4, "time": 1714557604000, "data": {"output": "done"}},
    {"type": "token_count", "seq": 5, "data": {}},
]


def test_nested_blocks(spark, tmp_path):
    got = T.parse_nested_blocks(T.read_jsonl(spark, lines(tmp_path / "t.jsonl", BLOCKS))).orderBy("seq").collect()
    assert [r.tool_calls for r in got] == [2, 0, 1, 0]
    assert got[0].tool_command == "ls" and got[0].content == "listing" and got[3].content == "plain words" and got[0].session_id == "t"
    assert inventory.tool_call_count(T.parse_nested_blocks(T.read_jsonl(spark, str(tmp_path)))).first().tool_calls == 3


def test_typed_events(spark, tmp_path):
    got = T.parse_typed_events(T.read_jsonl(spark, lines(tmp_path / "c.jsonl", EVENTS))).orderBy("seq").collect()
    assert [r.role for r in got] == ["assistant", "tool", "tool"] and sum(r.tool_calls for r in got) == 1 and got[0].tool_command == "pwd"


@pytest.mark.parametrize("suffix", ["", ".zst", ".zstd"])
def test_envelope_sessions_plain_and_every_frame(spark, tmp_path, suffix):
    path = tmp_path / f"e.jsonl{suffix}"
    raw = ["\n".join(json.dumps(r) for r in part) + "\n" for part in (ENVELOPE[:2], ENVELOPE[2:])]
    if suffix:
        path.write_bytes(b"".join(zstandard.ZstdCompressor().compress(r.encode()) for r in raw))
    else:
        path.write_text("".join(raw))
    got = T.parse_envelope_sessions(T.read_jsonl(spark, str(path))).orderBy("seq").collect()
    assert [r.role for r in got] == ["user", "assistant", "assistant", "tool"]
    assert {(r.session_id, r.workspace) for r in got} == {("S1", "/w")} and got[1].model == "mm"
    meta = json.loads(got[1].metadata)
    assert (meta["input_tokens"], meta["output_tokens"], meta["provider"], meta["parent_session"]) == (12, 3, "pp", "S0")
    assert got[2].tool_command == "ls" and str(got[0].timestamp) == "2024-05-01 10:00:01"


def test_bad_and_blank_lines(spark, tmp_path):
    path = lines(tmp_path / "x.jsonl", [{"role": "user", "content": "a"}, "", "{broken", {"role": "stranger", "content": "b"}])
    assert T.read_jsonl(spark, path).count() == 2 and T.read_jsonl(spark, path, good=False).count() == 1
    assert [r.content for r in T.parse_generic_records(T.read_jsonl(spark, path)).collect()] == ["a"]


def test_session_records_carry_model(spark, tmp_path):
    rows = [{"role": "user", "content": "a", "model": "m1"}, {"sender": "AI", "text": ["b", "c"]}, {"role": "user", "message": "d", "model": "m2"}, {"role": "tool", "content": "e"}]
    got = T.parse_session_records(T.read_jsonl(spark, lines(tmp_path / "h.jsonl", rows))).orderBy("seq").collect()
    assert [r.model for r in got] == ["m1", "m1", "m2", "m2"] and got[1].content == "b\nc" and got[1].role == "ai"


def test_promoted_tool_fields(spark, tmp_path):
    rows = [{"role": "assistant", "content": "x", "cwd": "/p", "tool_calls": [{"name": "a", "input": {"q": 1}}, {"name": "b", "description": "second", "input": {"command": "make"}}]}]
    r = T.parse_generic_records(T.read_jsonl(spark, lines(tmp_path / "g.jsonl", rows))).first()
    assert (r.tool_command, r.workspace, r.tool_description, r.tool_calls) == ("make", "/p", "second", 2) and json.loads(r.tool_input) == {"q": 1}


def test_message_documents_at_any_depth(spark):
    deep = {"id": "top", "model": "m", "a": {"b": {"c": {"d": {"e": [{"history": [{"role": "user", "content": "deep"}]}]}}}}, "messages": [{"role": "assistant", "content": "flat", "model": "own"}]}
    docs = spark.createDataFrame([("f.json", json.dumps(deep)), ("bad.json", "{no"), ("null.json", None)], "source_file string, value string")
    got = {r.content: (r.model, r.session_id) for r in T.parse_message_documents(docs).collect()}
    assert got == {"deep": ("m", "top"), "flat": ("own", "top")}


def test_dispatch(spark, tmp_path):
    lines(tmp_path / "codex" / "a.jsonl", EVENTS)
    lines(tmp_path / "harness" / "session.jsonl", ENVELOPE)
    lines(tmp_path / "claude" / "b.jsonl", BLOCKS)
    lines(tmp_path / "misc" / "c.jsonl", [{"role": "user", "content": "z"}])
    got = {r.platform: r["count"] for r in T.dispatch_transcripts(spark, str(tmp_path)).groupBy("platform").count().collect()}
    assert got == {"events": 3, "envelope": 4, "blocks": 4, "generic": 1}


@pytest.mark.parametrize("shape", ["list", "files", "collected_files"])
def test_manifest(spark, tmp_path, shape):
    rows = [{"original_path": "/a", "platform": "p", "artifact_type": "log", "size_bytes": 3, "collected_at": "2024-05-01T10:00:00Z"}]
    (tmp_path / "m.json").write_text(json.dumps(rows if shape == "list" else {"tool": "t", shape: rows}))
    r = E.load_manifest(spark, str(tmp_path / "m.json")).first()
    assert (r.original_path, r.size_bytes, str(r.collected_at)) == ("/a", 3, "2024-05-01 10:00:00")


def test_evidence_dir_and_caps(spark, tmp_path):
    lines(tmp_path / "toolx" / "run.log", ["2024-05-01T10:00:00 started", "", "plain"])
    (tmp_path / "toolx" / "bad.txt").write_bytes(b"ok \xff\xfe end")
    (tmp_path / "toolx" / "big.txt").write_text("x" * 5000)
    assert {r.platform for r in E.load_evidence_dir(spark, str(tmp_path)).collect()} == {"toolx"}
    got = {r.source_file.rsplit("/", 1)[1]: r.content for r in E.read_artifact_text(spark, str(tmp_path), max_bytes=4000).collect()}
    assert set(got) == {"run.log", "bad.txt"} and got["bad.txt"].startswith("ok ") and got["bad.txt"].endswith(" end")
    logs = E.read_logs(spark, str(tmp_path / "toolx" / "run.log")).orderBy("line_no").collect()
    assert str(logs[0].timestamp) == "2024-05-01 10:00:00" and logs[1].timestamp is not None


def test_chunks_cover_texts(spark):
    df = spark.createDataFrame([("a" * 25,), ("",), (None,), ("b" * 10,)], "content string")
    rows = E.chunk_text(df, size=10, overlap=3).collect()
    assert sorted(len(r.content) for r in rows if r.content and r.content[0] == "a") == [4, 10, 10, 10]
    assert len(rows) == 7


def test_exports_and_case_rows(spark, tmp_path):
    rows = [("2024-05-01T10:00:00", "a", "user", "hi, \"x\"", "m", "s", "f", 1)]
    df = spark.createDataFrame(rows, "timestamp string, platform string, role string, content string, model string, session_id string, source_file string, seq long")
    df = df.withColumns({"timestamp": F.to_timestamp("timestamp"), "tool_command": F.lit(None).cast("string"), "tool_input": F.lit(None).cast("string"), "tool_description": F.lit(None).cast("string"), "workspace": F.lit(None).cast("string"), "also_in_tools": F.array(F.lit("b"), F.lit("c"))})
    sinks.export_turns_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back["content"] == 'hi, "x"' and back["also_in_tools"] == "b, c" and len(back) == 12
    files = spark.createDataFrame([("f", "body")], ["source_file", "content"]).withColumn("modified_at", F.current_timestamp())
    m = sinks.manifest_rows(df, files).first()
    assert (m.row_count, m.size_bytes, len(m.sha256)) == (1, 4, 64)
    sinks.write_report_tables({"turns": df}, str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "rep" / "turns")).count() == 1


def test_stix_ids_are_stable(spark):
    i = spark.createDataFrame([("ip", "8.8.8.8", "p", "f", "medium")], ["kind", "value", "platform", "source_file", "severity"])
    from gumshoe.operators import mitre

    f = spark.createDataFrame([("F1", "t", "d")], ["id", "title", "description"])
    atlas = mitre.atlas_map_iocs(i)
    make = lambda: {(r.type, r.id) for r in sinks.stix_objects(i, f, atlas, mitre.coa_lookup(atlas)).collect()}
    assert make() == make() and {t for t, _ in make()} >= {"identity", "indicator", "observed-data", "attack-pattern", "relationship", "grouping", "note", "report"}


def test_model_inventory_and_chat_meta(spark):
    files = spark.createDataFrame([("/c/models--org--m/snapshots/abcdef1/config.json", '{"model_type": "llama", "auto_map": {}}'), ("/c/models--org--m/blobs/x", None), ("/c/other", None)], "path string, content string")
    r = inventory.model_inventory(files).first()
    assert (r.model_id, r.commit, r.model_type, r.n_files, r.severity) == ("org/m", "abcdef1", "llama", 2, "high")
    docs = spark.createDataFrame([("a", json.dumps({"messages": [1, 2], "model": "m", "character": "c"})), ("b", "nonsense")], "source_file string, value string")
    got = {r.source_file: (r.n_messages, r.model, r.character) for r in inventory.chat_log_meta(docs).collect()}
    assert got == {"a": (2, "m", "c"), "b": (0, None, None)}


def test_streams_equal_batch(spark, tmp_path):
    lines(tmp_path / "in" / "alpha" / "a.log", ["curl http://203.0.113.7/x", "curl http://203.0.113.7/x", "nothing"])
    lines(tmp_path / "in" / "beta" / "b.log", ["rm -rf /home", "8.8.8.8 seen"])
    stream = S.stream_dedup(S.stream_indicators(S.read_text_stream(spark, str(tmp_path / "in")), R.IOC_RULES))
    q = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.kind, r.value, r.platform) for r in spark.table("found").collect()}
    batch = spark.read.text(str(tmp_path / "in"), recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("content")).withColumn("platform", F.element_at(F.split("source_file", "/"), -2))
    assert got == {(r.kind, r.value, r.platform) for r in detect.scan(batch, R.IOC_RULES).collect()}
    assert spark.table("found").count() == len(got)


def test_registry_is_consistent(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert planted.KEY.startswith("sk-") and len(planted.KEY) > 40


def test_large_files_are_listed_and_few_files_spread(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "small.txt").write_text("a\nb")
    (tmp_path / "p" / "large.txt").write_text("x" * 50)
    assert [r.content for r in E.read_artifact_text(spark, str(tmp_path), 10).collect()] == ["a\nb"]
    row = E.skipped_files(spark, str(tmp_path), 10).first()
    assert row.source_file.endswith("large.txt") and row.size_bytes == 50 and row.reason == "larger than 10 bytes"
    rows = spark.read.text(str(tmp_path / "p" / "small.txt"))
    assert sorted(r.value for r in E.spread(rows).collect()) == ["a", "b"]
