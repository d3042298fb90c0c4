"""Lines of large files, ordered scans over split groups, links with bounded samples, streams that stop and go on."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gumshoe.operators import dedup, detect, links, lookup, scans
from gumshoe.operators import rules as R
from gumshoe.sources import evidence as E
from gumshoe.sources import lines as N
from gumshoe.sources import transcripts as T
from gumshoe.streaming import detect as S


@pytest.fixture
def small_ranges(spark):
    """Files are cut every 4 KB."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def big_text(seed, n=3000):
    r = random.Random(seed)
    body = ["" if r.random() < 0.1 else "w%d é\U0001f600 " % k * r.randint(1, 12) for k in range(n)]
    body[n // 2] = "long " * 5000  # longer than several ranges
    return body


def test_lines_are_numbered_as_in_the_whole_file(spark, tmp_path, small_ranges):
    files = {"a.txt": "\n".join(big_text(1)) + "\n", "b.txt": "\r\n".join(big_text(2, 500)), "empty.txt": "", "one.txt": "x"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.txt").write_bytes(b"ok \xff\xfe\nnext\n")
    got = {}
    rows = N.numbered_lines(spark, str(tmp_path))
    for r in rows.collect():
        got.setdefault(r.file_name, {})[r.line_no] = (r.offset, r.value)
    for name, text in files.items():
        want, at = {}, 0
        for n, line in enumerate(text.split("\n")[: None if not text.endswith("\n") else -1] if text else []):
            want[n], at = (at, line.rstrip("\r")), at + len(line) + 1
        assert got.get(name, {}) == want, name
    assert got["bad.txt"][0][1].startswith("ok ") and got["bad.txt"][1][1] == "next"
    blocks = spark.read.text(str(tmp_path / "a.txt")).select("_metadata.file_block_start").distinct().count()
    assert blocks > 20  # so the file was read by ranges


def test_logs_and_transcripts_have_no_size_limit(spark, tmp_path, small_ranges):
    (tmp_path / "toolx").mkdir()
    (tmp_path / "toolx" / "run.log").write_text("\n".join(f"2024-05-01T10:00:00 step {k}" if k % 3 else "" for k in range(5000)))
    logs = E.read_logs(spark, str(tmp_path))
    assert sorted(r.line_no for r in logs.collect()) == [k for k in range(5000) if k % 3]
    assert {r.platform for r in logs.select("platform").distinct().collect()} == {"toolx"}
    (tmp_path / "t.jsonl").write_text("\n".join('{"role": "user", "content": "m%d"}' % k if k % 7 else "{bad" for k in range(2000)))
    got = {r.seq: r.content for r in T.parse_generic_records(T.read_jsonl(spark, str(tmp_path / "t.jsonl"))).collect()}
    assert got == {k: f"m{k}" for k in range(2000) if k % 7}


def test_pieces_of_a_large_file_show_each_match_once(spark, tmp_path, small_ranges):
    r = random.Random(4)
    text = "\n".join("".join(r.choice(["word ", "8.8.%d.%d " % (r.randint(1, 200), r.randint(1, 200))]) for _ in range(r.randint(0, 30))) for _ in range(600))
    (tmp_path / "big.txt").write_text(text)
    pieces = E.artifact_pieces(spark, str(tmp_path), size=3000, overlap=100)
    assert pieces.count() > 10
    assert all(text[p.piece_offset : p.piece_offset + len(p.content)] == p.content for p in pieces.collect())
    found = detect.scan(pieces, R.NETWORK[:1], positions=True, id_cols=("source_file", "platform", "piece_offset"))
    once = found.select("value", (F.col("piece_offset") + F.col("start")).alias("at")).distinct()
    assert sorted((r.at, r.value) for r in once.collect()) == [(m.start(), m[0]) for m in re.finditer(R.NETWORK[0].pattern, text)]


@pytest.fixture(scope="module")
def hot(spark):
    """One group with most rows, ties in the order, null groups and values, a clashing column."""
    r = random.Random(8)
    rows = [("hot" if k % 4 else r.choice(["a", "b", None]), r.randint(0, 60), k, r.choice([None, None, None, "m1", "m2", ""]), r.randint(0, 1), "clash") for k in range(1500)]
    return spark.createDataFrame(rows, "g string, t int, k int, model string, flag int, n string").cache()


@pytest.mark.parametrize("ranges", [1, 13])
def test_scans_equal_plain_windows(spark, hot, ranges):
    w = Window.partitionBy("g").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = scans.running_totals(hot, ["g"], ["t", "k"], {"count": F.lit(1), "sum": F.col("flag")}, ranges)
    assert sorted(map(str, got.collect())) == sorted(map(str, hot.withColumns({"count": F.count("*").over(w), "sum": F.sum("flag").over(w)}).collect()))
    named = F.when(F.col("model") != "", F.col("model"))
    got = scans.carry_forward(hot, ["g"], ["t", "k"], "model", named, ranges)
    assert sorted(map(str, got.collect())) == sorted(map(str, hot.withColumn("model", F.last(named, ignorenulls=True).over(w)).collect()))
    for slide in (5, 64):
        near = Window.partitionBy("g").orderBy("t", "k").rowsBetween(-4, 0)
        got = scans.sliding_sum(hot, ["g"], ["t", "k"], F.col("flag"), 5, "s", slide, ranges)
        assert sorted(map(str, got.collect())) == sorted(map(str, hot.withColumn("s", F.sum("flag").over(near)).collect()))


def test_a_hot_group_is_in_many_ranges_even_if_all_its_rows_tie(spark):
    df = spark.range(4000).select(F.lit("p").alias("platform"), F.lit("same").alias("path"), F.lit(1).cast("long").alias("size"))
    placed = scans._ranged(df, ["platform"], ["path"], 8)
    assert placed.groupBy("_part").count().where("count > 200").count() == 8
    kept, cut = lookup.budgeted_collection(df, 150, 1000)
    assert kept.count() == 150 and cut.first().skipped == 3850
    assert sorted(r.n for r in scans.numbered(df, ["path"], "n").collect()) == list(range(4000))


def test_scans_of_no_rows(hot):
    none = hot.where("false")
    assert scans.running_totals(none, ["g"], ["t"], {"s": F.col("k")}).collect() == []
    assert dedup.model_carry_forward(none, ["g"], ["t"]).collect() == []
    assert dedup.turn_window_escalation(none, "flag", ["g"], "t").collect() == []


def test_links_count_all_and_show_few(spark):
    rows = [("hot", f"f{k % 3000}") for k in range(6000)] + [("b", "x"), ("b", None), (None, "y"), ("none", None)]
    df = spark.createDataFrame(rows, "key string, file string")
    found = {r.key: (r.n, r.sample) for r in links.linked(df.repartition(7), ["key"], "file", 5).collect()}
    again = {r.key: (r.n, r.sample) for r in links.linked(df.repartition(3), ["key"], "file", 5).collect()}
    assert found == again and found["hot"][0] == 3000 and len(set(found["hot"][1])) == 5 and found["hot"][1] == sorted(found["hot"][1])
    assert found["b"] == (1, ["x"]) and found[None] == (1, ["y"]) and found["none"] == (0, [])
    assert links.linked(df.where("false"), ["key"], "file").collect() == []


class Broken(Exception):
    pass


def test_stream_goes_on_where_it_failed_and_counts_nothing_twice(spark, tmp_path):
    for k in range(6):
        (tmp_path / "in" / f"p{k % 2}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"p{k % 2}" / f"{k}.log").write_text("\n".join(f"seen 8.8.{k}.{j} and 9.9.9.9" for j in range(20)) + "\n")
    stream = lambda: S.stream_dedup(S.stream_indicators(S.read_text_stream(spark, str(tmp_path / "in"), files=2), R.NETWORK[:1]), keys=("kind", "value", "platform"))
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    write = S.batch_sink(out)

    def fails(batch, number):
        write(batch, number)
        if number == 1:
            raise Broken("after the write, before the commit")

    with pytest.raises(Exception, match="before the commit"):
        S.drain(stream(), out, log, fails)
    assert spark.read.parquet(out).select("batch").distinct().count() == 2
    S.drain(stream(), out, log)
    got = sorted((r.platform, r.value) for r in spark.read.parquet(out).collect())
    assert got == sorted([(f"p{k % 2}", f"8.8.{k}.{j}") for k in range(6) for j in range(20)] + [("p0", "9.9.9.9"), ("p1", "9.9.9.9")])
    S.drain(stream(), out, log)  # nothing new arrived
    assert spark.read.parquet(out).count() == len(got)


TURN = "platform string, session_id string, seq long, flag boolean, timestamp timestamp"


def arrive(spark, path, seqs, sessions=("s", "t"), start=1735689600):
    rows = [("p", s, q, q in (2, 3, 4, 7, 8), start + 60 * q) for s in sessions for q in seqs]
    df = spark.createDataFrame(rows, "platform string, session_id string, seq long, flag boolean, at long")
    df.select("platform", "session_id", "seq", "flag", F.timestamp_seconds("at").alias("timestamp")).write.mode("append").parquet(path)


def test_escalation_keeps_state_over_a_restart_and_forgets_idle_sessions(spark, tmp_path):
    path, out, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    run = lambda: S.drain(S.stream_escalation(spark.readStream.schema(TURN).parquet(path), 4, 3), out, log)
    with S.keyed_state(spark):
        arrive(spark, path, (3, 0, 1, 2))  # out of order within a batch
        run()
        arrive(spark, path, (4, 5, 6, 7))
        run()
        got = sorted((r.session_id, r.seq, r.flagged_in_window) for r in spark.read.parquet(out).collect())
        assert got == [(s, q, 3) for s in ("s", "t") for q in (4, 5)]
        arrive(spark, path, (0,), ("later",), 1735689600 + 86400)  # the watermark passes the idle sessions
        run()
        arrive(spark, path, (8,), ("s",), 1735689600 + 86400)
        run()
    assert spark.read.parquet(out).where("seq = 8").count() == 0  # with the old flags (6, 7, 8) there would be two only, never three
    assert sorted(r.seq for r in spark.read.parquet(out).where("session_id = 's'").collect()) == [4, 5]


def test_escalation_with_time_to_live(spark, tmp_path):
    path, out, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    arrive(spark, path, range(6))
    with S.keyed_state(spark):
        S.drain(S.stream_escalation(spark.readStream.schema(TURN).parquet(path), 4, 3, ttl="1 hour"), out, log, once=True)
    assert sorted((r.session_id, r.seq) for r in spark.read.parquet(out).collect()) == [(s, q) for s in ("s", "t") for q in (4, 5)]
