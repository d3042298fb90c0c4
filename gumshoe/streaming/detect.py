"""Streaming twins of the detection operators.

Detectors are stateless projections, so they run on a stream as they are.
Stateful steps hold state for the watermark only; rows later than it are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gumshoe.operators import detect


def read_text_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Lines of growing transcripts and logs as evidence rows, at most ``files`` files a batch."""
    raw = spark.readStream.option("maxFilesPerTrigger", files).text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("timestamp"), F.col("value").alias("content"))
    return raw.withColumn("platform", F.element_at(F.split("source_file", "/"), -2))


def stream_indicators(stream: DataFrame, rules, time_col: str = "timestamp") -> DataFrame:
    """Indicators of a stream."""
    return detect.scan(stream, rules, id_cols=("source_file", "platform", time_col))


def stream_dedup(indicators: DataFrame, time_col: str = "timestamp", delay: str = "1 hour", keys: tuple[str, ...] = ("kind", "value", "source_file")) -> DataFrame:
    """First of equal indicators within the watermark."""
    return indicators.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch is a folder of its own and replaces what an earlier try of it left, so nothing counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def drain(stream: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None, once: bool = False) -> None:
    """Takes in all that has arrived, in batches, and ends; run again with the same ``checkpoint`` it goes on where it stopped or failed.

    A stream on the clock, as ``stream_escalation`` with ``ttl``, never runs out of batches: ``once`` ends it after one.
    """
    trigger = {"once": True} if once else {"availableNow": True}
    query = stream.writeStream.foreachBatch(write or batch_sink(path)).outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).start()
    query.awaitTermination()


def window_counts(df: DataFrame, keys: list[str], time_col: str = "timestamp", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows per key and tumbling window (X3); the watermark applies to streams only."""
    rows = df.withWatermark(time_col, delay) if df.isStreaming else df
    return rows.groupBy(F.window(time_col, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def session_counts(df: DataFrame, keys: list[str], time_col: str = "timestamp", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Rows per key and session of gaps below ``gap``."""
    rows = df.withWatermark(time_col, delay) if df.isStreaming else df
    return rows.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While streams with ``transformWithState`` are started: the state store that holds lists, timers and time to live."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


class _Escalation(StatefulProcessor):
    """Last flags of a session as a list; a timer, or a time to live, ends it."""

    def __init__(self, span: int, least: int, idle_ms: int, ttl_ms: int | None):
        self.span, self.least, self.idle_ms, self.ttl_ms = span, least, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flags = handle.getListState("flags", "flag int", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        last = [int(r[0]) for r in self.flags.get()]
        turns = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, flag in zip(turns["seq"], turns["flag"]):
            last = [*last, int(flag)][-self.span :]
            if sum(last) >= self.least:
                out.append((*key, int(seq), sum(last)))
        self.flags.put([(f,) for f in last])
        if self.ttl_ms is None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            seen = int(turns["timestamp"].max().timestamp() * 1000)
            self.handle.registerTimer(max(seen, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame(out, columns=["platform", "session_id", "seq", "flagged_in_window"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.flags.clear()
        yield pd.DataFrame([], columns=["platform", "session_id", "seq", "flagged_in_window"])

    def close(self) -> None:
        pass


def stream_escalation(turns: DataFrame, span: int = 5, least: int = 3, idle: str = "30 minutes", delay: str = "10 minutes", ttl: str | None = None) -> DataFrame:
    """(platform, session_id, seq, flagged_in_window): turns at which ``least`` of a session's last ``span`` are flagged.

    ``turns``: platform, session_id, seq, flag, timestamp.  A session's turns must arrive in order of
    ``seq`` from batch to batch; within a batch they are sorted.  Its state is a list of its last
    flags.  It goes once the watermark is ``idle`` past the session's last turn, or, if ``ttl`` is
    given, so long after it was written.  Start it within ``keyed_state``.
    """
    ms = lambda x: int(pd.Timedelta(x).total_seconds() * 1000)
    processor = _Escalation(span, least, ms(idle), ms(ttl) if ttl else None)
    keyed = (turns if ttl else turns.withWatermark("timestamp", delay)).groupBy("platform", "session_id")
    return keyed.transformWithStateInPandas(processor, "platform string, session_id string, seq long, flagged_in_window long", "Append", "ProcessingTime" if ttl else "EventTime")
