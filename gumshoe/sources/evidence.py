"""Evidence ingestion: manifests, directories, whole texts, log lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.functions import text as X
from gumshoe.sources.lines import numbered_lines

#: Files up to this size are read as one text, larger ones in pieces.
MAX_TEXT = 10 << 20

_FILE = "struct<original_path:string,source_os:string,platform:string,artifact_type:string,size_bytes:bigint,sha256:string,collected_at:string,collector_version:string>"


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of manifests that are a bare list or hold ``files`` or ``collected_files``."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{_FILE}>"))
    held = F.from_json("value", f"struct<files:array<{_FILE}>,collected_files:array<{_FILE}>>")
    rows = raw.select(F.explode(F.coalesce(bare, held["files"], held["collected_files"])).alias("f")).select("f.*")
    return rows.withColumn("collected_at", X.normalize_timestamp(F.col("collected_at")))


def load_evidence_dir(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every file below ``path`` without content: source_file, platform (first folder), artifact_type, size, modified_at."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return raw.select(*_described(path), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def _described(root: str, path: str = "path") -> list[Column]:
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.col(path), "^.*?" + re.escape(base) + "/", "")
    return [F.col(path).alias("source_file"), F.substring_index(rel, "/", 1).alias("platform"), X.guess_artifact_type(F.element_at(F.split(path, "/"), -1)).alias("artifact_type")]


def read_artifact_text(spark: SparkSession, path: str, max_bytes: int = MAX_TEXT, glob: str | None = None) -> DataFrame:
    """Whole texts of files of at most ``max_bytes``, invalid UTF-8 replaced (S3); ``artifact_pieces`` reads the larger ones, which ``skipped_files`` lists."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).where(F.col("length") <= max_bytes)
    return raw.select(*_described(path), F.col("modificationTime").alias("modified_at"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def artifact_pieces(spark: SparkSession, path: str, glob: str | None = None, size: int = 1 << 20, overlap: int = 1 << 10) -> DataFrame:
    """Texts of files of any size as pieces of whole lines: source_file, platform, artifact_type, modified_at, piece, piece_offset, content (S3).

    A piece holds the lines that begin within ``size`` characters, and those that begin within
    ``overlap`` more, so a match of at most ``overlap`` characters is whole in one piece.
    ``dedup_first`` on (file, rule, piece_offset + start) removes those found twice.  A line longer
    than a piece stays whole; ``chunk_text`` cuts it.
    """
    lines = numbered_lines(spark, path, glob)
    piece = F.floor(F.col("offset") / size)
    back = (piece > 0) & (F.col("offset") < piece * size + overlap)
    rows = lines.withColumn("piece", F.explode(F.when(back, F.array(piece - 1, piece)).otherwise(F.array(piece))))
    held = rows.groupBy("source_file", "piece").agg(F.max("modified_at").alias("modified_at"), F.min("offset").alias("piece_offset"), F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("l"))
    described = [c if n else F.col("source_file") for n, c in enumerate(_described(path, "source_file"))]
    return held.select(*described, "modified_at", "piece", "piece_offset", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("content"))


def skipped_files(spark: SparkSession, path: str, max_bytes: int = MAX_TEXT, glob: str | None = None) -> DataFrame:
    """One row per file too large for ``read_artifact_text``, with its size."""
    listed = load_evidence_dir(spark, path, glob)
    return listed.where(F.col("size_bytes") > max_bytes).withColumn("reason", F.concat(F.lit("larger than "), F.lit(max_bytes), F.lit(" bytes")))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores if the scan has fewer partitions than cores, else ``df``.

    A file of one row group is read by one task, which then runs every pattern alone.  Scans
    of many partitions aren't shuffled.  Partitions are planned, not read or listed one by one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_logs(spark: SparkSession, path: str, default_year: int = 2025) -> DataFrame:
    """One row per non-blank log line of files of any size with its number, time of the line or of the file."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    described = [c if n else F.col("source_file") for n, c in enumerate(_described(path, "source_file"))][:2]
    rows = lines.select(*described, "modified_at", "line_no", F.col("value").alias("line"))
    return rows.withColumn("timestamp", F.coalesce(X.log_line_timestamp(F.col("line"), default_year), F.col("modified_at")))


def chunk_text(df: DataFrame, text_col: str = "content", size: int = 64 << 10, overlap: int = 1 << 10) -> DataFrame:
    """Long texts as overlapping chunks with their offset, so a scan skips nothing.

    Matches found twice in an overlap are removed by ``dedup_first`` on (file, rule, offset + start).
    """
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1 - overlap, F.lit(0)), F.lit(step))
    rows = df.withColumn("chunk_offset", F.explode(F.when(F.col(text_col).isNull(), F.array(F.lit(0))).otherwise(starts)))
    return rows.withColumn(text_col, F.substring(F.col(text_col), F.col("chunk_offset") + 1, F.lit(size)))


def browser_history(rows: DataFrame, most: int = 500) -> DataFrame:
    """Newest visits to model sites of a history table, times decoded."""
    from gumshoe.operators.lookup import UNKNOWN_PROVIDER, provider_for_url

    named = rows.withColumn("provider", provider_for_url(F.col("url"))).where(F.col("provider") != UNKNOWN_PROVIDER)
    timed = named.withColumn("visited_at", X.webkit_time(F.col("last_visit_time")))
    return timed.orderBy(F.desc("last_visit_time"), "url").limit(most)


def connections(df: DataFrame) -> DataFrame:
    """Connection rows with domain and port taken from a raw address where they are missing."""
    raw = F.col("address") if "address" in df.columns else F.lit(None).cast("string")
    get = lambda c: F.col(c) if c in df.columns else F.lit(None)
    return df.select("pid", "process", F.coalesce(get("domain").cast("string"), X.extract_domain(raw)).alias("domain"), F.coalesce(get("port").cast("int"), X.extract_port(raw)).alias("port"), get("state").cast("string").alias("state"))
