"""Lines of files of any size, numbered as in the whole file.

Spark reads a large file in byte ranges, each by a task of its own, so a line only
knows its place in its range.  ``numbered_lines`` counts lines and characters within
each range as they stream by, then adds the sums of the ranges before it: one row a
range, a prefix sum per file.  No file is ever one row or one task, and nothing is
sorted or shuffled but these sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gumshoe.sources.shared import written

#: Ranges up to which their sums are broadcast; beyond, lines are joined to them by a shuffle.
BROADCAST_RANGES = 1_000_000


def _places(batches):
    """Adds each line's place in its range: lines and characters before it."""
    last, line, char = None, 0, 0
    for batch in batches:
        if not len(batch):
            continue
        files, blocks = batch["source_file"].dictionary_encode(), batch["block"].to_numpy()
        size = batch["size"].to_numpy()
        code = files.indices.to_numpy()
        starts = np.flatnonzero((np.diff(code) != 0) | (np.diff(blocks) != 0)) + 1
        lines, chars = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
        for a, b in zip([0, *starts], [*starts, len(batch)]):
            if (key := (files.dictionary[code[a]].as_py(), int(blocks[a]))) != last:
                last, line, char = key, 0, 0
            lines[a:b] = line + np.arange(b - a)
            chars[a:b] = char + np.cumsum(size[a:b]) - size[a:b]
            line, char = line + b - a, char + int(size[a:b].sum())
        yield batch.append_column("line", pa.array(lines)).append_column("char", pa.array(chars))


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(source_file, file_name, modified_at, line_no, offset, value) of each line below ``path``; numbers and offsets from 0.

    Lines end at ``\\n``; a ``\\r`` before it belongs to the end.  ``offset`` counts the characters
    before the line, ends included.  Invalid UTF-8 is replaced.  Compressed files are read whole by
    one task.  The lines are written to the shared folder once, so that numbers and text come from
    the same reading however the ranges are cut.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    meta = lambda name: F.col(f"_metadata.{name}")
    raw = raw.select(meta("file_path").alias("source_file"), meta("file_name").alias("file_name"), meta("file_modification_time").alias("modified_at"), meta("file_block_start").alias("block"), F.make_valid_utf8("value").alias("value"))
    raw = raw.withColumn("size", F.length("value") + 1)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.schema)
    lines = written(raw.mapInArrow(_places, f"{kinds}, line long, char long"), "lines")
    ranges = lines.groupBy("source_file", "block").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(ranges.select("source_file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before")), "line-ranges")
    found = lines.join(F.broadcast(sums) if sums.count() <= BROADCAST_RANGES else sums, ["source_file", "block"])
    return found.select("source_file", "file_name", "modified_at", (F.col("lines_before") + F.col("line")).alias("line_no"), (F.col("chars_before") + F.col("char")).alias("offset"), F.regexp_replace("value", "\r$", "").alias("value"))
