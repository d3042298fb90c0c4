"""Bounded-space online packing of token sequences.

Each input partition keeps ``open_windows`` windows.  A document's ids are cut
into full windows plus a tail; a tail goes to the open window with the least
room that still holds it (best fit), and when none does, the fullest window is
emitted and a new one opened.  Windows still open at the end of a partition are
merged with those of other partitions by the same rule, largest first; the few
that stay underfull are strung together and cut at window bounds.

Packing runs where the text is read, so only piece descriptors (about 60 bytes
a document) are ever shuffled; they are written to the shared folder before the
leftovers are merged, so a lost executor can't repack differently.

Null texts count as empty (only the end id); texts of any length are cut;
repeated rows are packed once each; an empty table gives no pieces; extra
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gumshoe.llm.common import materialize
from gumshoe.llm.tokenize import codec, vocabulary_path, with_end

WINDOW = 4096
OPEN_WINDOWS = 32
MERGE_WINDOWS = 16_384
#: Texts are encoded and packed in slices of about so many bytes; only their own ids are held.
SLICE = 1 << 20
#: A merged window filled to this share is left alone; emptier ones are strung together.
FULL_SHARE = 0.98
#: Merged sequences are numbered from here, above partition number * 2**36 + count.
MERGED = 1 << 62

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("is_open", T.BooleanType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class BestFit:
    """At most ``open_windows`` open windows; ``place`` returns (window, offset)."""

    def __init__(self, window: int, open_windows: int):
        self.window, self.limit, self.fill, self.by_room, self.made = window, open_windows, {}, [], 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> tuple[int, int]:
        at = bisect_left(self.by_room, (size, -1))
        if at < len(self.by_room):
            room, k = self.by_room.pop(at)
        else:
            if len(self.by_room) >= self.limit:
                del self.fill[self.by_room.pop(0)[1]]
            room, k = self.window, self.new()
            self.fill[k] = 0
        offset = self.fill[k]
        self.fill[k] += size
        if room > size:
            insort(self.by_room, (room - size, k))
        else:
            del self.fill[k]
        return k, offset


def pack_tokens(
    docs: DataFrame, vocabulary: str, end_id: int, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, keep_ids: bool = False
) -> DataFrame:
    """Pieces of packed sequences; with ``keep_ids`` each also carries its little-endian 32-bit ids.

    Pieces of open windows always carry them until the merge, which may cut them: at most
    ``open_windows`` windows a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(window, open_windows)
        base = TaskContext.get().partitionId() << 36
        held: dict[int, list[tuple]] = {}

        def placed(names: list[int], ids: np.ndarray, offsets: np.ndarray) -> list[tuple]:
            done: list[tuple] = []
            for doc, a, b in zip(names, offsets[:-1].tolist(), offsets[1:].tolist()):
                for s in range(a, b, window):
                    n = min(window, b - s)
                    raw = ids[s : s + n].astype("<u4").tobytes()
                    k, at = (fit.new(), 0) if n == window else fit.place(n)
                    piece = (doc, s - a, n, zlib.crc32(raw), b - a, base + k, at, raw)
                    if n == window:
                        done.append(piece if keep_ids else (*piece[:7], None))
                    else:
                        held.setdefault(k, []).append(piece)
            for k in [k for k in held if k not in fit.fill]:
                done += held.pop(k) if keep_ids else [(*p[:7], None) for p in held.pop(k)]
            return done

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, ids, offsets in codec(vocabulary).encode_slices(batch.column(1), SLICE):
                ids, offsets = with_end(ids, offsets, end_id)
                yield _rows(placed(names[first:], ids, offsets), False)
                pa.default_memory_pool().release_unused()
        yield _rows([p for k in held for p in held[k]], True)

    def _rows(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 8
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array([is_open] * len(rows), pa.bool_()), pa.array(cols[7], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=PIECES.names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = materialize(source.mapInArrow(run, PIECES), "packed")
    out = merge_leftovers(pieces, window)
    return out if keep_ids else out.drop("ids")


def _merge(window: int):
    """Merge one group's open windows: best fit by decreasing fill, then string the underfull ones together."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["fill", "old"], ascending=[False, True])
        fit, rows, fill = BestFit(window, len(part) + 1), [], {}
        for old, size in zip(part.old.tolist(), part.fill.tolist()):
            k, at = fit.place(size)
            rows.append((old, k, at))
            fill[k] = at + size
        name, at_of, end = MERGED + (int(part.g.iloc[0]) << 32), {}, 0
        under = sorted((k for k, f in fill.items() if f < FULL_SHARE * window), key=lambda k: (-fill[k], k))
        for k in under:
            at_of[k] = end
            end += fill[k]
        first = len(fill)
        return pd.DataFrame(
            [(old, name, k if k not in at_of else first, at if k not in at_of else at_of[k] + at, k in at_of) for old, k, at in rows],
            columns=["old", "name", "slot", "shift", "strung"],
        )

    return run


def merge_leftovers(pieces: DataFrame, window: int) -> DataFrame:
    """Give the pieces of open windows their final sequence and offset; others stay.

    Groups of about ``MERGE_WINDOWS`` open windows are merged, each in one task.
    """
    opened = pieces.where("is_open")
    fills = opened.groupBy(F.col("sequence_id").alias("old")).agg(F.sum("length").alias("fill"))
    groups = max(1, fills.count() // MERGE_WINDOWS)
    merged = fills.withColumn("g", F.pmod(F.xxhash64("old"), F.lit(groups))).groupBy("g").applyInPandas(_merge(window), "old long, name long, slot long, shift long, strung boolean")
    placed = opened.join(merged.withColumnRenamed("old", "sequence_id"), "sequence_id")
    begin = F.col("shift") + F.col("offset")
    end = begin + F.col("length")
    w = F.lit(window).cast("long")
    cut = F.when(F.col("strung"), F.sequence((begin / w).cast("long"), ((end - 1) / w).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    many = placed.withColumn("begin", begin).withColumn("end", end).withColumn("cell", F.explode(cut))
    low = F.when(F.col("strung"), F.greatest("begin", F.col("cell") * w)).otherwise(F.col("begin"))
    high = F.when(F.col("strung"), F.least("end", (F.col("cell") + 1) * w)).otherwise(F.col("end"))
    many = many.withColumn("low", low).withColumn("high", high)
    whole = F.col("high") - F.col("low") == F.col("length")
    shaped = many.select(
        "doc_id",
        (F.col("start") + F.col("low") - F.col("begin")).alias("start"),
        (F.col("high") - F.col("low")).alias("length"),
        F.when(whole, F.col("ids_crc32")).alias("ids_crc32"),
        "doc_tokens",
        (F.col("name") + F.col("slot") + F.col("cell")).alias("sequence_id"),
        (F.col("low") - F.when(F.col("strung"), F.col("cell") * w).otherwise(0)).alias("offset"),
        F.expr("substring(ids, int((low - begin) * 4 + 1), int((high - low) * 4))").alias("ids"),
    ).withColumn("ids_crc32", F.coalesce("ids_crc32", F.crc32("ids")))
    return pieces.where("not is_open").drop("is_open").unionByName(shaped)


def default_vocabulary() -> str:
    return vocabulary_path("word_bpe_49k.json")
