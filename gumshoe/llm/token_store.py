"""Token-id files in patched frame-of-reference blocks.

A file holds a run of documents in ascending id order as a row of groups::

    "PFOR" | version u16 | mask u16 | bytes u64 | part u32 | group u32
           | documents u64 | tokens u64 | blocks u64                        header, 48 bytes
    document ids        i64 * documents
    null marks          u8 * documents    1 where the document has no id
    document lengths    u32 * documents
    block starts        u64 * blocks      byte offset of each block from the first
    blocks              each BLOCK ids but the last
    "\\nPFE\\n"                             end mark, written by Spark's text sink as its line end

All after the header's first 8 bytes is XORed with its mask, the least byte with
which no end mark arises inside the group, so Spark's text source reads groups
one by one, in as many tasks as a file has splits.

A block is ``minimum u32 | width u8 | exceptions u16 | pad u8``, the low ``width``
bits of every id less the minimum (bit-packed, little-endian), then the
exceptions' places (u16) and high parts (u32).  The width is that which holds
the ``PERCENTILE`` lowest values, so a few large ids don't widen a block.

Documents are range-partitioned by id, then by a hash of the text and a number
from the scan, so one hot or missing id spreads over ranges; (part, group) in the
headers gives the order over all files.  A range of about ``RANGE_BYTES`` of text
is a file, and a group is closed at ``GROUP_TOKENS`` tokens (or one document), so
tasks hold a group at a time.  A group is one value of Spark's text sink, whose
commit protocol makes the write safe when an executor is lost.  Starts come from
totals: groups are summed inside their file and files, a row each, in one window.

Null and empty texts hold only the end id; repeated ids keep all their rows; ids
are integers of up to 64 bits (others are refused); null ids sort first; an empty
table writes no document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gumshoe.llm.common import materialize, new_path, small
from gumshoe.llm.tokenize import codec, with_end

BLOCK = 1024
PERCENTILE = 90
END = "\nPFE\n"
RANGE_BYTES = 128 << 20
GROUP_TOKENS = 2 << 20
ROWS_AT_ONCE = 6000
_HEAD = struct.Struct("<4sHHQIIQQQ")
_CLEAR = 8
_BLOCK = struct.Struct("<IBHB")


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Low ``width`` bits of each value, end to end, least significant first."""
    if not width:
        return b""
    bits = (values.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def encode_block(ids: np.ndarray) -> bytes:
    least = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(least)
    k = min(len(rest) - 1, len(rest) * PERCENTILE // 100)
    width = int(np.partition(rest, k)[k]).bit_length()
    at = np.flatnonzero(rest >> np.uint32(width))
    return _BLOCK.pack(least, width, len(at), 0) + pack_bits(rest, width) + at.astype("<u2").tobytes() + (rest[at] >> np.uint32(width)).astype("<u4").tobytes()


def decode_block(raw: memoryview, n: int) -> np.ndarray:
    least, width, odd, _ = _BLOCK.unpack_from(raw)
    at = _BLOCK.size
    size = (n * width + 7) // 8
    out = unpack_bits(raw[at : at + size], width, n)
    at += size
    if odd:
        where = np.frombuffer(raw, "<u2", odd, at)
        out[where] |= np.frombuffer(raw, "<u4", odd, at + 2 * odd).astype(np.uint32) << np.uint32(width)
    return out + np.uint32(least)


def encode_group(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray, part: int = 0, group: int = 0) -> bytes:
    blocks = [encode_block(ids[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    body = b"".join([doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), lengths.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), *blocks])
    for mask in range(256):
        raw = bytearray(_HEAD.pack(b"PFOR", 3, mask, _HEAD.size + len(body), part, group, len(doc_ids), len(ids), len(blocks)) + body)
        if mask:
            np.frombuffer(raw, np.uint8)[_CLEAR:] ^= mask
        if (raw + END.encode()).find(END.encode()) == len(raw):
            return bytes(raw)
    raise ValueError("every mask leaves an end mark inside a group: write smaller groups")


class Group:
    """One group of a token file: only blocks that are asked for are decoded."""

    def __init__(self, raw: memoryview):
        kind, version, mask = struct.unpack_from("<4sHH", raw)
        if kind != b"PFOR" or version != 3:
            raise ValueError("not a token file")
        if mask:
            plain = np.frombuffer(raw, np.uint8).copy()
            plain[_CLEAR:] ^= mask
            raw = memoryview(plain)
        self.bytes, self.part, self.group, docs, self.tokens, blocks = _HEAD.unpack_from(raw)[3:]
        at = _HEAD.size
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.nulls = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
        at += 13 * docs
        self.starts = np.frombuffer(raw, "<u8", blocks, at)
        self.blocks = raw[at + 8 * blocks : self.bytes]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the group, decoding only the blocks that hold them."""
        stop = self.tokens if stop is None else min(stop, self.tokens)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        got = [decode_block(self.blocks[int(self.starts[k]) :], min(BLOCK, self.tokens - k * BLOCK)) for k in range(first, last + 1)]
        return np.concatenate(got)[start - first * BLOCK : stop - first * BLOCK]


def groups(raw: bytes) -> Iterator[Group]:
    """The groups of a file."""
    for one in raw.split(END.encode())[:-1]:
        yield Group(memoryview(one))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, text: str = "text", id_col: str = "doc_id") -> None:
    """Tokenize ``docs`` and write token files below ``path``, in ascending id order of files and rows."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{id_col} isn't an integer column")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Files follow from RANGE_BYTES; a small corpus has a dozen of a megabyte or more, so that it keeps a dozen cores busy.
    ranges = max(1, -(-total // RANGE_BYTES), min(12, total >> 20))
    order = ["doc_id", "by_text", "by_place"]
    keyed = source.withColumn("by_text", F.xxhash64("text")).withColumn("by_place", F.xxhash64(F.monotonically_increasing_id()))
    ordered = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, tokens = TaskContext.get().partitionId(), 0, [], 0

        def group() -> pa.RecordBatch:
            doc_ids, nulls, lengths, ids = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([encode_group(doc_ids, nulls, lengths, ids, part, number)], pa.binary())], names=["group"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                ids, offsets = with_end(*codec(vocabulary).encode(some.column(1)), end_id)
                nulls = np.asarray(some.column(0).is_null())
                held.append((some.column(0).fill_null(0).to_numpy(), nulls, np.diff(offsets), ids))
                tokens += len(ids)
                if tokens >= GROUP_TOKENS:
                    yield group()
                    number, held, tokens = number + 1, [], 0
        if held:
            yield group()

    written = ordered.mapInArrow(run, "group binary")
    written.select(F.col("group").cast("string").alias("value")).write.option("lineSep", END).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, group, within, n_tokens, ids_crc32) of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for g in (Group(memoryview(raw.as_buffer())),):
                    ends = np.cumsum(g.lengths, dtype=np.int64)
                    wide = memoryview(g.ids().astype("<u4").tobytes())
                    crc = [zlib.crc32(wide[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), g.lengths.tolist())]
                    doc_ids = pa.array(g.doc_ids.astype(np.int64), mask=g.nulls)
                    cols = [np.full(len(crc), g.part, np.int64), np.full(len(crc), g.group, np.int64), ends - g.lengths, g.lengths.astype(np.int64), np.array(crc, np.int64)]
                    yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, cols)], names=["doc_id", "part", "group", "within", "n_tokens", "ids_crc32"])

    raw = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary"))
    return raw.mapInArrow(run, "doc_id long, part long, group long, within long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, vocabulary: str, end_id: int, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Write the token files and return one row per document as read back, with its global start."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id, text, id_col)
    rows = materialize(read_tokens(spark, path), "token-rows")
    per_group = rows.groupBy("part", "group").agg(F.sum("n_tokens").alias("tokens"))
    earlier = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = per_group.select("part", "group", earlier(Window.partitionBy("part").orderBy("group")).alias("inside"))
    files = per_group.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # a row per RANGE_BYTES of text
    files = files.select("part", earlier(Window.orderBy("part")).alias("before"))
    starts = materialize(inside.join(files, "part").select("part", "group", (F.col("before") + F.col("inside")).alias("first")), "token-starts")
    return rows.join(small(starts), ["part", "group"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
