"""WARC archives with revisit records.

``write_archives`` gives every page one WARC record, a gzip member of its own.
Headers alone (id, digest, size) are grouped by payload digest to find the page
that holds the payload; revisits are joined back to their pages by id and
digest, broadcast where they are few, so a hot digest never gathers in one task.
Each task joins its records to archives of at most ``FILE_BYTES`` (or one record)
and writes each as one value of Spark's text sink, a file of its own, so the
commit protocol covers lost executors and any store that Spark writes to works.
The sink's line end is an empty gzip member, which readers pass over.

``read_archives`` parses the archives by Content-Length and, for revisits, takes
the digest and size from the record's headers.

Null payloads count as empty; equal rows (same id and payload) give one response
and else revisits to it, all with record ids of their own; rows without an id are
responses only where no equal payload has an id; an empty table writes no record;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.llm.common import materialize, new_path, small

END = b"\r\n\r\n"
#: A gzip member of no bytes.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes of an archive file at most, unless one record has more.
FILE_BYTES = 64 << 20
BATCH_BYTES, STEP = 16 << 20, 16 << 10
B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """Upper-case base32 of a binary column's SHA-1, by 5-bit pieces of its hex form."""
    hexed = F.sha1(payload)
    pieces = []
    for k in range(8):  # 5 hex digits hold 4 base32 letters
        n = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        pieces += [F.substring(F.lit(B32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*pieces)


def _uuid(column):
    h = F.md5(column)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def resolve(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload: str = "html") -> DataFrame:
    """``pages`` as (page_id, url, payload, digest, bytes, turn, record_type, refers_to); the largest id of equal payloads responds.

    ``turn`` tells rows of one id and payload apart; it is 0 for the first of them.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    url = F.coalesce(F.col("url"), F.lit("about:blank")) if "url" in pages.columns else F.lit("about:blank")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(url, r"[\x00-\x20]", "%20").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    heads = materialize(rows.select("page_id", "digest", "bytes"), "warc-heads")
    # All records of a payload that occurs once respond; only shared digests need a join.
    shared = heads.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    revisits = heads.join(shared.select("digest", "holder"), "digest").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "holder").distinct()
    same = (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id"))
    joined = rows.join(small(materialize(revisits, "warc-revisits")), same, "left").drop("_id", "_digest")
    repeated = materialize(heads.groupBy("page_id", "digest").count().where("count > 1").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest")), "warc-repeated")
    if repeated.count():
        # Rows of one id and payload are numbered by their place; a combinable minimum finds the first, so a hot id needs no single task.
        repeated = small(repeated)
        again = materialize(joined.join(repeated, same, "left_semi").withColumn("turn", F.monotonically_increasing_id()), "warc-again")
        first = again.groupBy(F.col("page_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.min("turn").alias("_first"))
        again = again.join(small(materialize(first, "warc-first")), same).withColumn("turn", F.when(F.col("turn") == F.col("_first"), 0).otherwise(F.col("turn") + 1))
        joined = joined.join(repeated, same, "left_anti").withColumn("turn", F.lit(0).cast("long")).unionByName(again.drop("_id", "_digest", "_first"))
    else:
        joined = joined.withColumn("turn", F.lit(0).cast("long"))
    lone = F.col("holder").isNull() & (F.col("page_id").isNotNull() | (F.col("bytes") < least_bytes))
    own = lone | (F.col("page_id").eqNullSafe(F.col("holder")) & (F.col("turn") == 0))
    kind = F.when(own, "response").otherwise("revisit")
    return joined.select("page_id", "url", "payload", "digest", "bytes", "turn", kind.alias("record_type"), F.when(~own, F.col("holder")).alias("refers_to"))


def record(resolved: DataFrame) -> DataFrame:
    """(head, block) of every record: the WARC header block with its blank line, and the content."""

    def id_of(page, digest, turn):
        return F.concat(F.lit("<urn:uuid:"), _uuid(F.concat_ws(" ", F.lit("page"), F.coalesce(page.cast("string"), F.lit("none")), digest, turn.cast("string"))), F.lit(">"))

    revisit = F.col("record_type") == "revisit"
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", id_of(F.col("page_id"), F.col("digest"), F.col("turn"))),
        ("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.when(revisit, id_of(F.col("refers_to"), F.col("digest"), F.lit(0)))),
        ("X-Page-Id", F.col("page_id").cast("string")),
        ("X-Refers-To-Page", F.col("refers_to").cast("string")),
        ("X-Payload-Length", F.col("bytes").cast("string")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
    ]
    head = F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in fields], F.lit("\r\n"))
    return resolved.select(head.cast("binary").alias("head"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("block"))


def _member(raw: bytes) -> bytes:
    """``raw`` as one gzip member."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES, **columns) -> None:
    """Write deduplicated WARC files, a gzip member a record, of at most ``file_bytes`` below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

        for b in batches:
            for head, block in zip(b.column(0), b.column(1)):
                raw = _member(head.as_py() + block.as_py() + END)
                if held and size + len(raw) > file_bytes:
                    yield archive()
                    held, size = [], 0
                held.append(raw)
                size += len(raw)
        if held:
            yield archive()

    files = record(resolve(pages, least_bytes, **columns)).mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


_FIELD = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\r\n]*)\r\n")


def members(raw: bytes) -> Iterator[bytes]:
    """Contents of the gzip members of one archive, one at a time."""
    view, at = memoryview(raw), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("an archive ends inside a record")
            step = view[at : at + STEP]
            parts.append(z.decompress(step))
            at += len(step) - len(z.unused_data)
        if content := b"".join(parts):
            yield content


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    stop = raw.index(b"\r\n\r\n") + 4
    if not raw.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not a record")
    heads = {k.decode(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(raw[10:stop])}
    size = int(heads["Content-Length"])
    if raw[stop + size :] != END:
        raise ValueError("a record's length is wrong")
    return heads, raw[stop : stop + size]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) of every record.

    Digest and size of a response are computed from the payload read, those of a revisit come from its headers.
    """

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows, held = [], 0
                for h, block in map(parse, members(raw.as_py())):
                    kind = h["WARC-Type"]
                    digest = base64.b32encode(hashlib.sha1(block).digest()).decode() if kind == "response" else h["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = len(block) if kind == "response" else int(h["X-Payload-Length"])
                    ids = [int(h[k]) if k in h else None for k in ("X-Page-Id", "X-Refers-To-Page")]
                    rows.append((ids[0], h["WARC-Target-URI"], kind, digest, size, ids[1], block if kind == "response" else None))
                    held += len(block)
                    if held > BATCH_BYTES or len(rows) > 10_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return raw.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def archive_table(pages: DataFrame, path: str | None = None, least_bytes: int = 0, **columns) -> DataFrame:
    """Write the archives and return their records as read back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes, **columns)
    return read_archives(pages.sparkSession, path)
