"""SimHash near-duplicates through a Gray-order hierarchical Hamming index.

``fingerprints`` hashes word shingles of whole texts; ``link`` finds every pair
of distinct fingerprints within ``bits`` differing bits and returns a spanning
forest of the links; ``simhash_components`` labels all documents.

Distribution: a fingerprint is dealt to ``bits + 1`` block tables, since two
fingerprints with at most ``bits`` differences agree on one whole block.  In
each bucket the fingerprints are sorted by Gray rank, and a hierarchy is built
over the sorted run: leaves of ``FANOUT`` neighbours and upper nodes keep the
bits all members share as (mask, value); a probe adds up differences on the
newly shared bits while it descends and drops a whole group once they exceed
``bits``.  A bucket emits (fingerprint, root) edges, never its pairs, so output
is linear even for one dense group.  A bucket with more than a shuffle
partition's fair share of rows is dealt into chunk pairs.

Null and empty texts have fingerprint zero and link like any other; repeated
rows share a fingerprint; an empty table gives an empty result; extra columns
are ignored by ``fingerprints`` and kept by callers that join on the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.llm.common import connected_components, discard, materialize, small

FANOUT = 16
FRONTIER = 2_000_000
LEAST_CHUNK = 1024
#: Most rows of a bucket's chunk, however large the input; more rows make more chunks.
MOST_CHUNK = 1 << 19
SHINGLES_AT_ONCE = 262_144


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - width + 1)
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    starts = starts[:n].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + SHINGLES_AT_ONCE], stops[at : at + SHINGLES_AT_ONCE])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4) -> DataFrame:
    """(id, fp long) per row; fp holds the 64 bits of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()) if not pa.types.is_binary(b.column(1).type) else b.column(1)
            fps = np.array([fingerprint(t.as_py() or b"", width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).cast("binary").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchy over one run of distinct fingerprints, sorted by Gray rank."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask, value = np.full(len(fps), full), self.fps
        self.levels = [(mask, value)]
        while len(value) > 1:
            at = np.arange(0, len(value), FANOUT)
            shared = np.bitwise_and.reduceat(mask, at)
            same = np.bitwise_and.reduceat(value, at) | ~np.bitwise_or.reduceat(value, at)
            mask, value = shared & same, value[at]
            self.levels.append((mask, value))

    def probe(self, queries: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query position, member position) within ``bits`` differences."""
        top = len(self.levels) - 1
        mask, value = self.levels[top]
        start = np.bitwise_count((queries ^ value[0]) & mask[0]).astype(np.int16)
        q = np.flatnonzero(start <= bits)
        work = [(top, q, np.zeros(len(q), np.int64), start[q])]
        while work:
            level, q, node, seen = work.pop()
            if not len(q):
                continue
            if level == 0:
                yield q, node
                continue
            if len(q) * FANOUT > FRONTIER and len(q) > 1:
                half = len(q) // 2
                work += [(level, q[:half], node[:half], seen[:half]), (level, q[half:], node[half:], seen[half:])]
                continue
            above = self.levels[level][0]
            mask, value = self.levels[level - 1]
            child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            real = child < len(value)
            child, parent = child[real], np.repeat(np.arange(len(q)), FANOUT)[real]
            fresh = mask[child] & ~above[node[parent]]
            total = seen[parent] + np.bitwise_count((queries[q[parent]] ^ value[child]) & fresh)
            near = total <= bits
            work.append((level - 1, q[parent[near]], child[near], total[near]))


def _roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least position reachable from each of ``n`` positions."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def bucket_edges(own: np.ndarray, other: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links inside ``own``, or between ``own`` and ``other``."""
    index = GrayIndex(own)
    if other is None:
        everything, links = index.fps, index.probe(index.fps, bits)
    else:
        everything = np.concatenate([index.fps, other])
        links = ((q + len(own), m) for q, m in index.probe(other, bits))
    root = _roots(len(everything), links)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return everything[moved], everything[root[moved]]


def _dealt(fps: DataFrame, bits: int) -> DataFrame:
    """Rows of all block tables, sorted by bucket in their partitions: block, key, i, j, first, fp."""
    blocks = bits + 1
    edges_at = [round(64 * b / blocks) for b in range(blocks + 1)]
    keys = F.array(*[F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(edges_at, edges_at[1:])])
    return _by_bucket(fps.select("fp", F.posexplode(keys).alias("block", "key")), fps.count() * blocks, ("fp",))


def _by_bucket(dealt: DataFrame, total: int, keep: tuple[str, ...]) -> DataFrame:
    """Rows (block, key, ``keep``) of buckets of two or more, large ones in chunk pairs, sorted by bucket in their partitions."""
    sizes = dealt.groupBy("block", "key").count().where("count > 1")
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = min(MOST_CHUNK, max(LEAST_CHUNK, total // max(1, parts)))
    rows = (
        dealt.join(sizes, ["block", "key"])
        .withColumn("n", F.ceil(F.col("count") / chunk).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(*keep, F.lit(7)), F.col("n")).cast("int"))
        .withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("block", "key", F.least("own", "peer").alias("i"), F.greatest("own", "peer").alias("j"), (F.col("own") <= F.col("peer")).alias("first"), *keep)
    )
    return rows.repartition("block", "key", "i", "j").sortWithinPartitions("block", "key", "i", "j")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Whole buckets of a sorted partition: each a list of columns first, fp, ...; ``first`` is None where all rows meet all."""
    held: list[list[np.ndarray]] = []

    def split(cols: list[np.ndarray], upto: int) -> Iterator[list[np.ndarray]]:
        keys = [c[:upto] for c in cols[:4]]
        cut = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        bounds = np.concatenate([[0], cut, [upto]]).tolist()
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                one = keys[2][a] == keys[3][a]
                if one or (cols[4][a:b].any() and not cols[4][a:b].all()):
                    yield [None if one else cols[4][a:b], *(c[a:b] for c in cols[5:])]

    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(k)) for k in range(4)] + [b.column(4).to_numpy(zero_copy_only=False)] + [np.asarray(c) for c in b.columns[5:]]
        if held and all(held[-1][k][-1] == cols[k][0] == cols[k][-1] for k in range(4)):
            held.append(cols)
            continue
        held.append(cols)
        cols = [np.concatenate(x) for x in zip(*held)]
        same = np.all([c == c[-1] for c in cols[:4]], axis=0)
        upto = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if upto:
            yield from split(cols, upto)
        held = [[c[upto:] for c in cols]]
    if held:
        cols = [np.concatenate(x) for x in zip(*held)]
        yield from split(cols, len(cols[0]))


def _edges(parts: Iterator[tuple[np.ndarray, np.ndarray]], names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Edges as batches of some size."""
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64, copy=False)) for x in zip(*held)], names=list(names))

    for src, dst in parts:
        if len(src):
            held.append((src, dst))
            n += len(src)
        if n > 50_000:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def link(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(src, dst) edges spanning all links between the distinct values of ``fps.fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for first, fp in _buckets(batches):
                fp = fp.view(np.uint64)
                if len(fp) == 2:
                    if np.bitwise_count(fp[0] ^ fp[1]) <= bits:
                        yield fp[:1].view(np.int64), fp[1:].view(np.int64)
                    continue
                s, d = bucket_edges(fp, None, bits) if first is None else bucket_edges(fp[first], fp[~first], bits)
                yield s.view(np.int64), d.view(np.int64)

        yield from _edges(edges(), ("src", "dst"))

    return _dealt(fps, bits).mapInArrow(run, "src long, dst long")


def simhash_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4, bits: int = 4) -> DataFrame:
    """(id, fp, component_id): least id whose fingerprint is reachable over links of at most ``bits`` bits."""
    rows = materialize(fingerprints(docs, text, id_col, width), "simhash")
    least = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    ids = connected_components(link(least.select("fp"), bits))
    grouped = least.join(ids.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = grouped.select("fp", "component").join(lowest, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(id_col, "fp", "component_id")


# --- near-duplicates by similarity -----------------------------------------------------------------------------------

#: Documents in the sample that says which shingles are frequent, and most of these that are listed.
SAMPLE_DOCS = 10_000
FREQUENT = 200_000
PAIRS_AT_ONCE = 1_000_000
#: Rows from which a posting is large: its pairs are judged by parity maps before they are counted; neighbours that are looked at for first pairs.
LARGE, LOOK = 12, 16
MAP_BITS = 512
MAP = tuple(f"m{k}" for k in range(MAP_BITS // 64))
#: Edges that one task contracts, on average.
SLICE = 1 << 17


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included; a text of fewer words is one shingle."""
    words = text.lower().split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()[: max(1, len(words) - width + 1)]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist() if words else [0]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), "<u8", len(starts))


def overlap(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Least number of shingles that sets of ``n`` and ``m`` with a Jaccard similarity of ``least`` share."""
    return np.ceil(least / (1 + least) * (n + m) - 1e-9).astype(np.int64)


def prefix(h: np.ndarray, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest shingles of a set, of which two sets with a similarity of ``least`` share one at least."""
    names, counts = frequent
    at = np.minimum(np.searchsorted(names, h), max(0, len(names) - 1))
    seen = np.where(names[at] == h, counts[at], 0) if len(names) else np.zeros(len(h), np.int64)
    return h[np.lexsort((h, seen))[: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]]


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted sets of distinct shingle hashes."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def parity_map(h: np.ndarray) -> np.ndarray:
    """MAP_BITS parities of a set of hashes, as words.  Two maps differ in at most as many bits as the sets in members."""
    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) % MAP_BITS, minlength=MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide_map(h: np.ndarray) -> bytes:
    """Parities of a set of hashes in as many bits as a power of two, at least two a member."""
    n = max(64, 1 << (2 * len(h) - 1).bit_length())
    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def wide_differences(a: bytes, b: bytes) -> int:
    """Bits that differ between two wide maps, the longer folded to the other's length; at most the members that only one set has."""
    x, y = sorted((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum(dtype=np.int64))


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (src, dst long) of the same components: in slices of about ``SLICE`` edges every node hangs on the least it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if parts:
            src, dst = (np.concatenate(x) for x in zip(*parts))
            nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
            root = _roots(len(nodes), iter([(at[: len(src)], at[len(src) :])]))
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield from _edges(iter([(nodes[moved], nodes[root[moved]])]), ("src", "dst"))

    return edges.repartition(-(-max(1, edges.count()) // SLICE)).mapInArrow(run, "src long, dst long")


def _frequent(source: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of shingles of several sampled texts, by hash.  They only set the order of shingles, so any sample is right."""
    part = max(1, source.count() // SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                h = [np.unique(shingles(t.as_py() or b"", width)) for t in b.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], names=["h"])

    texts = source.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0).select("_text")
    found = texts.mapInArrow(run, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    names, counts = found["h"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64)
    order = np.argsort(names)
    return names[order], counts[order]


def _possible(size_a, at_a, size_b, at_b, least: float) -> np.ndarray:
    """True where two sets that share the shingles at these positions may be similar enough."""
    return np.minimum(size_a - at_a, size_b - at_b) >= overlap(size_a, size_b, least)


def _differences(maps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((maps[:, a] ^ maps[:, b]).view(np.uint64)).sum(0, dtype=np.int64)  # of signed words it counts the absolute value


def _allowed(size_a, size_b, least: float) -> np.ndarray:
    """Most members that only one of two sets may have that are similar enough."""
    return size_a + size_b - 2 * overlap(size_a, size_b, least)


def _first_pairs(node: np.ndarray, size: np.ndarray, at: np.ndarray, maps: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row of a bucket with the one of the next ``LOOK`` in order of size that it differs least from."""
    order = np.lexsort((node, size))
    best, partner = np.full(len(node), np.iinfo(np.int64).max), np.full(len(node), -1)
    for step in range(1, min(LOOK if maps.any() else 1, len(node) - 1) + 1):
        a, b = order[:-step], order[step:]
        apart = _differences(maps, a, b)
        good = _possible(size[a], at[a], size[b], at[b], least) & (apart <= _allowed(size[a], size[b], least)) & (apart < best[a])
        best[a[good]], partner[a[good]] = apart[good], b[good]
    some = np.flatnonzero(partner >= 0)
    return node[some], node[partner[some]]


def _open_pairs(first, node, size, at, group, maps: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a bucket that may be similar enough and aren't in one group yet."""
    left, right = (np.arange(len(node)),) * 2 if first is None else (np.flatnonzero(first), np.flatnonzero(~first))
    right = right[np.argsort(size[right], kind="stable")]
    low = np.searchsorted(size[right], np.ceil(least * size[left] - 1e-9), "left")
    high = np.searchsorted(size[right], np.floor(size[left] / least + 1e-9), "right")
    many = np.cumsum(np.maximum(high - low, 0))
    for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(many // PAIRS_AT_ONCE)) + 1):
        n = np.maximum(high[part] - low[part], 0)
        a = np.repeat(left[part], n)
        b = right[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)]
        good = (group[a] != group[b]) & _possible(size[a], at[a], size[b], at[b], least)
        if first is None:
            good &= node[a] < node[b]
        a, b = a[good], b[good]
        good = _differences(maps, a, b) <= _allowed(size[a], size[b], least)
        yield node[a[good]], node[b[good]]


def near_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, least: float = 0.8, bits: int = 4) -> DataFrame:
    """(id, component_id) of the rows that aren't the least of their group of near-duplicates.

    Links are all pairs of texts with at least ``least`` of their distinct ``width``-word
    shingles in common, counted exactly.  The Gray-order index on SimHashes of the shingles
    and neighbours in the postings of rare shingles propose first pairs, which join most
    groups.  Two sets that similar share one of their rarest shingles (``prefix``), so all
    pairs in one posting whose texts aren't in one group yet are counted next, and no link is left.
    Before that, sizes, places in the postings and, in large postings, parity maps of the sets
    rule out pairs that can't be similar enough, so that many variants of one form make few pairs.
    Wide maps, a twentieth of a set or so, rule out most others, so whole sets are only shuffled for few pairs.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("_text"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(source, width))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, fp, size, rare, wide, maps = [], [], [], [], [], []
            for t in b.column(1):
                t = t.as_py() or b""
                every = shingles(t, width)
                h = np.unique(every)
                bits_set = np.zeros(64, np.int64)
                for at in range(0, len(every), SHINGLES_AT_ONCE):
                    bits_set += np.unpackbits(every[at : at + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                fp.append(np.packbits(bits_set * 2 > len(every), bitorder="little").view("<u8")[0])
                same.append(xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 7))
                size.append(len(h))
                rare.append(prefix(h, least, frequent.value).tobytes())
                wide.append(wide_map(h))
                maps.append(parity_map(h))
            cols = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (same, fp, size)]
            words = [pa.array(c) for c in np.array(maps, np.int64).reshape(len(maps), len(MAP)).T]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(rare, pa.binary()), pa.array(wide, pa.binary()), *words], names=["id", "same", "fp", "size", "rare", "wide", *MAP])

    every = materialize(source.mapInArrow(described, f"id long, same long, fp long, size long, rare binary, wide binary, {', '.join(f'{m} long' for m in MAP)}"), "near-every")
    # A node is a text, named by the hash of its words; one of its ids leads to the text.
    nodes = materialize(every.groupBy("same").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("fp", "size", "rare", "wide", *MAP)]), "near-nodes")
    rows = materialize(every.select("id", "same"), "near-rows")
    discard(every)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                c = b.slice(at, 1000)
                keys = [np.frombuffer(r.as_py(), "<i8") for r in c.column(2)]
                n = np.array([len(k) for k in keys])
                place = np.concatenate([np.arange(k) for k in n])
                cols = [np.concatenate(keys), np.repeat(np.asarray(c.column(0)), n), np.repeat(np.asarray(c.column(1)), n), place]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "node", "size", "at"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waited = None, False
        for b in batches:  # rows of a key follow each other; the last row of a batch waits for the next
            if not b.num_rows:
                continue
            b = b if last is None else pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            key = np.asarray(b.column(0))
            again = np.flatnonzero(key[1:] == key[:-1])
            keep = np.zeros(len(key), bool)
            keep[again], keep[again + 1] = True, True
            keep[0] |= waited
            waited, last = bool(keep[-1]), b.slice(len(key) - 1)
            yield b.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
        if last is not None and waited:
            yield last

    posts = nodes.select("same", "size", "rare").mapInArrow(posted, "key long, node long, size long, at long")
    posts = posts.repartition("key").sortWithinPartitions("key")
    bare = posts = materialize(posts.mapInArrow(shared, "key long, node long, size long, at long"), "near-shared")
    # Rows of large postings carry their text's parity map, others zeros, which rule out nothing.
    large = small(materialize(posts.groupBy("key").count().where(F.col("count") >= LARGE).select("key"), "near-large"))
    mapped = posts.join(large, "key", "left_semi").join(nodes.select(F.col("same").alias("node"), *MAP), "node").select("key", "node", "size", "at", *MAP)
    plain = posts.join(large, "key", "left_anti").select("key", "node", "size", "at", *[F.lit(0).cast("long").alias(m) for m in MAP])
    posts = materialize(mapped.unionByName(plain), "near-posts")
    discard(bare)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(1)]
            same = np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 7) for t in texts], np.uint64).view(np.int64)
            for at in range(0, len(texts), 500):
                part = [np.unique(shingles(t, width)).tobytes() for t in texts[at : at + 500]]
                yield pa.RecordBatch.from_arrays([pa.array(same[at : at + 500]), pa.array(part, pa.binary())], names=["node", "held"])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            allowed = _allowed(np.asarray(b.column(2)), np.asarray(b.column(4)), least)
            good = [wide_differences(x.as_py(), y.as_py()) <= k for x, y, k in zip(b.column(3), b.column(5), allowed.tolist())]
            yield b.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = pa.array([similarity(x.as_py(), y.as_py()) >= least for x, y in zip(b.column(2), b.column(3))], pa.bool_())
            yield b.select(["src", "dst"]).filter(good)

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        """The pairs (src, dst) of texts that are similar enough, by their whole shingle sets."""
        pairs = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
        wide = nodes.select("same", "size", "wide")
        both = pairs.join(wide.toDF("src", "n", "x"), "src").join(wide.toDF("dst", "m", "y"), "dst").select("src", "dst", "n", "x", "m", "y")
        pairs = materialize(both.mapInArrow(screen, "src long, dst long"), f"near-pairs-{tag}")
        wanted = pairs.select(F.col("src").alias("same")).union(pairs.select("dst")).distinct().join(nodes.select("same", "id"), "same").select("id").distinct()
        held = source.join(small(materialize(wanted, f"near-ids-{tag}")), "id", "left_semi").mapInArrow(sets, "node long, held binary")
        held = materialize(held.dropDuplicates(["node"]), f"near-sets-{tag}")
        both = pairs.join(held.toDF("src", "x"), "src").join(held.toDF("dst", "y"), "dst").select("src", "dst", "x", "y")
        links = materialize(both.mapInArrow(confirm, "src long, dst long"), f"near-links-{tag}")
        discard(held), discard(pairs)
        return links

    def grouped(keep: tuple[str, ...], df: DataFrame) -> DataFrame:
        return _by_bucket(df.withColumn("block", F.lit(0)), df.count(), keep)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _edges((_first_pairs(node, size, at, np.stack(maps), least) for first, node, size, at, *maps in _buckets(batches) if first is None), ("src", "dst"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _edges((pair for first, node, size, at, group, *maps in _buckets(batches) for pair in _open_pairs(first, node, size, at, group, np.stack(maps), least)), ("src", "dst"))

    # Nodes of one fingerprint hang on their least node, fingerprints on each other by the index.
    by_fp = nodes.groupBy("fp").agg(F.min("same").alias("head"))
    heads = materialize(by_fp, "near-heads")
    alike = nodes.join(heads, "fp").select(F.col("same").alias("src"), F.col("head").alias("dst"))
    near = link(heads.select("fp"), bits).join(heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src").join(heads.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst")
    first = grouped(("node", "size", "at", *MAP), posts).mapInArrow(neighbours, "src long, dst long")
    real = confirmed(alike.union(near.select("a", "b")).union(first), "first")
    groups = materialize(connected_components(contracted(real)), "near-groups")
    rest = posts.join(groups, "node", "left").select("key", "node", "size", "at", F.coalesce("component", "node").alias("group"), *MAP)
    # Postings whose texts are all in one group have no open pair.
    mixed = rest.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("key")
    rest = materialize(rest.join(mixed, "key", "left_semi"), "near-open")
    more = grouped(("node", "size", "at", "group", *MAP), rest).mapInArrow(opened, "src long, dst long")
    linked = materialize(groups.select("node", "component").union(confirmed(more, "rest")).toDF("src", "dst"), "near-linked")
    groups = connected_components(contracted(linked))
    discard(rest), discard(posts)
    of = nodes.select("same", "id").join(groups.withColumnRenamed("node", "same"), "same", "left").withColumn("component", F.coalesce("component", "same"))
    of = of.select("same", "component").join(of.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("same", "component_id")
    found = rows.select("id", "same").join(of, "same")
    return found.where("id <> component_id").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates: that with the least id; of repeated rows one.  Rows without an id stay."""
    with_id = docs.where(F.col(id_col).isNotNull())
    gone = materialize(near_components(with_id, text, id_col, width, least).select(id_col).distinct(), "near-gone")
    kept = with_id.join(small(gone), id_col, "left_anti")
    # Texts are shuffled only for ids that occur again.
    again = with_id.groupBy(id_col, F.xxhash64(text).alias("_same")).count().where("count > 1").select(id_col).distinct()
    again = materialize(again, "near-again")
    if again.count():
        once = kept.join(small(again), id_col, "left_anti")
        kept = once.unionByName(kept.join(small(again), id_col, "left_semi").withColumn("_same", F.xxhash64(text)).dropDuplicates([id_col, "_same"]).drop("_same"))
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
