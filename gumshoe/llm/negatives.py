"""Hard negatives of anchors, screened by rotated one-bit codes.

A vector is turned by a random rotation and coded by the signs of its components.
The code, scaled to unit length, is a vector o; the stored alignment is a = <z, o>.
What a o leaves of z is coded again under the next rotation, ``LEVELS`` times, and
the length of the last residual r is stored.  For an anchor q

    <q, z> = sum of a_l <q, o_l> + <q, r>,

where <q, o_l> comes from popcounts of the code and the bit planes of q's rotated
components in ``PLANES`` bits, off by at most the length e_l of what these bits
leave, and, as r is orthogonal to the last code,

    |<q, r>| <= |r| sqrt(|q|^2 - <q, o_L>^2)            (Cauchy-Schwarz).

The interval is certain, not likely.  Positives: of the rows of an anchor's label,
those whose upper end falls below the k-th highest lower end go.  Negatives: rows
whose interval misses every window [80 %, 100 %] of the anchor's positives go.  The
rest are scored in integers.  Anchors and rows meet in groups of bounded size
(``vectors.dealt``), those of positives by label; a task returns at most k rows an
anchor, or an anchor and positive.

Rows with a null label or id, and vectors that are null or hold null or non-finite
components, take no part.  Only vectors of equal length are compared.  A row with
the anchor's id is neither its positive nor its negative; repeated rows count each,
several vectors of one anchor id are searched apart, equal ones once.  Positives
below 0 have no negatives, as no score meets both bounds.  Scores beyond a long are
held at its limits.  Ids must be whole numbers.  An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.llm.common import materialize
from gumshoe.llm.vectors import HELD, dealt, exact, first_per, integer_rows, parts, products

LEVELS = 4
PLANES = 8
SEED = 20
#: Anchors whose intervals against a chunk are held at once.
STEP = 128
CODED = ["n", "block", "chunk", "own", "slot", "id", "z", "label", "code", "align", "rest"]


@lru_cache(maxsize=8)
def rotations(n: int, levels: int) -> list[np.ndarray]:
    """The same random orthogonal matrices in every task."""
    r = np.random.default_rng(SEED + n)
    return [np.linalg.qr(r.standard_normal((n, n)))[0] for _ in range(levels)]


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    wide = np.zeros((len(bits), max(8, -(-packed.shape[1] // 8) * 8)), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def encode(z: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code words by level, alignments by level, length of the last residual) of rows."""
    rest, codes, aligns = z.astype(np.float64), [], []
    side = 1 / np.sqrt(max(1, z.shape[1]))
    for turn in rotations(z.shape[1], levels):
        y = rest @ turn.T
        codes.append(_words(y > 0))
        a = np.abs(y).sum(axis=1) * side
        aligns.append(a)
        rest = (y - np.where(y > 0, side, -side) * a[:, None]) @ turn
    return np.stack(codes, axis=1), np.stack(aligns, axis=1), np.linalg.norm(rest, axis=1)


def intervals(q: np.ndarray, codes: np.ndarray, aligns: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Certain (low, high) ends of the inner products of each row of ``q`` with each coded row."""
    levels, side = codes.shape[1], 1 / np.sqrt(max(1, q.shape[1]))
    length = np.linalg.norm(q, axis=1)
    middle, off = np.zeros((len(q), len(codes))), np.zeros((len(q), len(codes)))
    for level, turn in enumerate(rotations(q.shape[1], levels)):
        y = q @ turn.T
        low = y.min(axis=1, initial=0.0)[:, None]
        unit = np.maximum(y.max(axis=1, initial=0.0)[:, None] - low, 1e-300) / ((1 << PLANES) - 1)
        units = np.rint((y - low) / unit).astype(np.int64)
        near = low + unit * units
        error = np.linalg.norm(y - near, axis=1)
        words = codes[:, level, :]
        sums = np.zeros((len(q), len(codes)))
        for plane in range(PLANES):
            bits = _words((units >> plane & 1).astype(bool))
            pop = np.zeros((len(q), len(codes)), np.uint16)
            for w in range(words.shape[1]):
                pop += np.bitwise_count(bits[:, w, None] & words[None, :, w])
            sums += float(1 << plane) * pop
        count = np.bitwise_count(words).sum(axis=1)
        along = side * (2 * (low * count[None, :] + unit * sums) - near.sum(axis=1)[:, None])
        middle += aligns[:, level] * along
        off += aligns[:, level] * error[:, None]
        last = np.maximum(0.0, np.abs(along) - error[:, None])
    off += rest * np.sqrt(np.maximum(0.0, (length * length)[:, None] - last * last))
    whole = np.sqrt((aligns * aligns).sum(axis=1) + rest * rest)
    off += 1e-9 * (length[:, None] * whole + 1)  # rounding
    return np.clip(middle - off, -HELD, HELD), np.clip(middle + off, -HELD, HELD)


def _coded(batches):
    """Codes, alignments and residual length of each row, stored beside it."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        for n in set(t["n"].to_pylist()):
            part = t.filter(pa.array([x == n for x in t["n"].to_pylist()])).combine_chunks()
            z = part["z"].chunk(0).flatten().to_numpy().reshape(-1, n) if n else np.zeros((len(part), 0))
            codes, aligns, rest = encode(z)
            part = part.append_column("code", pa.array([c.tobytes() for c in codes], pa.binary()))
            part = part.append_column("align", pa.array(list(aligns), pa.list_(pa.float64())))
            yield from part.append_column("rest", pa.array(rest)).to_batches()


def _codes(told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(told["code"].to_pylist()), np.uint64).reshape(len(told), LEVELS, -1)
    return codes, np.array(told["align"].to_pylist()).reshape(len(told), LEVELS), told["rest"].to_numpy()


def _positives(k: int):
    """First k rows of each anchor in one group of its label."""

    def run(table: pa.Table) -> pa.Table:
        asked, q, told, c = parts(table)
        ids, whole, coded = told["id"].to_numpy(), exact(q, c), _codes(told)
        out = [(np.zeros(0, np.int64),) * 4]
        for at in range(0, len(q) if len(c) else 0, STEP):
            low, high = intervals(q[at : at + STEP], *coded)
            other = asked["id"].to_numpy()[at : at + STEP, None] != ids[None, :]
            low[~other] = -np.inf
            least = -np.partition(-low, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
            i, j = np.nonzero(other & (high >= least[:, None]))
            score = products(q[at : at + STEP], c, i, j, whole)
            first = first_per(i, score, ids[j], k)
            i, j, score = i[first] + at, j[first], score[first]
            out.append((asked["slot"].to_numpy()[i], asked["id"].to_numpy()[i], ids[j], score))
        return pa.table({name: pa.array(np.concatenate(x)) for name, x in zip(("slot", "anchor_id", "positive_id", "positive_score"), zip(*out))})

    return run


def windows_hit(low: np.ndarray, high: np.ndarray, scores: list[int]) -> np.ndarray:
    """Rows whose interval meets the window of one of the positive scores."""
    hit = np.zeros(len(low), bool)
    for s in scores:
        if s >= 0:
            hit |= (low <= s) & (100.0 * high >= 80.0 * s * (1 - 1e-12))
    return hit


def _negatives(k: int):
    """First k rows in the window of each positive of each anchor in one group."""
    names = ("slot", "anchor_id", "nth", "positive_id", "negative_id", "positive_score", "negative_score")

    def run(table: pa.Table) -> pa.Table:
        asked, q, told, c = parts(table)
        ids, labels, whole, coded = told["id"].to_numpy(), told["label"].to_numpy(), exact(q, c), _codes(told)
        slots, anchors, mine, positives = asked["slot"].to_pylist(), asked["id"].to_pylist(), asked["label"].to_pylist(), asked["positives"].to_pylist()
        out = []
        for at in range(0, len(q) if len(c) else 0, STEP):
            low, high = intervals(q[at : at + STEP], *coded)
            for a in range(len(low)):
                g = at + a
                j = np.flatnonzero(windows_hit(low[a], high[a], [p["positive_score"] for p in positives[g]]) & (labels != mine[g]) & (ids != anchors[g]))
                score = products(q, c, np.full(len(j), g), j, whole)
                for p in positives[g]:
                    s = p["positive_score"]
                    in_window = (score <= s) & (score >= -(-80 * s // 100))  # 80 s <= 100 score, in integers
                    at_j, at_score = j[in_window], score[in_window]
                    for f in first_per(np.zeros(len(at_j), np.int64), at_score, ids[at_j], k):
                        out.append((slots[g], anchors[g], p["nth"], p["positive_id"], int(ids[at_j[f]]), s, int(at_score[f])))
        return pa.table({name: pa.array([r[m] for r in out], pa.int64()) for m, name in enumerate(names)})

    return run


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, most: int = 5, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best rows of
    the same label, the first rows of another label that score from 80 to 100 % of it."""
    of = lambda df: integer_rows(df.where(F.col(label).isNotNull()), id_col, vector, label=F.col(label))
    coded = of(vectors)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema)
    rows = materialize(coded.mapInArrow(_coded, f"{schema}, code binary, align array<double>, rest double"), "code-rows")
    asked = of(anchors).select("id", "z", "n", "label").distinct().withColumn("slot", F.xxhash64("id", "z", "label"))
    asked = materialize(asked, "code-anchors")
    met = dealt(asked, rows, ["n", "label"]).select(*CODED)
    near = met.groupBy("n", "label", "block", "chunk").applyInArrow(_positives(positives), "slot long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("slot").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= positives)
    held = near.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("positives"))
    held = materialize(asked.join(held, "slot"), "code-positives")
    met = dealt(held, rows, ["n"]).select(*CODED, "positives")
    far = met.groupBy("n", "block", "chunk").applyInArrow(_negatives(most), "slot long, anchor_id long, nth long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("slot", "nth").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
