"""Exact metric range join of embeddings, partitioned by pivots.

Vectors are scaled to unit length, where cosine >= c means a chord of at most
r = sqrt(2 - 2c).  Each vector belongs to the cell of its nearest pivot.  A link
between cells i and j is found in one of them, j say (the larger if i + j is
even, else the smaller), to which a vector x of cell i is sent only if a vector within r of x can lie there.  From the triangle inequality,
with d the distances of x to the pivots and R_j the radius of cell j, that needs

    d_j - d_i <= 2 r,   d_j <= R_j + r,   and   (d_j^2 - d_i^2) / (2 |p_i p_j|) <= r,

the last being the distance to the plane half-way between the pivots.  There are at
least ``LEAST_PIVOTS`` pivots wherever so many vectors differ; how many more is chosen
on a sample: the number with the least estimated work, pairs and copies together, so
clustered data get many and data that the triangle inequality hardly prunes get few.
Cells are joined independently; a large cell is dealt into chunk pairs, so one dense
cell needs no single task.  ``cell_report`` tells what each cell compares.  Equal vectors are joined once and counted by their
number.  Tasks return link counts and spanning edges, never the pairs.

Vectors that are null, empty, zero or hold a null or non-finite component link
with nothing; vectors of another length than most are joined in a cell of their
length; equal ids are separate rows of one node; rows without an id link with
nothing and have no component; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.llm.common import connected_components, materialize, small
from gumshoe.llm.simhash import _roots

#: Most and fewest pivots.
PIVOTS = 256
LEAST_PIVOTS = 8
SAMPLE_ROWS = 2048
#: Seconds that comparing two vectors and sending one to a task take, roughly; they only steer the number of pivots.
PAIR_S, COPY_S = 1e-8, 2e-5
CHUNK = 4096
OUTER_CHUNK = 8192


def valid(v):
    """True for a vector that can link."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(column: pd.Series) -> np.ndarray:
    """Unit vectors from the raw little-endian bytes of single or double components ("f" or "d" leads)."""
    rows = column.tolist()
    kind = "<f4" if rows[0][:1] == b"f" else "<f8"
    x = np.stack([np.frombuffer(r, kind, offset=1) for r in rows]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _raw(batches):
    """Arrays to bytes, once: every later step reads them without building lists."""
    for b in batches:
        b["x"] = [(b"f" if v.dtype == np.float32 else b"d") + v.tobytes() for v in b["v"]]
        b["length"] = b["v"].map(len)
        yield b[["x", "first", "copies", "length"]]


def choose_pivots(vectors: DataFrame, total: int, r: float, most: int) -> np.ndarray:
    """Spread-out pivots, farthest-first over a bounded sample in hash order, as many as make the least work for ``total`` vectors."""
    rows = vectors.orderBy(F.xxhash64("x"), "first").limit(SAMPLE_ROWS).select("x").toPandas()
    x = _unit(rows["x"])
    chosen, far = [0], 1 - x @ x[0]
    while len(chosen) < min(most, len(x)):
        k = int(far.argmax())
        if far[k] <= 1e-9:
            break
        chosen.append(k)
        far = np.minimum(far, 1 - x @ x[k])
    pivots = x[chosen]

    def work(k: int) -> float:
        d = _distances(x, pivots[:k])
        cell = d.argmin(1)
        own = np.bincount(cell, minlength=k) / len(x)
        radius = np.array([d[cell == c, c].max(initial=-1.0) for c in range(k)])
        sent = (_reach(d, cell, pivots[:k], radius, r).sum(0) - np.bincount(cell, minlength=k)) / len(x)
        pairs = (own * (own / 2 + sent)).sum() * total * total
        copies = (1 + sent.sum()) * total + (own * own + own * sent).sum() * total * total / CHUNK
        return pairs * PAIR_S + copies * COPY_S

    counts = [k for k in (8, 16, 32, 64, 128, 256, 512, 1024) if LEAST_PIVOTS <= k < len(pivots)] + [len(pivots)]
    return pivots[: min(counts, key=work)]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def _reach(d: np.ndarray, cell: np.ndarray, pivots: np.ndarray, radius: np.ndarray, r: float) -> np.ndarray:
    """Whether each vector is sent to each cell, by its distances ``d`` to the pivots and its own cell."""
    apart = np.maximum(_distances(pivots, pivots), 1e-12)
    cells = np.arange(len(pivots))
    # The cell that joins a pair of cells: the larger number if their sum is even, else the smaller.
    meets = ((cells[:, None] + cells) % 2 == 0) == (cells[None, :] > cells[:, None])
    di = d[np.arange(len(d)), cell][:, None]
    out = (d - di <= 2 * r) & (d <= radius + r) & ((d * d - di * di) / (2 * apart[cell]) <= r) & meets[cell]
    out[np.arange(len(d)), cell] = True
    return out


def _links(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    return a @ b.T >= cosine


def _join_cell(cosine: float):
    """Links of one chunk pair: counts for each vector, and an edge to the least one reachable over them."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("first", ignore_index=True)
        x, ids, n = _unit(part["x"]), part["first"].to_numpy(), part["copies"].to_numpy()
        core = part["core"].to_numpy()
        own, peer = part["own"].to_numpy(), part["peer"].to_numpy()
        counts = np.zeros(len(x), np.int64)
        left = np.flatnonzero(own <= peer)
        right = np.flatnonzero(own >= peer) if own[0] == peer[0] else np.flatnonzero(own > peer)

        def links():
            for at in range(0, len(left), 1024):
                q = left[at : at + 1024]
                near = _links(x[q], x[right], cosine) & (core[q][:, None] | core[right][None, :])
                if own[0] == peer[0]:
                    near &= q[:, None] != right[None, :]
                else:
                    counts[right] += near.T @ n[q]
                counts[q] += near @ n[right]
                for k in range(0, len(q), 128):  # bounds the pairs of a dense block
                    i, j = np.nonzero(near[k : k + 128])
                    yield q[k + i], right[j]

        edge = ids[_roots(len(x), links())]  # rows are in order of id, so the least position holds the least id
        some = counts > 0
        return pd.DataFrame({"first": ids[some], "links": counts[some], "edge": edge[some]})

    return run


def _distinct(vectors: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rows, distinct vectors that can link with their least id and number)."""
    if (kind := vectors.schema[id_col].dataType.simpleString()) not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} holds {kind}, not whole numbers")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    rows = rows.withColumn("v", F.when(valid(F.col("v")), F.col("v")))
    good = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull())
    return rows, materialize(good.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "vectors")


def cell_report(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(cell, core, sent, pairs): distinct vectors of a cell, those sent to it by others, and pairs compared there.

    All vectors must be of one length; without cells there would be n (n - 1) / 2 pairs.
    """
    raw = materialize(_distinct(vectors, id_col, vector)[1].mapInPandas(_raw, "x binary, first long, copies long, length int"), "vector-bytes")
    sent, _ = _cells(raw.drop("length"), raw.count(), cosine, pivots, CHUNK)
    each = sent.groupBy("cell").agg(F.count_if("core").alias("core"), F.count_if(~F.col("core")).alias("sent"))
    return each.withColumn("pairs", (F.col("core") * (F.col("core") - 1) / 2 + F.col("core") * F.col("sent")).cast("long"))


def range_join(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``."""
    rows, distinct = _distinct(vectors, id_col, vector)
    sizes = distinct.groupBy(F.size("v").alias("n")).count()
    main = sizes.orderBy(F.desc("count"), "n").first()
    if main is None:
        found = vectors.sparkSession.createDataFrame([], "first long, links long, edge long")
    else:
        raw = materialize(distinct.mapInPandas(_raw, "x binary, first long, copies long, length int"), "vector-bytes")
        found = _main_cells(raw.where(F.col("length") == main[0]).drop("length"), main[1], cosine, pivots, chunk)
        rest = raw.where(F.col("length") != main[0]).withColumnRenamed("length", "cell").withColumn("core", F.lit(True))
        counts = sizes.where(F.col("n") != main[0]).select(F.col("n").alias("cell"), _chunks(F.col("count"), chunk).alias("n"), F.lit(1).alias("m"))
        found = found.union(_join_cells(rest.select("x", "first", "copies", "cell", "core"), small(materialize(counts, "vector-cells")), cosine))
    found = materialize(found, "links")
    groups = connected_components(found.select(F.col("first").alias("src"), F.col("edge").alias("dst")))
    per = found.groupBy("first").agg(F.sum("links").alias("links"))
    # An id with several different vectors is one node: its links are those of all of them.
    of = distinct.join(per, "first", "left").join(groups.withColumnRenamed("node", "first"), "first", "left")
    of = of.select("v", F.coalesce("links", F.lit(0)).alias("links"), "copies", F.coalesce("component", "first").alias("component_id"))
    named = F.col("id").isNotNull()
    out = rows.join(of, "v", "left").select(
        F.col("id").alias(id_col),
        F.when(named, F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(named, F.coalesce("component_id", "id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _chunks(n, of: int):
    return F.greatest(F.lit(1), F.ceil(n / of)).cast("int")


def _main_cells(distinct: DataFrame, total: int, cosine: float, pivots: int, chunk: int) -> DataFrame:
    """Links of vectors of one length by pivot cells."""
    return _join_cells(*_cells(distinct, total, cosine, pivots, chunk), cosine)


def _cells(distinct: DataFrame, total: int, cosine: float, pivots: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Vectors in their own cell (core) and in those they are sent to, and the chunks of each cell."""
    r = math.sqrt(2 - 2 * cosine) + 1e-9
    p = choose_pivots(distinct, total, r, pivots)

    def nearest(batches):
        for b in batches:
            if len(b):
                d = _distances(_unit(b["x"]), p)
                b["cell"] = d.argmin(1).astype(np.int32)
                b["d"] = d.min(1)
                yield b

    placed = materialize(distinct.mapInPandas(nearest, "x binary, first long, copies long, cell int, d double"), "cells")
    per_cell = placed.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("count"))  # a row per pivot
    radius = np.full(len(p), -1.0)
    for c, widest, _ in per_cell.collect():
        radius[c] = widest

    def replicate(batches):
        for b in batches:
            if not len(b):
                continue
            i = b["cell"].to_numpy()
            at, cell = np.nonzero(_reach(_distances(_unit(b["x"]), p), i, p, radius, r))
            out = b[["x", "first", "copies"]].iloc[at].copy()
            out["cell"], out["core"] = cell.astype(np.int32), cell == i[at]
            yield out

    sent = placed.mapInPandas(replicate, "x binary, first long, copies long, cell int, core boolean")
    counts = per_cell.select("cell", _chunks(F.col("count"), chunk).alias("n"), _chunks((F.lit(total) - F.col("count")) / 2, OUTER_CHUNK).alias("m"))
    return sent, F.broadcast(materialize(counts, "vector-cells"))


def _join_cells(sent: DataFrame, counts: DataFrame, cosine: float) -> DataFrame:
    """Links inside cells, and between their core and outer vectors; ``counts`` says into how many chunks each cell's are dealt (n, m)."""
    dealt = sent.join(counts, "cell")
    hashed = F.xxhash64("first")
    keep = ["x", "first", "copies", "cell", "core"]
    # Core chunks of a cell meet each other (i, j) and every chunk of its outer vectors (i, -1 - o).
    core = dealt.where("core").withColumn("of", F.pmod(hashed, F.col("n")).cast("int"))
    inner = core.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    inner = inner.select(*keep, F.least("of", "to").alias("i"), F.greatest("of", "to").alias("j"), F.col("of").alias("own"), F.col("to").alias("peer"))
    facing = core.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    facing = facing.select(*keep, F.col("of").alias("i"), (-1 - F.col("o")).alias("j"), F.lit(0).alias("own"), F.lit(1).alias("peer"))
    outer = dealt.where("not core").withColumn("o", F.pmod(hashed, F.col("m")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    outer = outer.select(*keep, "i", (-1 - F.col("o")).alias("j"), F.lit(1).alias("own"), F.lit(0).alias("peer"))
    every = inner.unionByName(facing).unionByName(outer)
    return every.groupBy("cell", "i", "j").applyInPandas(_join_cell(cosine), "first long, links long, edge long")
