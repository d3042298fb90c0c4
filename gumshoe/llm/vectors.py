"""Integer vectors, dealt into bounded groups in which stated queries meet all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.llm.common import small

SCALE = 256
#: Components of one chunk of rows; a block of queries holds twice as many.
CHUNK_VALUES = 1 << 18
#: Floats hold all integers up to this.
EXACT = float(1 << 53)
#: Bounds beyond this are held at it, so that they don't part scores that are held at the limits of a long.
HELD = 9e18
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def integer_rows(vectors: DataFrame, id_col: str, vector: str, **more: Column) -> DataFrame:
    """(id, z, n, slot, more): components as floor(256 x), their number, and a hash of the row's place.

    Rows without an id, and vectors that are null or hold a null or non-finite component, are left
    out.  Components are held within a long.  ``slot`` deals rows evenly however often they repeat;
    it is fixed once the result is written.
    """
    if (kind := vectors.schema[id_col].dataType.simpleString()) not in _INTEGERS:
        raise ValueError(f"{id_col} holds {kind}, not whole numbers")
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("z"), F.size(v).alias("n"), F.xxhash64(F.monotonically_increasing_id()).alias("slot"), *[c.alias(k) for k, c in more.items()])


def dealt(queries: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Queries (``own``) and rows of equal ``keys``, ``n`` among them, in groups (keys, block, chunk) of bounded size.

    Every query meets every row of its keys in exactly one group.  Rows go to one chunk and are
    copied for each block of queries; queries go to one block and are copied for each chunk.
    """
    per = F.least(F.lit(4096), F.greatest(F.lit(256), F.lit(CHUNK_VALUES) / F.greatest("n", F.lit(1))))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).join(queries.groupBy(*keys).agg(F.count("*").alias("_queries")), keys)
    counts = small(counts.select(*keys, F.ceil(F.col("_rows") / per).cast("int").alias("chunks"), F.ceil(F.col("_queries") / (2 * per)).cast("int").alias("blocks")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod("slot", F.col(n)).cast("int")
    asked = queries.join(counts, keys).withColumns({"own": F.lit(True), "block": of("blocks")}).withColumn("chunk", each("chunks"))
    told = rows.join(counts, keys).withColumns({"own": F.lit(False), "chunk": of("chunks")}).withColumn("block", each("blocks"))
    every = asked.unionByName(told, allowMissingColumns=True).drop("chunks", "blocks")
    groups = counts.agg(F.sum(F.col("chunks").cast("long") * F.col("blocks"))).first()[0] or 1
    # Groups are few bytes and much work, so their tasks aren't to be merged by size.
    return every.repartition(int(min(4 * groups, 8192)), *keys, "block", "chunk")


def parts(table: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Table, np.ndarray]:
    """Queries and rows of a group, each with its matrix of components."""
    n = table["n"][0].as_py()
    out = []
    for own in (True, False):
        t = table.filter(table["own"] if own else pc.invert(table["own"])).combine_chunks()
        z = np.zeros((len(t), n)) if not n or not len(t) else pa.concat_arrays(t["z"].chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        out += [t, z]
    return tuple(out)


def exact(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether floats hold all inner products, and parts of them, exactly."""
    most = lambda x: float(np.abs(x).max(initial=0.0))
    return most(q) * most(c) * max(1, q.shape[1]) < EXACT


def products(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, whole: bool) -> np.ndarray:
    """Integer inner products of pairs; those beyond a long are held at its limits."""
    out = np.zeros(len(i), np.int64)
    step = max(1, (1 << 21) // max(1, q.shape[1]))
    for at in range(0, len(i), step):
        a, b = q[i[at : at + step]], c[j[at : at + step]]
        if whole:
            out[at : at + step] = np.einsum("ij,ij->i", a, b)
        else:
            out[at : at + step] = [min(2**63 - 1, max(-(2**63), sum(int(x) * int(y) for x, y in zip(r, s)))) for r, s in zip(a, b)]
    return out


def same_ids(asked: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions with equal ids."""
    order = np.argsort(told, kind="stable")
    lo, hi = np.searchsorted(told[order], asked, "left"), np.searchsorted(told[order], asked, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(asked)), n)
    return i, order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def first_per(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each ``i``: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~score, i))  # ~score falls as score rises and can't overflow
    at = i[order]
    start = np.searchsorted(at, at, "left")
    return order[np.arange(len(at)) - start < k]
