"""Exact top-k search by a three-phase uniform threshold.

A score is a sum over slices of the components, so each slice is a list of local
scores.  The phases, per query:

1. From each slice the k highest local scores of each chunk of rows are gathered
   and their whole scores taken.  The k-th best of all is a cutoff that the k best
   rows reach, since k rows do.
2. The cutoff goes to all chunks.  A row that reaches it has a local score of at
   least cutoff / slices in some slice; these entries are collected.  A slice in
   which a row has none adds less than cutoff / slices to it.
3. Rows whose entries and these bounds may still reach the cutoff get their exact
   score; those below the cutoff go, the first k of the rest are the result.

Queries and rows meet in groups of bounded size (``vectors.dealt``); what leaves a
task is k scores a query in phase 1, and in phase 3 only rows that reach the cutoff.

Scores are exact integers; those beyond a long are held at its limits.  Vectors
that are null or hold null or non-finite components, and rows without an id, take
no part.  Only vectors of equal length are compared; empty ones score 0.  A row of
the query's id is never its own candidate; repeated rows are candidates each;
several vectors of one query id are searched apart, equal ones once.  Ids must be
whole numbers.  Fewer candidates than k give all; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.llm.common import materialize
from gumshoe.llm.vectors import HELD, dealt, exact, first_per, integer_rows, parts, products, same_ids

SLICES = 4
#: Queries whose local scores against a chunk are held at once.
STEP = 256


def _slices(n: int, slices: int) -> list[slice]:
    cuts = np.linspace(0, n, max(1, min(slices, n)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]


def _gather(k: int, slices: int):
    """Phase 1 in one group: (query, score) of rows that lead a slice's local list."""

    def run(table: pa.Table) -> pa.Table:
        asked, q, told, c = parts(table)
        keys, scores = [], []
        i, j = same_ids(asked["id"].to_numpy(), told["id"].to_numpy())
        own = np.zeros((STEP, len(c)), bool)
        slack = 0.0 if exact(q, c) else 1e-12 * q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
        for at in range(0, len(q) if len(c) else 0, STEP):
            some, mine = q[at : at + STEP], (i >= at) & (i < at + STEP)
            own[:] = False
            own[i[mine] - at, j[mine]] = True
            most = min(k, len(c))
            lead = []
            for s in _slices(q.shape[1], slices):
                local = some[:, s] @ c[:, s].T
                local[own[: len(some)]] = -np.inf
                lead.append(np.argpartition(-local, most - 1, axis=1)[:, :most])
            lead = np.sort(np.concatenate(lead, axis=1), axis=1)
            total = np.einsum("ij,ikj->ik", some, c[lead]) - slack
            total[np.take_along_axis(own[: len(some)], lead, axis=1)] = -np.inf
            total[:, 1:][lead[:, 1:] == lead[:, :-1]] = -np.inf  # a row that leads several lists counts once
            total = -np.sort(-total, axis=1)[:, :k]
            a, b = np.nonzero(total > -np.inf)
            keys.append(asked["slot"].to_numpy()[at + a])
            scores.append(total[a, b])
        return pa.table({"slot": pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), "score": pa.array(np.concatenate([np.zeros(0), *scores]))})

    return run


def reaching(q: np.ndarray, c: np.ndarray, cut: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: pairs that may reach their query's cutoff, by the entries collected from each slice."""
    cuts = _slices(q.shape[1], slices)
    least = (cut / len(cuts))[:, None]
    bound, seen = np.zeros((len(q), len(c))), np.zeros((len(q), len(c)), bool)
    for s in cuts:
        local = q[:, s] @ c[:, s].T
        hit = local >= least
        bound += np.where(hit, local, least)
        seen |= hit
    return np.nonzero(seen & (bound >= cut[:, None]))


def _collect(k: int, slices: int):
    """Phases 2 and 3 in one group: (query, id, score) of the first k rows that reach the cutoff."""

    def run(table: pa.Table) -> pa.Table:
        asked, q, told, c = parts(table)
        ids, whole = told["id"].to_numpy(), exact(q, c)
        cut = np.minimum(asked["cut"].to_numpy(), HELD)
        if not whole:
            cut = cut - 1e-9 * np.abs(cut) - 1e-12 * q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        for at in range(0, len(q) if len(c) else 0, STEP):
            i, j = reaching(q[at : at + STEP], c, cut[at : at + STEP], slices)
            i += at
            other = asked["id"].to_numpy()[i] != ids[j]
            i, j = i[other], j[other]
            score = products(q, c, i, j, whole)
            keep = score >= cut[i]
            i, j, score = i[keep], j[keep], score[keep]
            first = first_per(i, score, ids[j], k)
            i, j, score = i[first], j[first], score[first]
            out.append((asked["slot"].to_numpy()[i], asked["id"].to_numpy()[i], ids[j], score))
        return pa.table({name: pa.array(np.concatenate(x)) for name, x in zip(("slot", "query_id", "vec_id", "score"), zip(*out))})

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k other rows of ``vectors`` of highest integer inner product."""
    rows = materialize(integer_rows(vectors, id_col, vector), "top-rows")
    asked = materialize(integer_rows(queries, id_col, vector).select("id", "z", "n").distinct().withColumn("slot", F.xxhash64("id", "z")), "top-queries")
    met = dealt(asked, rows, ["n"]).select("n", "block", "chunk", "own", "slot", "id", "z")
    lists = met.groupBy("n", "block", "chunk").applyInArrow(_gather(k, slices), "slot long, score double")
    best = Window.partitionBy("slot").orderBy(F.desc("score"))
    cutoff = materialize(lists.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select("slot", F.col("score").alias("cut")), "top-cutoffs")
    known = asked.join(cutoff, "slot", "left").withColumn("cut", F.coalesce("cut", F.lit(float("-inf"))))
    met = dealt(known, rows, ["n"]).select("n", "block", "chunk", "own", "slot", "id", "z", "cut")
    found = met.groupBy("n", "block", "chunk").applyInArrow(_collect(k, slices), "slot long, query_id long, vec_id long, score long")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
