"""Mergeable summaries: most frequent values, and distinct counts that add up over shares of the data."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a sketch of frequent values tracks.
TRACKED = 10_000
#: log2 of the registers of a distinct-count sketch; its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 14


def frequent_sketches(df: DataFrame, column: str, by: list[str], tracked: int = TRACKED) -> DataFrame:
    """(by, rows, frequent): a sketch of the frequent values of ``column`` in each share of the rows."""
    return df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("rows"), F.call_function("approx_top_k_accumulate", F.col(column), F.lit(tracked)).alias("frequent"))


def heavy_hitters(df: DataFrame, column: str, most: int = 20, tracked: int = TRACKED, shares: int = 32) -> DataFrame:
    """(key, n): the ``most`` most frequent values with their exact counts, ties to the least.

    Sketches of shares of the rows are combined, and what they hold as most frequent is counted
    exactly; only these few values are shuffled.  A value that the sketch doesn't track occurs at
    most ``floor`` times, and one it doesn't return at most as often as the last it returns.  If the
    last of the exact list isn't above both, as with many values of like frequency, and there are other
    values at all, all are counted.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("key"))
    parts = frequent_sketches(rows.withColumn("_share", F.pmod(F.monotonically_increasing_id(), F.lit(shares))), "key", ["_share"], tracked)
    wanted = min(4 * most, tracked)
    one = parts.withColumn("_one", F.lit(0)).groupBy("_one").agg(F.sum("rows").alias("rows"), F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(tracked)).alias("s"))
    row = one.select("rows", F.call_function("approx_top_k_estimate", "s", F.lit(wanted))).first()
    total, found = row or (0, [])
    top = lambda counted: counted.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(most)
    if not found:  # no rows, or none frequent enough to be held
        return top(rows)
    names = [r["item"] for r in found]
    floor = 3.5 * total / (1 << max(3, (int(tracked / 0.75) - 1).bit_length()))
    unseen = max(floor, found[-1]["count"] if len(found) == wanted else 0)
    among = rows.where(F.col("key").isin(names))
    counts = sorted((r["n"] for r in among.groupBy("key").agg(F.count("*").alias("n")).collect()), reverse=True)  # of ``wanted`` values at most
    certain = sum(counts) == total or len(counts) >= most and counts[most - 1] > unseen
    return top(among if certain else rows)


def distinct_sketches(df: DataFrame, columns: dict[str, list[str]], by: list[str], lg_k: int = LG_K) -> DataFrame:
    """(by, rows, a sketch for each name): distinct tuples of its columns in each share of the rows; a null in a tuple leaves it out."""
    def tuples(names: list[str]) -> Column:
        return F.when(reduce(and_, [F.col(c).isNotNull() for c in names]), F.to_json(F.array(*[F.col(c).cast("string") for c in names])))

    return df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.hll_sketch_agg(tuples(c), F.lit(lg_k)).alias(name) for name, c in columns.items()])


def merged_counts(sketches: DataFrame, names: list[str]) -> DataFrame:
    """One row: the rows and the estimated distinct counts of all shares together."""
    return sketches.agg(F.sum("rows").alias("rows"), *[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in names])
