"""Links between keys and items, counted whole and shown by bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where the keys are equal, nulls too."""
    named = right.select(*[F.col(k).alias(f"_r{n}") for n, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_r{n}"))
    return left.join(named, same, how).drop(*[f"_r{n}" for n in range(len(keys))])


def linked(df: DataFrame, keys: list[str], item: str, most: int = 20) -> DataFrame:
    """(keys, n, sample): distinct items of each key, and at most ``most`` of them, those of least hash, in order.

    The pairs are made distinct first, so one key's rows are spread by item.  Of each of ``SALTS``
    shares of a key the ``most`` of least hash remain, and of these the ``most`` of least hash: no row
    or task holds all items of a key.  The hash makes the sample the same in every run, whatever the
    order of rows.  Null items don't count; a key of nulls only has none.
    """
    at = [f"_k{n}" for n in range(len(keys))]
    pairs = df.select(*[F.col(k).alias(a) for k, a in zip(keys, at)], F.col(item).alias("_item")).distinct().withColumn("_h", F.xxhash64(F.col("_item").cast("string")))
    counts = pairs.groupBy(*at).agg(F.count("_item").alias("n"))
    share = Window.partitionBy(*at, F.pmod("_h", F.lit(SALTS))).orderBy("_h", "_item")
    few = pairs.where("_item is not null").withColumn("_nth", F.row_number().over(share)).where(F.col("_nth") <= most)
    held = few.groupBy(*at).agg(F.slice(F.array_sort(F.collect_list(F.struct("_h", "_item"))), 1, most).alias("s"))
    sample = held.select(*at, F.array_sort(F.transform("s", lambda x: x["_item"])).alias("sample"))
    empty = F.array().cast(sample.schema["sample"].dataType)
    both = beside(counts, sample, at, "left")
    return both.select(*[F.col(a).alias(k) for k, a in zip(keys, at)], "n", F.coalesce("sample", empty).alias("sample"))
