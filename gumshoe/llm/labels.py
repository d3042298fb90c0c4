"""Held-out folds and bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text ``null``."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")) % folds).cast("int")


def training_ids(labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """(doc_id, label) of labelled rows outside the held-out fold: all, or about ``most`` of them by an id hash.

    Rows with a null label or id are left out; labels other than 0 are 1; an id labelled both ways counts as 1.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id"), folds) != held)
    rows = rows.groupBy("doc_id").agg(F.max((F.col(label) != 0).cast("int")).alias("label"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return rows
