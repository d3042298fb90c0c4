"""Ordered scans whose groups may be larger than a task: running totals, values carried forward, sliding sums.

Rows are cut into ranges by (group, order), so a group with a third of all rows is in many
of them.  Each range is summed up to one row a group, a window over these few rows gives what
the ranges before it add, and a window inside each range does the rest.  Rows that tie in the
order are ranked by a hash of their place and so are split as well.  The ranges are written to
the shared folder, which fixes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.operators.links import beside
from gumshoe.sources.shared import written

#: Rows of a group that one task slides over.
SLIDE = 1 << 16
#: Summed rows up to which they are broadcast.
BROADCAST_ROWS = 1_000_000


def _ranged(df: DataFrame, group: list[str], order: list[str], ranges: int | None) -> DataFrame:
    """``df`` in ranges of (group, order): ``_part`` numbers them, ``_tie`` orders equal rows."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    return written(placed.repartitionByRange(n, *group, *order, "_tie").withColumn("_part", F.spark_partition_id()), "ranges")


def _joined(rows: DataFrame, sums: DataFrame, group: list[str]) -> DataFrame:
    """Rows with what their range's groups got from the ranges before."""
    sums = written(sums, "range-sums")
    return beside(rows, F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums, [*group, "_part"])


def running_totals(df: DataFrame, group: list[str], order: list[str], totals: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``df`` with running sums, the row's own value included, of each of ``totals`` within ``group`` by ``order``."""
    rows = _ranged(df.withColumns({f"_x{n}": c for n, c in enumerate(totals.values())}), group, order, ranges)
    names = {f"_x{n}": name for n, name in enumerate(totals)}
    per = rows.groupBy(*group, "_part").agg(*[F.sum(x).alias(x) for x in names])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = per.select(*group, "_part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_b{x}") for x in names])
    inside = Window.partitionBy("_part", *group).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = _joined(rows, sums, group)
    return joined.select(*df.columns, *[(F.col(f"_b{x}") + F.coalesce(F.sum(x).over(inside), F.lit(0))).alias(name) for x, name in names.items()])


def carry_forward(df: DataFrame, group: list[str], order: list[str], column: str, value: Column, ranges: int | None = None) -> DataFrame:
    """``df`` with ``column`` set to the last ``value`` that isn't null, up to and with the row, within ``group`` by ``order``."""
    rows = _ranged(df.withColumn("_v", value), group, order, ranges)
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order, "_tie")))
    per = rows.groupBy(*group, "_part").agg(last.alias("_v"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = per.select(*group, "_part", F.last("_v", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_part", *group).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = _joined(rows, sums, group).withColumn("_now", F.coalesce(F.last("_v", ignorenulls=True).over(inside), "_carried"))
    return joined.select(*[F.col("_now").alias(c) if c == column else c for c in df.columns])


def sliding_sum(df: DataFrame, group: list[str], order: list[str], value: Column, span: int, name: str, slide: int = SLIDE, ranges: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the row and the ``span - 1`` before it within ``group`` by ``order``.

    Rows get their place in the group; each block of places also gets the last rows of the block before.
    """
    placed = running_totals(df.withColumn("_value", value), group, order, {"_place": F.lit(1)}, ranges).withColumn("_block", F.floor((F.col("_place") - 1) / slide))
    late = F.pmod(F.col("_place") - 1, F.lit(slide)) >= slide - (span - 1)
    copies = placed.withColumn("_of", F.explode(F.when(late, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block"))))
    w = Window.partitionBy(*group, "_of").orderBy("_place").rowsBetween(-(span - 1), 0)
    return copies.withColumn(name, F.sum("_value").over(w)).where(F.col("_of") == F.col("_block")).select(*df.columns, name)


def numbered(df: DataFrame, order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the rows numbered from 0 by ``order``; no task sees more than a range."""
    out = running_totals(df.withColumn("_all", F.lit(0)), ["_all"], order, {name: F.lit(1)}, ranges)
    return out.withColumn(name, F.col(name) - 1).drop("_all")
