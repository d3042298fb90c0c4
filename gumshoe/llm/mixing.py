"""Mixing sources to target weights with hash-threshold histograms.

A document's key is a 48-bit hash of its id, text and a seed.  Sizes are summed
by source and the top ``LEVEL_BITS`` bits of the key; a running sum over these
bounded histograms finds the bucket where a source's budget runs out, and only
that bucket's rows are summed again by the next bits, until one key is left.
Rows of that key (equal rows) go on by the bits of a hash of their place in the
scan.  Rows below the threshold are taken, rows above are not, the one at it
takes what is left; nothing is sorted and no source is gathered in one task.
``apply_mix`` broadcasts the thresholds, a row a source, and decides every row in
the pass that reads its text, so no text is shuffled.

Defined results: a null source is a source of its own, last in order; a null
text has size 0 and takes 0; a null id hashes like the text ``null``; of equal
rows as many are taken as needed, one in part; an empty table gives no rows;
extra columns are ignored by ``mix`` and kept by ``apply_mix``, where a row
without a word stays once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.llm.common import BROADCAST_ROWS, materialize

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 12
#: Levels of the key, and of the place hash that orders equal rows.
LEVELS, TIE_LEVELS = 4, 4


def word_count(text):
    """Number of words; null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(id_col, text, seed: str):
    """48 hash bits of an id and its text."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit("|"), F.coalesce(text.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def tie_key():
    """48 hash bits of a row's place in the scan; only rows equal in id and text are ordered by it."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 16)


def targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight.  That end state is one water level:
    target = min(weight * level, most * size), found by a running sum over the
    sources ordered by where each stops.
    """
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.col("source").isNull(), F.col("source"))
    n = F.row_number().over(order) - 1
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = totals.withColumn("weight", F.element_at(cycle, (n % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    ranked = ranked.withColumn("stop", F.col("cap") / F.col("weight"))
    rise = one.orderBy("stop", F.col("source").isNull(), "source")
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    after = rise.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(one) * F.lit(share)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    water = F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(one)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(water, F.lit(float("inf"))))
    return ranked.select("source", "source_size", target.alias("target"))


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _refine(sized: DataFrame, plan: DataFrame, few: bool, key: str, levels: int) -> DataFrame:
    """``plan`` with ``prefix`` set to the value of ``key`` at which each source's ``left`` words run out (-1: never), and what is left there."""
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    plan = plan.withColumn("prefix", F.lit(0).cast("long"))
    for level in range(levels):
        shift = LEVEL_BITS * (levels - level - 1)
        inside = sized.alias("a").join(_small(plan.select("source", "prefix"), few).alias("b"), same & (F.shiftright(f"a.{key}", shift + LEVEL_BITS) == F.col("b.prefix")))
        histogram = inside.select("a.source", F.col("a.size"), F.shiftright(f"a.{key}", shift).alias("bucket")).groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        by = Window.partitionBy("source").orderBy("bucket")  # at most 2^LEVEL_BITS rows a source
        running = histogram.withColumn("upto", F.sum("words").over(by))
        joined = running.alias("a").join(_small(plan, few).alias("b"), same).select("a.bucket", "a.words", "a.upto", "b.*")
        # The bucket that the budget ends in: the first whose running sum reaches it.
        ends = joined.where("upto >= left").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("words")).alias("rest")), "bucket").alias("end"))
        kept = [F.col(f"a.{c}") for c in plan.columns if c not in ("left", "prefix")]
        plan = plan.alias("a").join(_small(ends, few).alias("b"), same, "left")
        plan = materialize(plan.select(*kept, F.coalesce("b.end.rest", "a.left").alias("left"), F.coalesce("b.end.bucket", F.lit(-1)).cast("long").alias("prefix")), "mix-plan")
    return plan


def _sized(docs: DataFrame, seed: str, text: str, id_col: str, source: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), mix_key(F.col(id_col), F.col(text), seed).alias("key"), tie_key().alias("tie")
    )


def thresholds(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, bool]:
    """A row a source (source, source_size, target, passes, at_key, at_tie, left), and whether they are few enough to broadcast.

    A source takes ``passes`` times all its rows, rows below (at_key, at_tie) once
    more, and ``left`` words of the row there.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, weights, share, most)
    # Whole passes over a source, and the words its last, partial pass still needs.
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("passes", whole).withColumn("left", F.round("target").cast("long") - whole * F.col("source_size"))
    plan = materialize(plan, "mix-plan")
    few = plan.count() <= BROADCAST_ROWS  # more are joined by shuffle
    plan = _refine(sized, plan, few, "key", LEVELS).withColumnRenamed("prefix", "at_key")
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    at = sized.alias("a").join(_small(plan, few).alias("b"), same & (F.col("a.key") == F.col("b.at_key"))).select("a.source", "a.size", "a.tie")
    if at.groupBy("source").count().where("count > 1").limit(1).count():
        plan = _refine(at, plan, few, "tie", TIE_LEVELS)
    else:
        plan = plan.withColumn("prefix", F.lit(-1).cast("long"))
    return plan.withColumnRenamed("prefix", "at_tie"), few


def _extra(size, key, tie):
    """Words of a row in its source's last, partial pass; at_tie -1 leaves the boundary key to its only row."""
    at = key == F.col("at_key")
    whole = (key < F.col("at_key")) | (at & (tie < F.col("at_tie")))
    return F.when(whole, size).when(at & ((F.col("at_tie") == -1) | (tie == F.col("at_tie"))), F.least(size, F.col("left"))).otherwise(0)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix-1", text: str = "text", id_col: str = "doc_id", source: str = "source"
) -> DataFrame:
    """(id, source, size, source_size, target, taken) for every row."""
    sized = materialize(_sized(docs, seed, text, id_col, source), "mix")
    plan, few = thresholds(sized, weights, share, most)
    rows = sized.alias("a").join(_small(plan, few).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    taken = (F.col("passes") * F.col("size") + _extra(F.col("size"), F.col("key"), F.col("tie"))).cast("long")
    return rows.select(F.col("a._id").alias(id_col), "a.source", "a.size", "b.source_size", "b.target", taken.alias("taken"))


def apply_mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix-1", text: str = "text", id_col: str = "doc_id", source: str = "source"
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (a part of at least half counts as whole)."""
    plan, few = thresholds(materialize(_sized(docs, seed, text, id_col, source), "mix"), weights, share, most)
    size, key = word_count(F.col(text)), mix_key(F.col(id_col), F.col(text), seed)
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).alias("from"), size.alias("size"), key.alias("key"), tie_key().alias("tie"))
    rows = marked.join(_small(plan, few), F.col("from").eqNullSafe(F.col("source")))
    extra = _extra(F.col("size"), F.col("key"), F.col("tie"))
    copies = F.when(F.col("size") > 0, F.col("passes").cast("int") + (2 * extra >= F.col("size")).cast("int")).otherwise(1)
    return rows.select("row", copies.alias("copies")).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
