"""Document quality rules run as a short-circuit cascade of column expressions.

``measures`` gives the base counts of every whole text.  ``RULES`` are further
checks, each a cheap condition over a text that names what it rejects.  On a
random sample of about ``SAMPLE_ROWS`` rows ``order_rules`` times each rule, less
what a job costs that only reads the sample, and counts what it rejects; rules
are sorted by rejections per second in powers of two, so that reruns agree but
for close calls.  ``verdict`` is one nested CASE in that order, so a text that
one rule rejects never pays for the rules after it.  The order changes cost
only: a text is kept if no rule rejects it.

A null text has no words, lines or symbols and fails the base rule; empty and
one-word texts are defined the same way; repeated rows give equal results; an
empty table gives no rows; extra columns are ignored by ``quality_table`` and
kept by ``filter_quality``.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated, files it is held in, times each row is judged, and rounds of which the fastest counts.
SAMPLE_ROWS, SAMPLE_FILES, REPEATS, ROUNDS = 1000, 8, 4, 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once: a lambda variable, so no rewrite repeats it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def count_in(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.regexp_count(text, F.lit("[" + "".join(f"\\x{ord(c):02x}" for c in characters) + "]")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(windows: Column) -> Column:
        """Windows hashed; only texts with an equal pair are sorted, and positions of equal neighbours summed."""
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def fold(rows: Column) -> Column:
            n = F.size(rows)
            twice = F.filter(
                F.arrays_zip(
                    rows.alias("a"),
                    F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(rows, F.lit(1), n - 1)).alias("b"),
                    F.concat(F.slice(rows, F.lit(2), n - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))).alias("c"),
                ),
                lambda z: F.coalesce(z["a"]["h"] == z["b"]["h"], F.lit(False)) | F.coalesce(z["a"]["h"] == z["c"]["h"], F.lit(False)),
            )
            at = F.sort_array(F.transform(twice, lambda z: z["a"]["i"]))
            start = F.struct(F.lit(-9).alias("end"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                at, start, lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(i, s["end"])).cast("long").alias("n")), lambda s: s["n"]
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(placed, fold))

    def hashed(w: Column) -> Column:
        n = F.greatest(F.size(w) - 2, F.lit(0))
        zipped = F.arrays_zip(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), F.slice(w, F.lit(3), n))
        return F.transform(zipped, lambda z: F.xxhash64(z))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(hashed(words), covered))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    whole = F.coalesce(text, F.lit(""))
    chars = F.length(whole).cast("long") - F.regexp_count(whole, F.lit(r"[\x20\x09-\x0D]"))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            chars.alias("word_chars"),
            count_in(whole, SYMBOLS).alias("n_symbols"),
            duplicate_lines(whole).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def rules(text: Column, m: Column) -> dict[str, Column]:
    """Named conditions that reject a text; ``m`` is its ``measures``."""
    n = F.greatest(m["n_words"], F.lit(1))
    size = F.greatest(F.length(text), F.lit(1))
    return {
        "odd_word_length": (m["word_chars"] < 2 * n) | (m["word_chars"] > 14 * n),
        "many_symbols": m["n_symbols"] > 0.2 * n,
        "repeated_lines": (m["n_dup_lines"] > 2) & (m["n_dup_lines"] > 0.3 * F.size(F.split(text, "\n"))),
        "shouting": F.regexp_count(text, F.lit(r"\p{Lu}")) > 0.5 * size,
        "few_letters": F.regexp_count(text, F.lit(r"\P{L}")) > F.length(text) - 0.5 * size,
        "many_bullets": F.regexp_count(text, F.lit(r"(?m)^[ \t]*[-*•]")) > 0.9 * F.size(F.split(text, "\n")),
        "long_run": text.rlike(r"(\S)\1{29}"),
    }


def measure_rules(docs: DataFrame, text: str = "text") -> dict[str, tuple[float, float]]:
    """Seconds that judging the sample by each rule takes, and the share of rows that it rejects."""
    rows = docs.count()
    sample = docs.select(F.col(text).alias("t")).sample(min(1.0, SAMPLE_ROWS / max(1, rows)), seed=7).where(F.col("t").isNotNull())
    sample = materialize(sample.repartition(SAMPLE_FILES).select("t", measures(F.col("t")).alias("m")), "rule-sample")
    often = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def run(value: Column) -> tuple[float, int, int]:
        took = []
        for _ in range(ROUNDS):
            began = time.perf_counter()
            total, n = often.agg(F.sum(value), F.count("*")).first()
            took.append(time.perf_counter() - began)
        return min(took), total or 0, n

    idle, _, _ = run(F.length("t"))
    found = {}
    for name, condition in rules(F.col("t"), F.col("m")).items():
        took, rejected, n = run(condition.cast("int"))
        found[name] = (max(took - idle, idle / 16), (rejected + 0.5) / (n + 1))
    return found


def order_rules(docs: DataFrame, text: str = "text") -> list[str]:
    """Rule names by rejections per second on a sample, best first."""
    worth = {name: round(math.log2(share / seconds)) for name, (seconds, share) in measure_rules(docs, text).items()}
    return sorted(worth, key=lambda k: (-worth[k], k))


def verdict(text: Column, m: Column, order: list[str]) -> Column:
    """Name of the first rule in ``order`` that rejects the text, else null; later rules aren't evaluated."""
    found = F.when(base_failed(m), "base")
    every = rules(text, m)
    for name in order:
        found = found.when(every[name], name)
    return found


def quality_table(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) per row."""
    order = order_rules(docs, text)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("_t"), measures(F.col(text)).alias("_m"))
    rows = rows.withColumn("_v", verdict(F.col("_t"), F.col("_m"), order))
    return rows.select(id_col, "_m.*", base_failed(F.col("_m")).alias("base_failed"), F.col("_v").isNull().alias("kept"), F.col("_v").alias("rejected_by"))


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the cascade keeps, with their columns."""
    order = order_rules(docs, text)
    return docs.where(let(measures(F.col(text)), lambda m: verdict(F.coalesce(F.col(text), F.lit("")), m, order).isNull()))
