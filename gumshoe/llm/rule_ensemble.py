"""Quality classifier: a sparse rule ensemble compiled to Spark column expressions.

Statistics of whole texts are plain column expressions.  A random forest (Spark
ML) on a bounded labelled sample proposes rules: every path from a root to a
node is a conjunction of threshold tests.  A lasso logistic regression weighs
the rules, most get weight zero, and the rest become one column expression, so
scoring a corpus is a narrow projection with no Python.

Null and empty texts have all statistics zero and are scored like any other
text; repeated rows score alike; an empty table gives no rows; with fewer than
two classes to learn from the score is the share of label 1 (0.5 if none);
extra columns are ignored by ``score`` and kept by ``filter_quality``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.llm.common import materialize, small
from gumshoe.llm.labels import training_ids

#: Most labelled rows that a classifier is fitted on.
TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO = 16, 3, 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Named numeric statistics of a text, each one pass of built-in functions."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.split(F.trim(t), r"\s+")
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    found = lambda part: (F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part) / n
    return {
        "log_length": F.log1p(F.length(t)),
        "upper_share": share(r"\p{Lu}"),
        "space_share": found(" "),
        "line_share": found("\n"),
        "digit_share": share("[0-9]"),
        "symbol_share": share(r"[#*$%&@^~=+_]"),
        "pipe_share": share(r"[|<>{}\[\]\\]"),
        "shout_share": share("[!?]"),
        "stop_share": share("[.,;:]"),
        "repeat_share": share(r"(?<!\S)(\S{2,40}+)\s++\1(?!\S)") * 8,
        "distinct_share": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
        "markup_share": found("http") + found("www.") + found("©") + found("ookie") + found("icen"),
    }


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctions over statistics: ((name, op, threshold), ...) -> weight."""

    names: tuple[str, ...]
    rules: tuple[tuple[tuple[tuple[str, str, float], ...], float], ...]
    bias: float

    @property
    def used(self) -> tuple[str, ...]:
        """Statistics that a rule tests; no other is computed for scoring."""
        return tuple(n for n in self.names if any(n == t[0] for tests, _ in self.rules for t in tests))

    def score(self, stats: Column | dict[str, Column]) -> Column:
        """Probability of label 1 from statistics by name."""
        margin = F.lit(float(self.bias))
        for tests, weight in self.rules:
            margin = margin + F.when(_all(tests, stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def _all(tests, stats: Column) -> Column:
    out = None
    for name, op, threshold in tests:
        test = stats[name] <= threshold if op == "<=" else stats[name] > threshold
        out = test if out is None else out & test
    return out


def forest_rules(model, names: list[str]) -> list[tuple[tuple[str, str, float], ...]]:
    """Paths to every inner and leaf node below the roots, simplified, without repeats."""
    found: dict[tuple, None] = {}

    def walk(node, path: dict) -> None:
        if path:
            found[tuple(sorted((n, op, t) for (n, op), t in path.items()))] = None
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, at = names[split.featureIndex()], float(split.threshold())
        for child, op in ((node.leftChild(), "<="), (node.rightChild(), ">")):
            old = path.get((name, op))
            tight = at if old is None else (min(old, at) if op == "<=" else max(old, at))
            walk(child, path | {(name, op): tight})

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), {})
    return list(found)


def stats_struct(text: Column, names: tuple[str, ...] | None = None) -> Column:
    """All statistics, or those named, as doubles."""
    return F.struct(*[c.cast("double").alias(k) for k, c in statistics(text).items() if names is None or k in names])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, text: str = "text", most: int = TRAIN_ROWS) -> RuleModel:
    """Learn from labelled rows outside the held-out fold, ``most`` at most."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    names = list(statistics(F.lit("")))
    ids = training_ids(labels, label, folds, held, most)
    rows = docs.select("doc_id", F.col(text).alias("_text")).join(small(ids), "doc_id").select(F.col("label").cast("double"), stats_struct(F.col("_text")).alias("s")).select("label", "s.*")
    rows = materialize(rows, "quality-train").coalesce(6)  # about ``most`` rows of numbers
    share = dict(rows.groupBy("label").count().collect())
    if len(share) < 2:
        n = sum(share.values())
        p = (share.get(1.0, 0) + 1) / (n + 2)
        return RuleModel(tuple(names), (), float(_logit(p)))
    total = sum(share.values())
    # Between the plain and the balanced sample: rare bad texts count more, doubtful ones lean to the common class.
    weight = F.when(F.col("label") == 1.0, (total / share[1.0]) ** 0.5).otherwise((total / share[0.0]) ** 0.5)
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(rows.withColumn("w", weight)).persist()
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", weightCol="w", numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=5, featureSubsetStrategy="onethird", subsamplingRate=0.8
    ).fit(vectors)
    rules = forest_rules(forest, names)  # at most 2^(DEPTH + 1) - 2 a tree
    if not rules:
        vectors.unpersist()
        return RuleModel(tuple(names), (), float(_logit(share[1.0] / total)))
    stats = F.struct(*[F.col(n) for n in names])
    fired = vectors.select("label", "w", array_to_vector(F.array(*[_all(r, stats).cast("double") for r in rules])).alias("rules")).persist()
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", weightCol="w", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(fired)
    weights = lasso.coefficients.toArray().tolist()
    vectors.unpersist(), fired.unpersist()
    return RuleModel(tuple(names), tuple((r, w) for r, w in zip(rules, weights) if abs(w) > 1e-4), float(lasso.intercept))


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def score(docs: DataFrame, model: RuleModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of every row; statistics are columns of a step of their own, computed once a row."""
    every = statistics(F.col(text))
    stats = docs.select(*keep, *[every[n].cast("double").alias(f"_stat_{n}") for n in model.used])
    return stats.select(*keep, model.score({n: F.col(f"_stat_{n}") for n in model.used}).alias("score"))


def filter_quality(docs: DataFrame, model: RuleModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score at least ``least``."""
    from gumshoe.llm.quality_rules import let

    # A lambda variable: a filter on columns of an earlier step would be pushed below it, and every use computed again.
    return docs.where(let(stats_struct(F.col(text), model.used), model.score) >= least) if model.used else docs.where(model.score({}) >= least)
