"""Training-corpus pipeline: quality, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each to the shared folder and hands what it reads back to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gumshoe.llm import mixing, packing, rule_ensemble, secrets, simhash
from gumshoe.llm.common import discard, materialize, table
from gumshoe.llm.tokenize import vocabulary_path

#: A document scoring below this is rejected.
LEAST_QUALITY = 0.5
END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled ones, doesn't reject."""
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.filter_quality(docs, model, least=LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed training sequences."""
    return packing.pack_tokens(docs, vocabulary_path("word_bpe_49k.json"), END_ID)


#: (name, function) in order.
STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("secret scans", mask_secrets), ("mixing sources", mix_sources), ("packing", pack)]

#: No SQL: classifier, fingerprints and tokenizer can't be written in it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces packed from ``documents``; every stage's result is written, and its predecessor's deleted once it is read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
