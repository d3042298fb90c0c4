"""Training-corpus pipeline: quality, near-duplicates, secrets, mixing, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame.  ``run(spark, sf_dir)`` applies them to ``documents``.
"""

from gumshoe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
