"""Pipeline stages against what each promises, on the small tables."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline
    from gumshoe.llm import mixing, secrets, simhash
    from gumshoe.llm.common import materialize, table

    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "secret scans", "mixing sources", "packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], SF), "test"))
    for d in seen[:-1]:
        assert d.columns == docs.columns
    counts = [d.count() for d in seen]
    assert counts[0] > counts[1] >= counts[2] == counts[3] > 0
    assert seen[1].join(docs, docs.columns, "left_anti").count() == 0
    assert simhash.near_components(seen[2]).count() == 0
    left = secrets.scan_secrets(seen[3]).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0]
    assert left == 0
    taken = mixing.mix(seen[3])
    assert seen[4].join(seen[3], docs.columns, "left_anti").count() == 0 and seen[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert abs(taken.agg(F.sum("taken")).first()[0] / taken.agg(F.sum("size")).first()[0] - 1.5) < 0.01
    assert {r.doc_id for r in seen[5].select("doc_id").distinct().collect()} == {r.doc_id for r in seen[4].select("doc_id").distinct().collect()}
    assert corpus_pipeline.run(spark, SF).columns == seen[5].columns
