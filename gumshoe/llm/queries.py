"""Registered queries of the training-data operators and the SQL that some equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.llm import mixing, negatives, packing, quality_rules, range_join, rule_ensemble, secrets, simhash, spelling, token_store, topk, toxicity, warc
from gumshoe.llm.common import table
from gumshoe.llm.labels import fold
from gumshoe.llm.tokenize import vocabulary_path

END_ID = 2
DECIDE = 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= DECIDE).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), END_ID)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_table(table(spark, sf_dir, "pages"), least_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_table(table(spark, sf_dir, "documents")).drop("rejected_by")  # whose order of rules is measured


def op7_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.range_join(table(spark, sf_dir, "embeddings"), 0.95)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = rule_ensemble.score(docs, rule_ensemble.fit(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= DECIDE).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_table(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), END_ID)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(rows, rows.where("vec_id % 50 = 0"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_packing, op3_mixing, op4_secrets, op5_warc, op6_quality_rules, op7_range_join, op8_quality_classifier, op9_simhash, op10_token_store, op11_spelling, op12_top_k, op13_hard_negatives, pipeline
    )
}

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, '')), 1, 12) AS BIGINT) AS h
  FROM documents),
t AS (SELECT source, sum(size) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT source, s, 2 * s AS cap, [3, 1, 2][n % 3 + 1] AS weight FROM t),
l AS (SELECT *, cap / weight AS stop,
             (sum(s) OVER () * 1.5 - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST)),
g AS (SELECT max(level) FILTER (level <= stop) AS water FROM l),
p AS (SELECT source, s, CAST(least(cap, weight * coalesce(water, 1e300)) AS DOUBLE) AS target FROM l, g),
q AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(round(target) / s) AS BIGINT) ELSE 0 END AS passes FROM p),
c AS (SELECT d.doc_id, d.size, q.s, q.target, q.passes, CAST(round(q.target) AS BIGINT) - q.passes * q.s AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c
"""

_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x, max(page_id) OVER (PARTITION BY sha1(b)) AS holder FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, CAST(k // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - k % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM h
"""

_RANGE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b AS a, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN m ON vec_id = m.a LEFT JOIN n ON vec_id = n.a
"""

#: Words of at least 6 code points and 5 occurrences; crc32 by a table made from its polynomial, near words by their deletions.
_SPELLING = r"""
WITH RECURSIVE tbl AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(0, 8), lambda z: CAST(0 AS BIGINT))),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT id, run, count(*) AS k FROM r GROUP BY ALL),
b AS (SELECT *, list_transform(range(0, CAST(length(hex(encode(id || ':' || run))) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(id || ':' || run)), CAST(2 * i + 1 AS INT), 2) AS BIGINT)) AS x FROM g),
h AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), x), lambda c, y: xor(c >> 8, t[CAST((xor(c, y) & 255) + 1 AS INT)])), 4294967295) AS h FROM b, tbl),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, CAST(h % length(run) + 2 AS INT)) ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT word, n, i, left(word, i) || substr(word, CAST(i + 2 AS INT)) AS x FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
e AS (SELECT p.word AS a, q.word AS b, q.n FROM d p JOIN d q ON p.x = q.x AND p.i = q.i AND p.word <> q.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.x = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.x = v.word),
m AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n FROM e GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM v LEFT JOIN m ON word = a),
u AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, u.root FROM f JOIN u ON f.form = u.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN u USING (word)
"""

_WHOLE = "vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS z"
_FINITE = "embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_TOP = f"""
WITH v AS (SELECT {_WHOLE} FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_HARD = f"""
WITH v AS (SELECT {_WHOLE}, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

#: The rest need a tokenizer, a fitted model, XXH64 or a dynamic program; they are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op3_mixing": _MIX, "op5_warc": _WARC, "op7_range_join": _RANGE, "op11_spelling": _SPELLING, "op12_top_k": _TOP, "op13_hard_negatives": _HARD}
