"""Spelling variants, exact top-k and hard negatives against brute force, with the odd inputs."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gumshoe.llm import negatives, queries, range_join, spelling, topk, vectors

VEC = "vec_id long, embedding array<double>, label int, id long, z string, slot int, n string, own string"


# --- op 11 ---------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(rows):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    out, form = [], {}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def variants(seed, letters="abé", base=25):
    """Texts of words of one hot prefix, with edits that make chains of forms."""
    r = random.Random(seed)
    texts, words = [], []
    for _ in range(base):
        w = "hot" + "".join(r.choice(letters) for _ in range(r.randint(3, 7)))
        words.append((w, r.choice([5, 6, 30, 160, 800])))
        for _ in range(4):
            i = r.randrange(len(w))
            words.append((r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + "q" + w[i + 1 :], w[1:], "x" + w]), r.choice([1, 5, 6, 25])))
    for w, k in words:
        texts.append(" ".join([w.upper() if r.random() < 0.2 else w] * k))
    return texts


def test_spelling_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "RANGE", 16)  # many ranges, a hot prefix over several of them
    monkeypatch.setattr(spelling, "LOOKED_UP", 8)  # and several tasks a range
    texts = variants(1) + variants(2, "ab", 40) + [None, "", "  ", "Ünïcode ÜNÏCODE Ünïcode ünïcode ünïcode x×y÷zabcdef", "ab" * 9000, "日本語 \U0001f600 naïve_naïver", "a b c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, "nullid nullid nullid nullid nullid nullib " * 3)]
    df = spark.createDataFrame([(k, t, "clash", 1, "w", "f") for k, t in rows], "doc_id long, text string, id string, n int, word string, form string")
    assert sorted(map(tuple, spelling.spelling_groups(df).collect()), key=str) == sorted(brute_groups(rows), key=str)
    assert spelling.spelling_groups(df.where("false")).collect() == []
    assert spelling.spelling_groups(df.where("text is null or text = ''")).collect() == []


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(20)] + [("x", "w05"), ("y", "z")]
    found = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert found == {**{f"w{i:02d}": "w20" for i in range(20)}, "x": "w20", "y": "z"}


@pytest.mark.parametrize("letters", ["ab", "abcÿ"])
def test_band_scan_finds_all_pairs_one_edit_apart(letters):
    r = random.Random(5)
    for _ in range(60):
        word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
        entries, asked = sorted({word() for _ in range(60)}), [word() for _ in range(40)]
        assert sorted(spelling.near_pairs(entries, asked)) == sorted((i, j) for i, a in enumerate(asked) for j, b in enumerate(entries) if one_edit(a, b))


def test_near_words_share_half_at_one_end():
    r = random.Random(6)
    for _ in range(5000):
        a = "".join(r.choice("ab") for _ in range(r.randint(6, 13)))
        i = r.randrange(len(a) + 1)
        b = r.choice([a[:i] + "c" + a[i:], a[:i] + "c" + a[i + 1 :], a[:i] + a[i + 1 :]])
        if len(b) >= 6 and one_edit(a, b):
            h = spelling.half(len(a))
            assert a[:h] == b[:h] or a[-h:] == b[-h:]


# --- op 12, 13 -----------------------------------------------------------------------------------------------------


def vector_frame(spark, seed, rows=700, n=8, grid=None, labels=3):
    """Rows with ties and repeats, of which some can't take part."""
    r = np.random.default_rng(seed)
    x = r.integers(-grid, grid + 1, (rows, n)) / 256.0 if grid else r.standard_normal((rows, n)) / np.sqrt(n)
    out = [(int(i), v.tolist(), int(r.integers(labels)), 1, "c", 2, "c", "c") for i, v in enumerate(x)]
    out += out[50:53] + [(100, out[7][1], 1, 0, "c", 0, "c", "c")]  # repeated rows; an id of two vectors
    odd = [None, [], [float("nan")] * n, [float("inf")] + [0.0] * (n - 1), [None] + [0.0] * (n - 1), [0.0] * n, [1.0] * (n + 3), [2.0] * (n + 3)]
    out += [(1000 + 50 * k, v, k % labels if k != 6 else None, 0, "c", 0, "c", "c") for k, v in enumerate(odd)]
    out += [(None, [1.0] * n, 0, 0, "c", 0, "c", "c")]
    return spark.createDataFrame(out, VEC)


def plain(df, labelled=False):
    """(id, integer components, label) of the rows that take part."""
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    return [(r.vec_id, tuple(int(np.floor(256 * x)) for x in r.embedding), r.label) for r in df.collect() if r.vec_id is not None and ok(r.embedding) and not (labelled and r.label is None)]


def held(x):
    return max(-(2**63), min(2**63 - 1, x))


def brute_top(rows, k, every):
    out = []
    for q, a, _ in dict.fromkeys((i, z, 0) for i, z, _ in rows if i % every == 0):
        scored = sorted((-held(sum(x * y for x, y in zip(a, z))), i) for i, z, _ in rows if i != q and len(z) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def brute_negatives(rows, k, every):
    dot = lambda a, b: held(sum(x * y for x, y in zip(a, b)))
    out = []
    for q, a, label in dict.fromkeys(r for r in rows if r[0] % every == 0):
        others = [(-dot(a, z), i, m) for i, z, m in rows if i != q and len(z) == len(a)]
        for ps, p, _ in sorted(o for o in others if o[2] == label)[:k]:
            found = sorted((s, i) for s, i, m in others if m != label and -80 * ps <= -100 * s <= -100 * ps)
            out += [(q, p, n + 1, i, -ps, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "grid", "scale"), [(1, 3, 1.0), (2, None, 1.0), (3, None, 1e6), (5, None, 1e9), (4, 1, 1.0)])
def test_top_k_equals_brute_force(spark, monkeypatch, seed, grid, scale):
    monkeypatch.setattr(vectors, "CHUNK_VALUES", 1)  # groups of 256 rows
    df = vector_frame(spark, seed, grid=grid)
    if scale != 1.0:
        df = df.withColumn("embedding", F.transform("embedding", lambda x: x * scale))
    found = topk.exact_top_k(df, df.where("vec_id % 50 = 0"), 5)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute_top(plain(df), 5, 50)


def test_top_k_of_few_rows_and_of_none(spark):
    df = vector_frame(spark, 9).where("vec_id < 3")
    assert sorted(map(tuple, topk.exact_top_k(df, df, 5).collect())) == brute_top(plain(df), 5, 1)
    assert topk.exact_top_k(df.where("false"), df.where("false")).collect() == []
    assert negatives.hard_negatives(df.where("false"), df.where("false")).collect() == []
    with pytest.raises(ValueError, match="whole numbers"):
        topk.exact_top_k(df.withColumn("vec_id", F.col("vec_id").cast("string")), df)


def test_phases_prune_and_lose_no_row():
    r = np.random.default_rng(4)
    q, c = (np.floor(256 * r.standard_normal((n, 64)) / 8) for n in (20, 3000))
    score = q @ c.T
    cut = np.sort(score, axis=1)[:, -20]
    i, j = topk.reaching(q, c, cut, topk.SLICES)
    reached = set(zip(i.tolist(), j.tolist()))
    assert set(zip(*(x.tolist() for x in np.nonzero(score >= cut[:, None])))) <= reached
    assert len(reached) < 0.5 * score.size


@pytest.mark.parametrize(("seed", "grid", "scale"), [(1, 3, 1.0), (2, None, 1.0), (4, 1, 1.0), (3, None, 1e6), (5, None, 1e9)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, grid, scale):
    monkeypatch.setattr(vectors, "CHUNK_VALUES", 1)
    df = vector_frame(spark, seed, grid=grid)
    if scale != 1.0:
        df = df.withColumn("embedding", F.transform("embedding", lambda x: x * scale))
    found = negatives.hard_negatives(df, df.where("vec_id % 20 = 0"))
    assert sorted(map(tuple, found.collect())) == brute_negatives(plain(df, True), 5, 20)


@pytest.mark.parametrize("n", [1, 5, 64, 100])
def test_intervals_hold_all_scores_and_screen(n):
    r = np.random.default_rng(n)
    z = np.floor(256 * r.standard_normal((800, n)) / np.sqrt(n))
    z[0] = 0
    low, high = negatives.intervals(z[:40], *negatives.encode(z))
    score = z[:40] @ z.T
    assert (low <= score).all() and (score <= high).all()
    if n == 64:
        least = 0.3 * 256 * 256
        assert ((high >= least).mean()) < 0.25  # most of the rows need no integer score


def test_registered_queries_equal_brute_force_on_their_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = plain(spark.read.parquet(f"{sf}/embeddings.parquet"), True)
    assert sorted(map(tuple, queries.op12_top_k(spark, sf).collect())) == brute_top(rows, 5, 50)
    turned = [(i, z, (m + 1) % 10 if i % 7 == 0 else m) for i, z, m in rows]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, sf).collect())) == brute_negatives(turned, 5, 100)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op11_spelling(spark, sf)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_groups([tuple(d) for d in docs]), key=str)


# --- op 7 ----------------------------------------------------------------------------------------------------------


def test_range_join_of_the_test_table_uses_cells(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    n = rows.count()
    cells = range_join.cell_report(rows).collect()  # as the registered query calls it
    assert len(cells) >= range_join.LEAST_PIVOTS
    assert sum(c.core for c in cells) == n and sum(c.sent for c in cells) > 0  # boundaries are replicated
    compared = sum(c.pairs for c in cells)
    print(f"pairs compared {compared} of {n * (n - 1) // 2}")
    assert compared <= n * (n - 1) // 2
    x = np.array([r.embedding for r in rows.orderBy("vec_id").collect()], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in queries.op7_range_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == dict(enumerate(near.sum(1).tolist()))


def test_range_join_prunes_clustered_vectors(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 16))
    x = centres[r.integers(40, size=1500)] + 0.05 * r.standard_normal((1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    cells = range_join.cell_report(df).collect()
    assert len(cells) > range_join.LEAST_PIVOTS and sum(c.pairs for c in cells) < 0.1 * 1500 * 1499 / 2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert {r.vec_id: r.n_links for r in range_join.range_join(df).collect()} == dict(enumerate(near.sum(1).tolist()))
    with pytest.raises(ValueError, match="whole numbers"):
        range_join.range_join(df.withColumn("vec_id", F.col("vec_id").cast("string")))
