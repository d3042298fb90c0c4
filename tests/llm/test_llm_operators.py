"""Training-data operators against brute force, round trips and held-out accuracy, with the odd inputs."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gumshoe.llm import mixing, packing, quality_rules, range_join, rule_ensemble, secrets, simhash, token_store, toxicity, warc
from gumshoe.llm.common import connected_components
from gumshoe.llm.tokenize import UnitCodec, codec, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, fp long, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "a", "one two three", "x " * 3000, "é" * 200, "tab\tand  two", "line\n\nline\nline\n", "\U0001f600 smile", "ends ", "中文字符 测试", "ab" * 9000]


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources[i] if sources else f"s{i % 3}"), len(t or ""), "clash", 7, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def words():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))


@pytest.fixture(scope="module")
def odd(spark, words):
    texts = ODD + [words(40, i) for i in range(20)] + [words(40, 1)] * 3
    df = frame(spark, texts)
    return df.unionByName(df.where("doc_id in (3, 4)")).unionByName(spark.createDataFrame([(None, "null id here", None, None, None, None, None, None)], SCHEMA)).cache()


def empty(df):
    return df.where(F.lit(False))


# --- op 2, 10: tokens ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_unit_codec_equals_whole_text_encoding(name, words):
    c = codec(vocabulary_path(name))
    texts = [t for t in ODD if t] + ["It's we'll DON'T 12 a1b", "word.Next, (a) b!", "İx ΣΑΣ y", "á é", "<|endoftext|> x", "a\r\nb\x0bc", words(300, 9).capitalize() + ".\nNext one."]
    ids, offsets = c.encode(pa.array([*texts, None]))
    for n, e in enumerate(c.tokenizer.encode_batch([*texts, ""], add_special_tokens=False)):
        assert ids[offsets[n] : offsets[n + 1]].tolist() == e.ids, texts[n : n + 1]


def test_unit_codec_encodes_bounded_slices(words, monkeypatch):
    """Packing holds the ids of one slice at a time, and long uncut texts don't go to the library together."""
    c = UnitCodec(vocabulary_path("word_bpe_49k.json"))
    texts = pa.array([None, *(words(60, n) for n in range(40)), "", *(words(20_000, n) + " " for n in range(8)), None])
    sizes = [len(t or "") for t in texts.to_pylist()]
    asked = []

    class Told:
        def __getattr__(self, name, real=c.tokenizer):
            if name == "encode_batch":
                return lambda batch, **opts: asked.append(sum(map(len, batch))) or real.encode_batch(batch, **opts)
            return getattr(real, name)

    whole, offsets = c.encode(texts)
    monkeypatch.setattr(c, "tokenizer", Told())
    parts = list(c.encode_slices(texts, 4000))
    assert np.array_equal(np.concatenate([i for _, i, _ in parts]), whole)
    assert [first for first, _, _ in parts] == np.cumsum([0, *(len(o) - 1 for _, _, o in parts)])[:-1].tolist()
    assert all(sum(sizes[a : a + len(o) - 1]) <= 4000 + max(sizes) for a, _, o in parts) and len(parts) > 8
    asked.clear()
    c.encode(texts)
    assert sum(sizes[-9:]) > 2 * max(asked) and np.array_equal(c.encode(texts)[1], offsets)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_unit_codec_is_independent_of_what_came_before(name):
    r = random.Random(8)
    units = ["the", "Ġthe", "Ċthe", "Ġ", "Ċ", "house", "Ġhouse", "in", ".", "a1", "Ã©", "é", "x\u00a0y", "don't", "THE", "</w>", "the</w>", "12", "\u2028", "ġ"]
    blanks = [" ", " ", " ", "\n", "  ", "\t", "\r\n", ""]
    texts = ["".join(r.choice(units) + r.choice(blanks) for _ in range(r.randint(1, 9))) for _ in range(20_000)]
    c = UnitCodec(vocabulary_path(name))
    want = [e.ids for e in c.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1)):
        c = UnitCodec(vocabulary_path(name))
        for at in range(0, len(texts), 1000):
            some = [order[k] for k in range(at, at + 1000)]
            ids, offsets = c.encode(pa.array([texts[k] for k in some]))
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [want[k] for k in some]


def whole_ids(name, text):
    return np.array(codec(vocabulary_path(name)).tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def check_pieces(rows, docs):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for doc, pieces in by_doc.items():
        ids = docs[doc]
        starts = collections.Counter(p.start for p in pieces)
        assert len(set(starts.values())) == 1  # repeated rows are packed once each
        copies = starts[0]
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids) and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
    return by_sequence


def test_packing(spark, odd):
    path = vocabulary_path("word_bpe_49k.json")
    docs = {r.doc_id: whole_ids("word_bpe_49k.json", r.text) for r in odd.select("doc_id", "text").collect()}
    check_pieces(packing.pack_tokens(odd.repartition(3), path, 2).collect(), docs)
    assert packing.pack_tokens(empty(odd), path, 2).count() == 0


def test_packing_wastes_little_and_keeps_ids(spark, words):
    df = frame(spark, [words(50 + 37 * i % 1500, i) for i in range(300)]).repartition(4)
    rows = packing.pack_tokens(df, vocabulary_path("word_bpe_49k.json"), 2, keep_ids=True).collect()
    sequences = check_pieces(rows, {r.doc_id: whole_ids("word_bpe_49k.json", r.text) for r in df.collect()})
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert sum(r.length for r in rows) / (packing.WINDOW * len(sequences)) > 0.95


def test_best_fit_bound():
    fit = packing.BestFit(100, 2)
    assert [fit.place(n) for n in (60, 70, 30, 40, 90)] == [(0, 0), (1, 0), (1, 70), (0, 60), (2, 0)]
    fit = packing.BestFit(100, 2)
    for n in (60, 70, 80, 50):
        fit.place(n)
    assert len(fit.by_room) <= 2


@pytest.mark.parametrize("ids", [[5], [7] * 3000, list(range(3000)), [1, 2, 60000] * 900, [0, 2**20, 3] * 700])
def test_block_round_trip(ids):
    ids = np.array(ids, np.uint32)
    raw = token_store.encode_group(np.array([4, 0], np.int64), np.array([False, True]), np.array([len(ids), 0]), ids, 3, 9)
    end = token_store.END.encode()
    two = list(token_store.groups(raw + end + raw + end))
    assert len(two) == 2
    for g in two:
        assert g.doc_ids.tolist() == [4, 0] and g.nulls.tolist() == [False, True] and g.lengths.tolist() == [len(ids), 0] and (g.part, g.group) == (3, 9)
        for a, b in ((0, None), (0, 1), (1000, 1100), (len(ids) - 1, len(ids)), (0, len(ids)), (5, 5)):
            assert np.array_equal(g.ids(a, b), ids[a:b])


def test_end_marks_inside_a_group_are_masked(spark, tmp_path):
    odd_id = int.from_bytes(token_store.END.encode() + bytes(3), "little")
    ids = np.array([5, 6, 7], np.uint32)
    raw = token_store.encode_group(np.array([odd_id], np.int64), np.array([False]), np.array([3]), ids)
    end = token_store.END.encode()
    assert end not in raw and (raw + end).find(end) == len(raw)
    (g,) = token_store.groups(raw + end)
    assert g.doc_ids.tolist() == [odd_id] and g.ids().tolist() == [5, 6, 7]
    docs = spark.createDataFrame([(odd_id, "one two"), (1, "three")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_store.token_table(docs, vocabulary_path("byte_bpe_50k.json"), 2).collect()}
    assert got == {odd_id: len(whole_ids("byte_bpe_50k.json", "one two")), 1: len(whole_ids("byte_bpe_50k.json", "three"))}


def test_outliers_do_not_widen_blocks():
    ids = np.array(([3, 4, 5, 6] * 255 + [50000] * 4), np.uint32)
    assert len(token_store.encode_block(ids)) < 400


def test_token_table(spark, odd):
    got = token_store.token_table(odd.repartition(3), vocabulary_path("byte_bpe_50k.json"), 2).collect()
    source = sorted(odd.select("doc_id", "text").collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    at = 0
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in source]
    for r, s in zip(got, source):
        ids = whole_ids("byte_bpe_50k.json", s.text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.token_table(empty(odd), vocabulary_path("byte_bpe_50k.json"), 2).count() == 0
    with pytest.raises(TypeError):
        token_store.token_table(odd.withColumn("doc_id", F.lit("a")), vocabulary_path("byte_bpe_50k.json"), 2)


def test_token_files_split_hot_ids(spark, words, tmp_path):
    texts = [words(1500, i) for i in range(700)]
    rows = [(None if i % 3 == 0 else -(1 << 63) if i % 3 == 1 else 5, t, "en", "a", 0, "", 0, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(token_store.token_table(df, vocabulary_path("byte_bpe_50k.json"), 2, path=str(tmp_path / "t")).collect(), key=lambda r: r.start)
    want = collections.Counter((r[0], zlib.crc32(ids.tobytes()), len(ids)) for r in rows for ids in [whole_ids("byte_bpe_50k.json", r[1])])
    assert collections.Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got) and [r.doc_id or 0 for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    files = [p.read_bytes() for p in (tmp_path / "t").glob("part-*") if p.stat().st_size]
    assert len(files) >= 4


# --- op 3 ----------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    sources = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    budget, active, out = 1.5 * sum(sizes.values()), set(sources), {}
    while active:
        level = budget / sum(weight[s] for s in active)
        over = [s for s in active if level * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in active}
        for s in over:
            out[s] = 2 * sizes[s]
            budget -= out[s]
            active.discard(s)
    return out


@pytest.mark.parametrize("skew", [False, True])
def test_mixing(spark, words, skew):
    r = random.Random(1)
    texts = [words(r.randint(0, 80), i) for i in range(400)] + [None, ""]
    names = [("hot" if skew and i % 3 == 0 else r.choice(["a", "b", "c", "é", None])) for i in range(len(texts))]
    df = frame(spark, texts, names)
    rows = mixing.mix(df).collect()
    sizes = collections.Counter()
    for t, s in zip(texts, names):
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = brute_targets(dict(sizes)), collections.Counter()
    assert len(rows) == len(texts)
    for x in rows:
        assert x["size"] == len(WORD.findall(texts[x.doc_id] or "")) and x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        assert 0 <= x.taken <= 2 * x["size"]
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = {(x.doc_id, x.taken) for x in mixing.mix(df.repartition(7)).collect()}
    assert again == {(x.doc_id, x.taken) for x in rows}


def test_mixing_odd_rows(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix(empty(odd)).count() == 0
    assert mixing.apply_mix(odd).columns == odd.columns and mixing.apply_mix(odd).count() > 0
    assert mixing.apply_mix(empty(odd)).count() == 0


@pytest.mark.parametrize("ids", ["none", "one", "copies"])
def test_mixing_meets_targets_on_ties(spark, words, ids):
    n = 90
    texts = [words(7 + i % 5, i) if ids != "copies" else words(9, 1) for i in range(n)]
    rows = [(None if ids == "none" else 4, t, "en", "ab"[i % 3 > 0], len(t), "clash", 7, 9) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    want, taken = brute_targets(dict(sizes)), collections.Counter()
    for x in mixing.mix(df).collect():
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    applied = collections.Counter()
    for x in mixing.apply_mix(df).collect():
        applied[x.source] += len(x.text.split())
    assert all(abs(applied[s] - want[s]) <= 12 for s in want)


def test_applied_mix_agrees_with_mix(spark, words):
    df = frame(spark, [words(5 + i % 60, i) for i in range(200)] + [None, "", " "]).repartition(3)
    copies = collections.Counter(r.doc_id for r in mixing.apply_mix(df).collect())
    for x in mixing.mix(df).collect():
        assert abs(copies[x.doc_id] - (x.taken / x["size"] if x["size"] else 1)) <= 0.5


# --- op 4 ----------------------------------------------------------------------------------------------------------


def brute_base(text):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_secrets(spark, odd):
    r = random.Random(2)
    bits = ["password", "=", ":", " ", "'", '"', "api_key", "APIKEY", "toKen", "AKIA", "ABCD1234", "0123456789abcdef", "é", "zz", ".", "Secret", "\n"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 60))) for _ in range(300)]
    for row in secrets.scan_secrets(frame(spark, texts)).collect():
        base = sorted(brute_base(texts[row.doc_id]), key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) - {""} <= set(row.spans.split(","))
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(b[0] == k for b in base) for k in ("assign", "access", "hex"))
    assert secrets.scan_secrets(odd).count() == odd.count() and secrets.scan_secrets(empty(odd)).count() == 0


def test_guess_cost_orders_passwords():
    cost = [secrets.guess_cost(v)[0] for v in ("password", "qwerty12", "summer2019", "aaaaaaaaaa", "19990101", "tr0ub4dor&3", "kX9#mQ2$vL7p")]
    assert max(cost[:5]) < secrets.MIN_LOG10 <= cost[6] and cost[5] > max(cost[:5])
    value = "summer2019qwerty"
    total, segments = secrets.guess_cost(value)
    assert "".join(value[a:b] for _, a, b in segments) == value and {k for k, _, _ in segments} >= {"word", "date"}


def brute_guess_cost(value):
    """Least cost over all cuts, every kind of segment looked for on its own."""
    n, parts = len(value), []
    size = lambda c: 10 * c.isdigit() + 26 * ("a" <= c <= "z") + 26 * ("A" <= c <= "Z") + 33 * (not c.isalnum())
    brute = math.log10(max(10, sum(size(c) for c in {next((k for k in ("0", "a", "A", "-") if size(k) == size(c) and k.islower() == c.islower()), c) for c in value})))
    walk = lambda a, b: all((x + y).lower() in secrets.NEXT_KEY for x, y in zip(value[a:b], value[a + 1 : b]))
    step = lambda a, b: b - a > 1 and value[a:b].isalnum() and any(all(ord(y) - ord(x) == d for x, y in zip(value[a:b], value[a + 1 : b])) for d in (1, -1))
    for a in range(n):
        for b in range(a + 1, n + 1):
            span, maximal = value[a:b], lambda holds: holds(a, b) and not (a and holds(a - 1, b)) and not (b < n and holds(a, b + 1))
            unleet = span.lower().translate(secrets.LEET)
            rank = secrets.RANK.get(unleet) or secrets._prose().get(span.lower())
            if b - a >= 3 and rank:
                parts.append((a, b, math.log10(rank + 1) + 0.7 * ((span != span.lower()) + (unleet in secrets.RANK and span.lower() != unleet))))
            m = secrets.DATE.match(value, a)
            if m and m.end() == b:
                parts.append((a, b, math.log10(365 * 120) if b - a > 4 else 2.1))
            if b - a >= 4 and maximal(walk):
                parts.append((a, b, math.log10(188 * (b - a))))
            if b - a >= 3 and maximal(step):
                parts.append((a, b, math.log10(26 * (b - a))))
            for w in range(1, n // 2 + 1 if n > 1 else 2):
                if b - a >= w and maximal(lambda x, y: y - x >= w and value[x + w : y] == value[x : y - w]) and (times := (b - a) // w) >= (3 if w == 1 else 2):
                    parts.append((a, a + times * w, math.log10(times) + (math.log10(max(1, size(value[a]))) if w == 1 else w * brute)))

    @lru_cache(maxsize=None)
    def least(at):
        if at == n:
            return 0.0
        return min([brute + least(at + 1)] + [c + 0.3 + least(b) for a, b, c in parts if a == at])

    return least(0)


def test_guess_cost_is_the_least_of_all_cuts():
    r = random.Random(12)
    bits = ["pass", "p4ss", "word", "Dragon", "abab", "xyzxyz", "1999", "0412", "qwer", "dsa", "aaa", "cba", "123", "7", "!", "zQ", "love", "l0ve", "the"]
    repeats = ["58213", "x7Kq9", "402917", "jvbqk", "90817263"]
    values = ["".join(r.choices(bits, k=r.randint(1, 3)))[:10] for _ in range(300)] + [(u * 3)[: 2 * len(u) + k] for u in repeats for k in (-1, 0, 1)]
    for value in values:
        total, segments = secrets.guess_cost(value)
        assert total == pytest.approx(brute_guess_cost(value)), value
        assert "".join(value[a:b] for _, a, b in segments) == value
        for least in (3.0, 6.0, 8.0):
            assert secrets.hard_to_guess(value, least) == (total >= least)


def test_repeats_of_long_units_are_found():
    for unit in ("x7Kq9", "jvbqkzw", "4029171"):
        total, segments = secrets.guess_cost(unit * 3)
        assert ("repeat", 0, 3 * len(unit)) in segments and total < secrets.guess_cost(unit + unit[::-1] + unit)[0]
    assert not secrets.hard_to_guess("5831358313" * 40, 12.0)


def test_long_values_are_weighed_whole():
    tail = "".join(random.Random(4).choices("abcdefghXYZ0123456789", k=30))
    assert secrets.hard_to_guess("a" * 5000 + tail, 8.0) and not secrets.hard_to_guess("a" * 200_000, 8.0) and not secrets.hard_to_guess("password" + "ab" * 50_000, 12.0)
    assert secrets.guessed_spans("password is " + "a" * 300 + tail + " ok", []) == [("password", 12, 342)]


def test_guessed_values_need_context():
    secret = "kX9" + "#mQ2$vL7p"
    assert secrets.guessed_spans(f"the password is {secret}.", []) == [("password", 16, 28)]
    assert not secrets.guessed_spans(f"the weather is {secret}.", []) and not secrets.guessed_spans("the password is password1", [])


def test_guessed_values_are_covered_whole():
    r = random.Random(6)
    long = "".join(r.choices("abcdefghXYZ0123456789", k=240))
    for text, value in ((f"the secret is {long} here", long), ("password is hxkqzvbnwtrplsd", "hxkqzvbnwtrplsd"), ("pwd: Hxkqzvbnwtrplsd", "Hxkqzvbnwtrplsd"), ("login with alice / kX9mQ2vL7p!z ok", "kX9mQ2vL7p!z")):
        assert secrets.mask(text) == text.replace(value.rstrip("!"), "[SECRET]"), text
    for word in ("required", "Important", "something", "different", "stored", "straightforward", "necessary"):
        assert not secrets.guessed_spans(f"the password is {word} for that, the secret was {word}.", []), word


def test_redaction_removes_every_secret(spark):
    text = "x api_key = abcdef123456 y 0123456789abcdef01234567 z"
    row = secrets.redact(frame(spark, [text, None, "clean"])).orderBy("doc_id").collect()
    assert row[0].text == "x [SECRET] y [SECRET] z" and row[0].n_chars == len(row[0].text) and row[1].text is None and row[2].text == "clean"


# --- op 5 ----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "<p>\r\n\r\nWARC/1.1\r\n</p>", "<p>a</p>", "é" * 500]
    rows = [(i, f"http://x/{i}", h, "clash") for i, h in enumerate(html)] + [(6, "http://x/6", "<p>a</p>", "clash"), (None, "http://x/n", "<p>b</p>", None), (9, None, "<p>only</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    for least in (0, 100):
        got = warc.archive_table(pages, least_bytes=least).collect()
        assert len(got) == len(rows)
        body = {i: (h or "").encode() for i, _, h, _ in rows}
        for r in got:
            p = body[r.page_id]
            assert r.payload_bytes == len(p) and r.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
            same = max((i for i, h in body.items() if h == p and i is not None))
            if len(p) < least:
                assert r.record_type == "response" and r.refers_to is None
            elif r.record_type == "response":
                assert r.page_id == same and r.refers_to is None and bytes(r.payload) == p
            else:
                assert r.refers_to == same and r.payload is None
        classes = collections.Counter(r.payload_digest for r in got if r.record_type == "response")
        if not least:
            assert set(classes.values()) == {1}
    assert warc.archive_table(pages.where(F.lit(False))).count() == 0


def test_warc_files(spark, tmp_path):
    r = random.Random(5)
    rows = [(i if i % 7 else None, f"http://x/{i}", "".join(r.choices("abcdefgh <>", k=2000))) for i in range(60)] + [(3, "http://x/r", "same")] * 5 + [(None, None, "same")] * 5 + [(2, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    warc.write_archives(pages, str(tmp_path / "w"), file_bytes=8000)
    files = [p.read_bytes() for p in (tmp_path / "w").glob("part-*") if p.stat().st_size]
    assert len(files) > 5 and all(len(f) <= 8000 + len(warc.EMPTY_MEMBER) for f in files)
    heads = [warc.parse(m)[0] for f in files for m in warc.members(f)]
    assert [gzip.decompress(f) for f in files] == [b"".join(warc.members(f)) for f in files]
    assert len(heads) == len({h["WARC-Record-ID"] for h in heads}) == len(rows)
    responses = {h["WARC-Record-ID"]: h for h in heads if h["WARC-Type"] == "response"}
    for h in heads:
        assert re.fullmatch(r"20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"])
        if h["WARC-Type"] == "revisit":
            assert responses[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and h["X-Refers-To-Page"] == "3"
    assert len(responses) == 61


# --- op 6 ----------------------------------------------------------------------------------------------------------


def test_quality_measures(spark, odd, words):
    r = random.Random(4)
    texts = [" ".join(r.choices("ab", k=r.randint(0, 12))) for _ in range(150)] + ["\n".join(r.choices(["x y", "z", " ", "x y "], k=8)) for _ in range(50)] + [words(120, 5), words(60, 6) + " # $ %"]
    got = {x.doc_id: x for x in quality_rules.quality_table(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        c, cover = collections.Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        x = got[i]
        want = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(cover))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (x.base_failed and x.kept)
    assert got[len(texts) - 2].kept
    assert quality_rules.quality_table(odd).count() == odd.count() and quality_rules.quality_table(empty(odd)).count() == 0


def test_cascade_order_changes_no_verdict(spark, words):
    df = frame(spark, [words(80, i) + " ###" * (i % 40) for i in range(60)])
    order = quality_rules.order_rules(df)
    assert sorted(order) == sorted(quality_rules.rules(F.lit(""), quality_rules.measures(F.lit(""))))
    kept = [df.where(quality_rules.verdict(F.col("text"), quality_rules.measures(F.col("text")), o).isNull()).count() for o in (order, order[::-1])]
    assert kept[0] == kept[1] == quality_rules.filter_quality(df).count()
    assert quality_rules.filter_quality(empty(df)).count() == 0 and quality_rules.filter_quality(df).columns == df.columns


def brute_rejects(t):
    """Whether any rule of the cascade rejects a text, in Python."""
    w = WORD.findall(t)
    n, size, lines = max(1, len(w)), max(1, len(t)), t.split("\n")
    with_word = [x for x in lines if WORD.search(x)]
    again = len(with_word) - len(set(with_word))
    letter, upper = (sum(unicodedata.category(c).startswith(k) for c in t) for k in ("L", "Lu"))
    length = sum(map(len, w))
    return any(
        (length < 2 * n or length > 14 * n, sum(c in "#*$%&|<>" for c in t) > 0.2 * n, again > 2 and again > 0.3 * len(lines), upper > 0.5 * size, letter < 0.5 * size)
        + (sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in lines) > 0.9 * len(lines), bool(re.search(r"(\S)\1{29}", t, re.ASCII)))
    )


def test_cascade_equals_rules_in_python(spark, words):
    plain = [words(60, i) for i in range(6)]
    texts = plain + [t.upper() for t in plain] + [plain[0] + "z" * k for k in (20, 40)] + ["a " * 60 + plain[1], "1234 5678 " * 30 + plain[2], "\n".join("- " + x for x in plain), "\n".join([plain[3], *["same line"] * 9])]
    texts += [plain[4] + " #" * k for k in (5, 20, 60)] + [" ".join("longlonglonglonglong" + str(i) for i in range(60)), "été " * 10 + plain[5]]
    for r in quality_rules.quality_table(frame(spark, texts)).collect():
        assert r.kept == (not r.base_failed and not brute_rejects(texts[r.doc_id])), texts[r.doc_id][:40]


# --- op 7 ----------------------------------------------------------------------------------------------------------


def brute_components(links, ids):
    label = np.array(ids, np.int64)
    while True:
        new = np.minimum(label, np.where(links, label[None], 2**63 - 1).min(1, initial=2**63 - 1))
        if (new == label).all():
            return dict(zip(ids, label.tolist()))
        label = new


def test_range_join(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(500, 16))
    x[100:200] = x[:100] + g.normal(scale=0.07, size=(100, 16))
    x[300:420] = x[299] + g.normal(scale=0.06, size=(120, 16))
    x[450:460] = x[440]
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    bad = [(600, None, ""), (601, [0.0] * 16, ""), (602, [float("nan")] + [1.0] * 15, ""), (603, [None] + [1.0] * 15, ""), (604, [], ""), (605, [1.0, 0.0], ""), (606, [2.0, 0.0], ""), (607, [float("inf")] * 16, ""), (None, rows[455][1], ""), (None, None, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, links string")
    every = range_join.range_join(df, 0.95, pivots=7, chunk=40).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in every if r.vec_id is None] == [(0, None, False)] * 2
    got = {r.vec_id: r for r in every}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    component = brute_components(links, list(range(500)))
    for i in range(500):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i].sum(), component[i], component[i] == i)
    assert got[605].n_links == got[606].n_links == 1 and got[606].component_id == 605
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (600, 601, 602, 603, 604, 607))
    assert range_join.range_join(empty(df)).count() == 0


def test_range_join_on_random_graphs(spark):
    g = np.random.default_rng(4)
    centres = g.normal(size=(12, 24))
    x = np.concatenate([c + g.normal(scale=0.24, size=(30, 24)) for c in centres])  # pairs near 0.95: groups that aren't cliques
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    ids = g.permutation(len(x)).tolist()
    component = brute_components(links[np.argsort(ids)][:, np.argsort(ids)], list(range(len(x))))
    assert len(set(component.values() if isinstance(component, dict) else component)) > 20
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    for pivots, chunk in ((1, 4096), (64, 25)):
        for r in range_join.range_join(df, 0.95, pivots=pivots, chunk=chunk).collect():
            assert (r.n_links, r.component_id) == (links[ids.index(r.vec_id)].sum(), component[r.vec_id])


def test_range_join_spans_chains(spark):
    ids = list(range(300))
    random.Random(8).shuffle(ids)
    turn = np.radians(np.arange(300) * 0.3)  # the chain links over 60 steps, its ends don't
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in zip(ids, turn)]
    small = [(1000 + i, [0.0, 0.0, float(np.cos(a)), float(np.sin(a))]) for i, a in zip((1, 3, 4, 2), np.radians([0, 18, 36, 54]))]
    got = range_join.range_join(spark.createDataFrame(rows + small, "vec_id long, embedding array<float>"), 0.95, pivots=1).collect()
    assert {r.vec_id: r.component_id for r in got} == {i: 0 for i in ids} | {i: 1001 for i, _ in small}
    assert sorted(r.vec_id for r in got if r.kept) == [0, 1001]


# --- op 9 ----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash(spark, words, odd):
    base = [words(120, i) for i in range(60)]
    near = [t.replace(" ", "  ", 3) + " tail" for t in base[:20]] + [base[0].upper()] * 4
    texts = base + near + [None, "", "solo", "Solo"]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in simhash.simhash_components(df).collect()}
    fps = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    assert all(got[i].fp & (2**64 - 1) == int(f) for i, f in enumerate(fps))
    links = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    want = brute_components(links, list(range(len(texts))))
    assert {i: r.component_id for i, r in got.items()} == want
    assert simhash.keep_one(odd).where("doc_id is null").count() == 1 and simhash.simhash_components(empty(odd)).count() == 0


def test_keep_one_of_near_duplicates(spark, words):
    r = random.Random(9)
    texts, group = [], []
    for i in range(40):
        t = words(200, 100 + i).split()
        for c in range(r.randint(1, 4)):
            w = list(t)
            for _ in range(c):
                w[r.randrange(200)] = "changed"
            texts.append(" ".join(w))
            group.append(i)
    texts += [words(8, 1), words(8, 2), None, "", texts[0].upper()]
    df = frame(spark, texts)
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    similar = np.array([[len(a & b) >= 0.8 * len(a | b) for b in shingles] for a in shingles])
    want = brute_components(similar, list(range(len(texts))))
    kept = simhash.keep_one(df)
    assert {x.doc_id for x in kept.collect()} == set(want.values()) and kept.columns == df.columns


def check_kept(spark, texts):
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    similar = np.array([[len(a & b) >= 0.8 * len(a | b) for b in shingles] for a in shingles])
    want = set(brute_components(similar, list(range(len(texts)))).values())
    assert {x.doc_id for x in simhash.keep_one(frame(spark, texts)).collect()} == want
    return len(want)


def test_near_copies_among_forms(spark, words):
    r = random.Random(12)
    form, texts = words(300, 50).split(), []
    for i in range(60):  # forms with own fields are below 0.8 among themselves
        w = list(form)
        for k in range(10):
            w[r.randrange(30 * k, 30 * k + 30)] = f"field{i}x{k}"
        texts.append(" ".join(w))
    for i in range(20):
        w = texts[i].split()
        for _ in range(4):
            w[r.randrange(300)] = "changed"
        texts.append(" ".join(w))
    chain = words(300, 51).split()
    for i in range(20):
        chain[r.randrange(300)], chain[r.randrange(300)] = f"new{i}", f"more{i}"
        texts.append(" ".join(chain))
    r.shuffle(texts)
    assert 41 <= check_kept(spark, texts) <= 65


def test_near_copies_of_every_kind_of_edit(spark, words):
    texts = []
    for i in range(15):
        w, other = words(300, 200 + i).split(), words(300, 300 + i).split()
        texts += [" ".join(x) for x in (w, w + other[:60], w[:250], w[:100] + other[:20] + w[120:], w + "one two three".split() * 60)]
        long = words(900, 400 + i).split()  # near the threshold, where a sample of the shingles errs
        for n in (34, 36, 38, 40, 42):
            e = list(long)
            for k in range(n):
                e[20 * k + i] = f"e{n}"
            texts.append(" ".join(e))
    check_kept(spark, texts)


def test_parity_maps_never_rule_out_a_similar_pair():
    g = np.random.default_rng(2)
    for n in (20, 150, 900, 4000):
        base = g.integers(0, 2**63, n, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[g.random(n) < keep], g.integers(0, 2**63, int(n * (1 - keep)), dtype=np.uint64)])) for keep in (1, 0.97, 0.9, 0.8, 0.5, 0.1)]
        maps, size = np.array([simhash.parity_map(h) for h in sets]).T, np.array([len(h) for h in sets])
        a, b = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
        apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
        assert (simhash._differences(maps, a, b) <= apart).all()
        alike = np.array([simhash.similarity(sets[i].tobytes(), sets[j].tobytes()) >= 0.8 for i, j in zip(a, b)])
        assert (apart[alike] <= simhash._allowed(size[a], size[b], 0.8)[alike]).all()


def test_many_variants_of_one_text_make_few_pairs(spark, words):
    r, base = random.Random(7), words(140, 5).split()
    texts = []
    for i in range(160):
        w = list(base)
        for at in r.sample(range(140), r.choice([1, 2, 3, 6, 9])):
            w[at] = f"own{i}x{at}"
        texts.append(" ".join(w))
    check_kept(spark, texts + [words(90, 100 + i) for i in range(20)])


def test_wide_maps_never_rule_out_a_similar_pair():
    g = np.random.default_rng(4)
    for n in (1, 20, 150, 900, 4000):
        base = g.integers(0, 2**63, n, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[: max(1, int(n * keep))], g.integers(0, 2**63, int(n * more), dtype=np.uint64)])) for keep in (1, 0.9, 0.8, 0.7, 0.3) for more in (0, 0.1, 0.6)]
        for x in sets:
            for y in sets:
                apart = len(np.setxor1d(x, y))
                assert simhash.wide_differences(simhash.wide_map(x), simhash.wide_map(y)) <= apart
        far = [simhash.wide_differences(simhash.wide_map(x), simhash.wide_map(y)) > simhash._allowed(len(x), len(y), 0.8) for x in sets for y in sets if simhash.similarity(x.tobytes(), y.tobytes()) < 0.7]
        assert n < 100 or np.mean(far) > 0.9


def test_few_sets_are_shuffled_and_few_passes_made(spark, words, monkeypatch):
    from gumshoe.llm import common

    r, form, texts, tables = random.Random(14), words(300, 60).split(), [], []
    for i in range(60):  # forms that share about half of their shingles
        w = list(form)
        for k in range(10):
            w[30 * k + r.randrange(30)] = f"field{i}x{k}"
        texts.append(" ".join(w))
    chain = words(300, 61).split()
    for i in range(40):
        chain[r.randrange(300)], chain[r.randrange(300)] = f"new{i}", f"more{i}"
        texts.append(" ".join(chain))
    r.shuffle(texts)
    write = common.materialize

    def noted(df, tag):
        out = write(df, tag)
        tables.append((tag, out))
        return out

    monkeypatch.setattr(common, "materialize", noted)
    monkeypatch.setattr(simhash, "materialize", noted)
    monkeypatch.setattr(simhash, "discard", lambda df: None)
    check_kept(spark, texts)
    assert sum(df.count() for tag, df in tables if tag.startswith("near-sets")) <= 60
    assert sum(tag == "cc" for tag, _ in tables) <= 4


def test_contracted_edges_span_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 40)
    g = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in g.integers(0, 300, (200, 2))] + [(i + 1, i) for i in range(1000, 1060)]
    df = spark.createDataFrame(edges, "src long, dst long")
    fewer = simhash.contracted(df)
    want, got = ({r.node: r.component for r in connected_components(x).collect()} for x in (df, fewer))
    assert got == want and fewer.count() < df.count() and simhash.contracted(empty(df)).count() == 0


def test_similarity_counts_whole_sets():
    g = np.random.default_rng(3)
    for least in (799, 801):
        h = np.unique(g.integers(0, 2**63, 2000, dtype=np.uint64))[:1000]
        part = np.sort(g.permutation(h)[:least])
        assert simhash.similarity(h.tobytes(), part.tobytes()) == least / 1000


@pytest.mark.parametrize("chunk", [1024, 50])
def test_hot_buckets_lose_no_link(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "LEAST_CHUNK", chunk)
    g = np.random.default_rng(5)
    flips = lambda n: np.bitwise_or.reduce(np.uint64(1) << g.integers(0, 64, (n, 3), dtype=np.uint64), axis=1)
    fps = np.unique(np.concatenate([np.uint64(12345) ^ flips(400), g.integers(0, 2**63, 300, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    edges = connected_components(simhash.link(df)).collect()
    got = {r.node: r.component for r in edges}
    want = brute_components(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4, fps.view(np.int64).tolist())
    assert {i: got.get(i, i) for i in want} == want


def test_gray_index_finds_all_pairs():
    g = np.random.default_rng(6)
    x = np.unique(g.integers(0, 2**63, 700, dtype=np.uint64) & np.uint64(0xFF00FF00FF00FF00))
    index = simhash.GrayIndex(x)
    found = {(int(index.fps[a]), int(index.fps[b])) for q, m in index.probe(index.fps, 4) for a, b in zip(q, m)}
    want = {(int(a), int(b)) for a in x for b in x[np.bitwise_count(x ^ a) <= 4]}
    assert found == want


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3), (301, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}


# --- op 1, 8 -------------------------------------------------------------------------------------------------------


def kernel(a, b):
    """Direct subsequence kernel of three letters within a span."""
    classes = toxicity.letter_classes()

    def phi(s):
        c, out = [int(classes[min(ord(x), 65535)]) for x in s], collections.Counter()
        for i in range(len(c)):
            for j in range(i + 1, min(len(c), i + toxicity.SPAN)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    if c[i] and c[j] and c[k]:
                        out[c[i], c[j], c[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q[u] for u, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0.0


def test_string_kernel_table_equals_direct_kernel():
    strings = ["banana", "b.a.n.a", "bandana", "zzz", "l0ser", "loser", "lo-ser"]
    for s in strings:
        x, columns = toxicity._matrix([s])
        table = np.zeros(toxicity.LETTERS**3, np.float32)
        table[columns] = x[0]
        got = toxicity.KernelModel(table, 0.0).margins(strings)
        assert got == pytest.approx([kernel(s, t) for t in strings], abs=1e-5)  # a margin without bias is the kernel
    assert kernel("loser", "l0ser") == pytest.approx(1) and kernel("loser", "lo-ser") > 0.5 > kernel("loser", "banana")


def test_whole_text_margins_equal_direct_kernels(words):
    strings = ["loser", "idiotic"]
    x, columns = toxicity._matrix(strings)
    table = np.zeros(toxicity.LETTERS**3, np.float32)
    table[columns] = x.sum(0)
    r = random.Random(3)
    texts = [words(20, i) + r.choice([" lo-ser", " l o s e r now", " idi*otic", " " + "qz" * 20 + "loser" + "zq" * 20, ""]) for i in range(40)] + ["", "x", None]
    for bias in (-1.5, -0.6):
        model = toxicity.KernelModel(table, bias)
        got = toxicity.text_margins(model, pa.array(texts, pa.string()))
        for t, m in zip(texts, got):
            cut = [w[a : a + toxicity.WIDTH] for w in toxicity.ended([toxicity.bare(x) for x in (t or "").split()]) for a in range(0, max(1, len(w) - toxicity.WIDTH + toxicity.STEP), toxicity.STEP)]
            every = [max(bias, -1.0)] + [kernel(w, strings[0]) + kernel(w, strings[1]) + bias for w in [*cut, *toxicity.ended(toxicity.spaced_runs(t or ""))]]
            assert m == pytest.approx(max(every), abs=1e-5), t


def test_toxicity_without_words_to_learn_from(spark, words):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    for clean, toxic in (("", "vexlor"), (None, "vexlor"), ("", None), ("vexlor", "vexlor"), ("!!", "??")):
        df = frame(spark, [toxic if i % 2 else clean for i in range(40)])
        got = toxicity.score(df, toxicity.fit(df, labels)).collect()
        assert len(got) == 40 and all(0 <= r.score <= 1 for r in got)
    odd_labels = spark.createDataFrame([(i, 1, 5 * (i % 2)) for i in range(40)], "doc_id long, quality int, toxic int")
    df = frame(spark, [words(9, i) + " vexlor" * (i % 2) for i in range(40)])
    assert toxicity.score(df, toxicity.fit(df, odd_labels)).count() == 40


def test_toxicity_learns_stems_and_gaps(spark, words):
    r = random.Random(8)
    bad = ["vexlor", "grumtok", "snivvle"]
    texts, labels = [], []
    for i in range(500):
        w = words(30, i).split()
        if i % 4 == 0:
            w[r.randrange(30)] = r.choice(bad) + r.choice(["", "s", "ish", "."])
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 4 == 0)))
    probe = ["the vex-lor came", "a grum.tok here", "so v e x l o r then", "nothing to see", "", None]
    df = frame(spark, texts + probe)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert min(got[500 + k] for k in range(3)) > max(got[500 + k] for k in range(3, 6)) and len(got) == 506
    one_class = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(df, toxicity.fit(df, one_class)).count() == 506 and toxicity.score(empty(df), model).count() == 0


def test_rule_ensemble(spark, words, odd):
    texts = [words(60, i) if i % 3 else (words(60, i).upper() + " !!" if i % 2 else "spam ham " * 40) for i in range(400)]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    model = rule_ensemble.fit(df, labels)
    assert 0 < len(model.rules) and set(model.used) <= set(model.names)
    # The compiled columns equal the rules applied in Python to the same statistics.
    for r in df.select("doc_id", rule_ensemble.stats_struct(F.col("text")).alias("s")).join(rule_ensemble.score(df, model), "doc_id").collect():
        fires = lambda tests: all((r.s[n] <= at) if op == "<=" else (r.s[n] > at) for n, op, at in tests)
        margin = model.bias + sum(w for tests, w in model.rules if fires(tests))
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-12)
    got = {r.doc_id: r.score for r in rule_ensemble.score(df, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.7) == (i % 3 > 0) for i in held) / len(held) > 0.97
    odd_scores = rule_ensemble.score(odd, model).collect()
    assert len(odd_scores) == odd.count() and all(0 <= r.score <= 1 for r in odd_scores)
    assert rule_ensemble.score(empty(odd), model).count() == 0
    one = rule_ensemble.fit(df, labels.where("quality = 1"))
    assert one.rules == () and rule_ensemble.filter_quality(odd, one).count() == odd.count()
    kept = rule_ensemble.filter_quality(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.score >= 0.5 for r in odd_scores)
    assert rule_ensemble.filter_quality(empty(odd), model).count() == 0
