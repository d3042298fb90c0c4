"""Spelling variants: words one edit apart, by banded dynamic programming over sorted lists.

Words are counted in one pass; a task sums its words before the shuffle.  For the
search the vocabulary is sorted, once by word and once by reversed word: an edit
leaves the first or the last half of two words alike, so each near pair shares a
half at the start of one of the lists.  Each list is cut into ranges of neighbours,
and a word is sent only to ranges that can hold words sharing its half; the second
list leaves out pairs that the first one finds.

In a task the range is scanned in order for all words sent to it.  Of the edit
matrices only a band of three cells a row can hold values up to one.  The rows of a
prefix are kept on a stack, so a word starts at its longest common prefix with the
one before it; queries whose band exceeds one edit leave the stack, and where none
is left, all words sharing that prefix are skipped.

Words sent to one range are dealt over as many tasks as their number asks for, so a
frequent prefix needs no single task.  A word's form always occurs at least
``FACTOR`` times as often, so forms make no cycles and are followed in a few rounds.

Runs are ``[A-Za-z\\u00C0-\\u00FF]+``, with only A to Z put in lower case.  Null and
empty texts hold none; a null id counts as the text ``null``; repeated rows count
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from os.path import commonprefix
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.llm.common import discard, materialize, small

LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
#: One run in so many loses a code point.
MANGLED = 199
#: Words of a range, ranges at most, and words that one task looks up in a range.
RANGE = 4096
MOST_RANGES = 1 << 16
LOOKED_UP = 1 << 14
#: Distinct words that a task holds before it passes their counts on.
HELD = 400_000
#: Up to so many queries a prefix are carried as tuples, more as arrays.
FEW = 12

#: Latin-1 bytes are code points here: letters stay, A to Z in lower case, all else parts runs.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Runs of letters of a text, one byte a code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split(b" ") if text else []


def mangled(run: bytes, seed: int) -> bytes:
    """``run``, less one code point if its hash with the document's id says so; ``seed`` is the crc32 of ``<id>:``."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    return run if h % MANGLED else run[: (at := h % len(run))] + run[at + 1 :]


def _count(batches):
    total: Counter = Counter()

    def out():
        words = [w.decode("latin-1") for w in total]
        return pa.record_batch({"word": pa.array(words, pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    for batch in batches:
        for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
            seed = crc32(f"{key}:".encode())
            for run, n in Counter(runs(text)).items():
                if run and len(word := mangled(run, seed)) >= LEAST_LENGTH:
                    total[word] += n
        if len(total) >= HELD:
            yield out()
            total.clear()
    if total:
        yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of words of enough code points and occurrences."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def half(length: int) -> int:
    """Code points at one end, at least, that a word of ``length`` shares with each word one edit apart."""
    return max(LEAST_LENGTH // 2, (length - 1) // 2)


class _Band:
    """Rows of the banded edit matrices of many queries against one growing prefix."""

    def __init__(self, queries: list[str]):
        self.padded = [f"\0{q}\0\0" for q in queries]
        self.size = np.array([len(q) for q in queries], np.int64)
        self.start = np.cumsum(self.size + 3) - (self.size + 3)
        self.flat = np.frombuffer("".join(self.padded).encode("utf-32-le"), np.uint32)
        k = len(queries)
        self.first = (np.arange(k), np.full(k, 2, np.int8), np.zeros(k, np.int8), np.ones(k, np.int8))

    def _wide(self, row, depth: int, c: str):
        k, p0, p1, p2 = row
        near = self.size[k] + 1 >= depth
        if not near.all():
            k, p0, p1, p2 = k[near], p0[near], p1[near], p2[near]
        at = self.start[k] + depth
        code = ord(c)
        n0 = np.minimum(p0 + (self.flat[at - 1] != code), p1 + 1)
        n1 = np.minimum(np.minimum(p1 + (self.flat[at] != code), p2 + 1), n0 + 1)
        n2 = np.minimum(p2 + (self.flat[at + 1] != code), n1 + 1)
        live = (n0 < 2) | (n1 < 2) | (n2 < 2)
        return k[live], n0[live], n1[live], n2[live]

    def _few(self, row: list, depth: int, c: str) -> list:
        out = []
        for k, p0, p1, p2 in row:
            q = self.padded[k]
            if depth + 1 < len(q):
                n0 = min(p0 + (q[depth - 1] != c), p1 + 1)
                n1 = min(p1 + (q[depth] != c), p2 + 1, n0 + 1)
                n2 = min(p2 + (q[depth + 1] != c), n1 + 1)
                if n0 < 2 or n1 < 2 or n2 < 2:
                    out.append((k, n0, n1, n2))
        return out

    def step(self, row, depth: int, c: str):
        """The rows below ``row`` for the prefix longer by ``c``."""
        if isinstance(row, tuple):
            row = self._wide(row, depth, c)
            return row if len(row[0]) > FEW else list(zip(*(x.tolist() for x in row)))
        return self._few(row, depth, c)

    def one_off(self, row, depth: int) -> list[int]:
        """Queries exactly one edit from the whole prefix."""
        if isinstance(row, tuple):
            k, *cells = row
            at = self.size[k] - depth + 1
            return k[np.choose(np.clip(at, 0, 2), cells) * ((at >= 0) & (at <= 2)) == 1].tolist()
        return [k for k, *cells in row if 0 <= (at := len(self.padded[k]) - 2 - depth) <= 2 and cells[at] == 1]


def near_pairs(entries: list[str], queries: list[str]):
    """(query, entry) positions of words exactly one edit apart; ``entries`` are sorted and distinct."""
    band, at, before = _Band(queries), 0, ""
    rows = [band.first]
    while at < len(entries):
        word = entries[at]
        del rows[len(commonprefix((before, word))) + 1 :]
        before, at = word, at + 1
        for depth in range(len(rows), len(word) + 1):
            row = band.step(rows[-1], depth, word[depth - 1])
            rows.append(row)
            if not len(row[0] if isinstance(row, tuple) else row):
                at = bisect_left(entries, word[: depth - 1] + chr(ord(word[depth - 1]) + 1), at)
                break
        else:
            for k in band.one_off(rows[-1], len(word)):
                yield k, at - 1


def _look_up(table: pa.Table) -> pa.Table:
    """In one range: each query's near words counted, and the best of them."""
    side = table["side"][0].as_py()
    rows = sorted(zip(table["asked"].to_pylist(), table["key"].to_pylist(), table["n"].to_pylist()))
    queries = [key for asked, key, _ in rows if asked]
    entries = [(key, n) for asked, key, n in rows if not asked]
    plain = (lambda w: w[::-1]) if side else (lambda w: w)
    found: dict[int, tuple[int, tuple[int, str]]] = {}
    for k, e in near_pairs([key for key, _ in entries], queries):
        (a, b), n = (queries[k], entries[e][0]), entries[e][1]
        h = half(len(a))
        if a[:h] == b[:h] and not (side and a[-h:] == b[-h:]):
            mine, best = found.get(k, (0, (1, "")))
            found[k] = mine + 1, min(best, (-n, plain(b)))
    words = [plain(queries[k]) for k in found]
    return pa.table({"word": pa.array(words, pa.string()), "n_near": pa.array([x[0] for x in found.values()], pa.int64()), "off": pa.array([x[1][0] for x in found.values()], pa.int64()), "near": pa.array([x[1][1] for x in found.values()], pa.string())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of words (word, n) that have near ones: their number and the most frequent of them, ties to the smallest."""
    total = words.count()
    ranges = max(1, min(MOST_RANGES, -(-2 * total // RANGE)))
    both = words.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("key")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("key")))).alias("k"), "n").select("k.side", "k.key", "n")
    lists = materialize(both.repartitionByRange(ranges, "side", "key").withColumn("part", F.spark_partition_id()), "spelling-ranges")
    ends = lists.groupBy("side", "part").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("side", "low")
    bounds: list[tuple[list, ...]] = [([], [], []), ([], [], [])]
    for side, part, low, high in ends.collect():  # at most MOST_RANGES rows and one more
        for held, x in zip(bounds[side], (low, high, part)):
            held.append(x)

    def route(batches):
        for batch in batches:
            out = []
            for side, key, n in zip(*(batch[c].to_pylist() for c in ("side", "key", "n"))):
                low, high, part = bounds[side]
                start = key[: half(len(key))]
                # Of the ranges, in order, those from the first that ends at the half or later to the last that begins with it or before.
                for p in range(bisect_left(high, start), bisect_right(low, start, key=lambda w: w[: len(start)])):
                    out.append((side, part[p], key, n))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["side", "part", "key", "n"]) if out else pa.record_batch({"side": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "key": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

    asked = materialize(lists.select("side", "key", "n").mapInArrow(route, "side int, part int, key string, n long"), "spelling-asked")
    tasks = small(asked.groupBy("side", "part").agg(F.ceil(F.count("*") / LOOKED_UP).cast("int").alias("tasks")))
    dealt = asked.join(tasks, ["side", "part"]).select("side", "part", F.pmod(F.xxhash64("key"), "tasks").cast("int").alias("task"), F.lit(True).alias("asked"), "key", "n")
    held = lists.join(tasks, ["side", "part"]).select("side", "part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(False).alias("asked"), "key", "n")
    # Ranges are few bytes and much work, so their tasks aren't to be merged by size.
    met = dealt.unionByName(held).repartition(min(4 * ranges, 8192), "side", "part", "task")
    found = met.groupBy("side", "part", "task").applyInArrow(_look_up, "word string, n_near long, off long, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("off", "near")).alias("b"))
    return best.select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.off")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form reached from each word that has one; (word, form) holds no cycle. Steps double each round."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        then = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(state.join(then, "root", "left").select("word", "root", "next"), "spelling-roots")
        discard(state)
        state = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.where("next is not null").isEmpty():
            return state


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of enough code points and occurrences."""
    words = materialize(vocabulary(docs, id_col, text), "spelling-words")
    near = near_words(words)
    rows = words.join(near, "word", "left")
    formed = F.col("near_n") >= FACTOR * F.col("n")
    rows = rows.select("word", F.when(formed, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near_n")).alias("form_n"))
    rows = materialize(rows, "spelling-forms")
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
