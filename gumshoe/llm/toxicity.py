"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares strings by their common subsequences of three letters whose
span is at most ``SPAN`` characters, each weighed ``DECAY ** span``, so an insult
still matches with characters inserted, dropped or set apart.  The two ends of a word
count as letters, and accented letters are letters of their own.  Strings are the
words of a text, plus runs of single characters joined up (``l o s e r``); a
text is the bag of its strings, its sentences' labels being the text's, and its
margin is that of its most toxic string (multiple-instance SVM: each toxic
text's witness string is chosen anew after every fit).

Fitting is bounded by ``TRAIN_ROWS`` labelled texts: Spark counts in how many
toxic and clean ones each word occurs, a greedy cover picks the fewest words
that explain the toxic ones, and the driver fits ``LANDMARKS`` weights.  Since
the kernel is a dot product over subsequences, landmarks and weights fold into
one table of 64^3 subsequence weights; that table (1 MB) is all that scoring
ships, and a word costs table look-ups instead of a dynamic program a landmark.

Bounds of fitting: about ``TRAIN_ROWS`` texts, of whose distinct strings
``CANDIDATES`` toxic and ``NEGATIVES`` clean ones (and the commonest clean ones) are
weighed; in each round every clean text's string that is taken for toxic joins in.
Scoring has no bounds.

Null and empty texts have the least margin; long words are fitted and scored in
overlapping windows, so no part of a text is skipped; repeated rows score alike;
an empty table gives no rows; extra columns are ignored; with one class only, or
without a clean or a toxic word to learn from, every text gets the share of label 1;
labels other than 0 count as 1.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.llm.common import materialize, small
from gumshoe.llm.labels import training_ids

TRAIN_ROWS = 16_000
LANDMARKS = 320
DECAY, SPAN, LETTERS, WIDTH, STEP = 0.7, 5, 64, 26, 18
START, END = "\x02", "\x03"
#: Marks that are no part of a word at its ends.
MARKS = ".,;:!?\"'()[]{}<>|#*%&"
PAIRS = [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]
FLOOR = -1.0
CANDIDATES, NEGATIVES, REG = 3000, 5000, 1e-4
#: Standard deviations above chance at which a word of toxic texts is kept in every round, and rounds.
SURE, ROUNDS = 6.0, 5
#: Words, and words whose norm is needed, held as arrays at once.
WORDS_AT_ONCE, EXACT_AT_ONCE = 16_384, 2048
TEXTS_AT_ONCE = 1024
# Characters that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_SPACED = r"(?:^|\s)[^\s](?:\s[^\s]){3,}(?:\s|$)"
_RUN = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")


@cache
def letter_classes() -> np.ndarray:
    """Class of each code point below 65536: 0 is a gap, 1-26 plain letters, above that accented and other letters, last the two ends of a word."""
    out = np.zeros(65536, np.uint8)
    for cp in range(33, 65536):
        ch = LOOKALIKES.get(chr(cp), chr(cp)).lower()[:1]
        plain = unicodedata.normalize("NFKC", ch)[:1]  # wide and mathematical letters are letters, accents stay
        if "a" <= plain <= "z":
            out[cp] = ord(plain) - 96
        elif plain.isalpha():
            out[cp] = 27 + ord(plain) % (LETTERS - 29)
    out[ord(START)], out[ord(END)] = LETTERS - 2, LETTERS - 1
    return out


def ended(words: list[str]) -> list[str]:
    """Words between their end marks, which are letters to the kernel, so a word's first and last letters count as such."""
    return [f"{START}{w}{END}" for w in words]


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes [n, WIDTH], word of each row): words longer than WIDTH give overlapping rows."""
    long = [n for n, w in enumerate(words) if len(w) > WIDTH]
    owner = np.arange(len(words))
    cut = words
    if long:
        extra = [(words[n][a : a + WIDTH], n) for n in long for a in range(STEP, len(words[n]) - WIDTH + STEP, STEP)]
        cut = words + [w for w, _ in extra]
        owner = np.concatenate([owner, np.array([n for _, n in extra], np.int64)])
    points = np.array(cut, dtype=f"<U{WIDTH}").view("<u4").reshape(len(cut), WIDTH)
    classes = letter_classes()[np.minimum(points, 65535)]
    return classes, owner


def triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(subsequence code, valid, weight) of each start and each pair of later places."""
    c = codes.astype(np.int32)
    for j, k in PAIRS:
        a, b, d = c[:, : c.shape[1] - k], c[:, j : c.shape[1] - k + j], c[:, k:]
        yield (a * LETTERS + b) * LETTERS + d, (a > 0) & (b > 0) & (d > 0), DECAY ** (k + 1)


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: subsequence codes and their summed weights, equal codes merged; code 0 pads."""
    got = [(np.where(v, u, 0), np.where(v, w, 0.0)) for u, v, w in triples(codes)]
    u, w = np.concatenate([x for x, _ in got], 1), np.concatenate([x for _, x in got], 1)
    order = np.argsort(u, 1, kind="stable")
    u, w = np.take_along_axis(u, order, 1), np.take_along_axis(w, order, 1)
    head = np.ones(u.shape, bool)
    head[:, 1:] = u[:, 1:] != u[:, :-1]
    group = np.cumsum(head, 1) - 1 + np.arange(len(u))[:, None] * u.shape[1]
    total = np.bincount(group.ravel(), w.ravel(), u.size).reshape(u.shape)
    first = np.zeros(u.size, u.dtype)
    first[group[head]] = u[head]
    first = first.reshape(u.shape)
    return first, np.where(first > 0, total, 0.0)


@dataclass(frozen=True)
class KernelModel:
    """Weights of all subsequences, bias, and the slope and offset that turn a margin to a probability."""

    table: np.ndarray
    bias: float
    slope: float = 2.0
    offset: float = 0.0

    @property
    def floor(self) -> float:
        """Least margin that is told apart: a string that resembles clean ones more than toxic ones has this or less."""
        return max(FLOOR, self.bias)

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word, with its end marks if they are to count, at least ``floor``."""
        out = np.full(len(words), self.floor)
        if not words:
            return out
        by_size = np.fromiter(map(len, words), np.int64, len(words)) > 14
        for pick, width in ((~by_size, 14), (by_size, WIDTH)):
            at = np.flatnonzero(pick)
            for s in range(0, len(at), WORDS_AT_ONCE):
                some = at[s : s + WORDS_AT_ONCE]
                codes, owner = windows([words[i] for i in some.tolist()])
                codes = codes[:, :width]
                dot, own = np.zeros(len(codes)), np.zeros(len(codes))
                for u, v, w in triples(codes):
                    dot += w * np.where(v, self.table[u], 0).sum(1)
                    own += w * w * v.sum(1)
                # ``own`` is at most the squared norm, so this bounds a margin above the bias from above; others are at the floor.
                hope = np.flatnonzero((own > 0) & (dot / np.sqrt(np.maximum(own, 1e-12)) + self.bias > self.floor) & (dot > 0))
                for h in range(0, len(hope), EXACT_AT_ONCE):
                    near = hope[h : h + EXACT_AT_ONCE]
                    _, w = features(codes[near])
                    exact = dot[near] / np.sqrt((w * w).sum(1)) + self.bias
                    np.maximum.at(out, some[owner[near]], exact)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margin + self.offset)))


def spaced_runs(text: str) -> list[str]:
    return ["".join(m[0].split()) for m in _RUN.finditer(text)]


def bare(word: str) -> str:
    """A word without marks at its ends, nor three or more dollars at its end."""
    word = word.strip(MARKS)
    return word.rstrip("$").rstrip(MARKS) if word.endswith("$$$") else word


def text_margins(model: KernelModel, texts: pa.Array) -> np.ndarray:
    """Margin of each text: that of its most toxic string."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    cut = pc.utf8_split_whitespace(texts)
    starts = np.asarray(cut.offsets).astype(np.int64)
    coded = cut.flatten().dictionary_encode()
    index = np.asarray(coded.indices)
    m = model.margins(ended([bare(w) for w in coded.dictionary.to_pylist()]))[index] if len(index) else np.zeros(0)
    out = np.maximum.reduceat(np.append(m, model.floor), np.minimum(starts[:-1], len(m))) if len(texts) else np.zeros(0)
    out[starts[1:] == starts[:-1]] = model.floor
    for k in np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _SPACED))):
        runs = spaced_runs(texts[int(k)].as_py())
        if runs:
            out[k] = max(out[k], model.margins(ended(runs)).max())
    return out


def score(docs: DataFrame, model: KernelModel | float, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every row; a number as model is the score of every row."""
    if not isinstance(model, KernelModel):
        return docs.select(id_col, F.lit(float(model)).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of 64^3 weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS_AT_ONCE):
                part = b.slice(at, TEXTS_AT_ONCE)
                p = shared.value.probability(text_margins(shared.value, part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


# --- fitting -------------------------------------------------------------------------------------------------------


def _strings(text: str | None) -> list[str]:
    """Distinct strings of a text between end marks; one longer than WIDTH counts as its overlapping windows."""
    t = (text or "").lower()
    words = ended(sorted({bare(w) for w in [*t.split(), *spaced_runs(t)]} - {""}))
    return sorted({w[a : a + WIDTH] for w in words for a in range(0, max(1, len(w) - WIDTH + STEP), STEP)})


def _matrix(words: list[str], columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised feature rows of words over ``columns`` (all their own if None), as float32."""
    u, w = features(windows(words)[0][: len(words)])  # strings of at most WIDTH letters: a row each
    norm = np.sqrt((w * w).sum(1))
    if columns is None:
        columns = np.unique(u[w > 0])
    at = np.searchsorted(columns, u)
    hit = (w > 0) & (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == u)
    out = np.zeros((len(words), len(columns)), np.float32)
    row = np.broadcast_to(np.arange(len(words))[:, None], u.shape)
    out[row[hit], at[hit]] = (w / np.maximum(norm, 1e-12)[:, None])[hit]
    return out, columns


def _landmarks(words: list[str], most: int) -> list[str]:
    """Farthest-first words in the kernel."""
    x, _ = _matrix(words)
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(most, len(words)):
        k = int(near.argmin())
        if near[k] > 0.95:
            break
        chosen.append(k)
        near = np.maximum(near, x @ x[k])
    return [words[k] for k in chosen]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-3) -> np.ndarray:
    """Linear SVM with squared hinge loss, by Newton steps on the active rows."""
    z = np.hstack([z, np.ones((len(z), 1))])
    theta, ridge = np.zeros(z.shape[1]), reg * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-8
    weight = weight / weight.sum()
    for _ in range(40):
        active = y * (z @ theta) < 1
        a, wa = z[active], weight[active]
        new = np.linalg.solve((a.T * wa) @ a + ridge, (a.T * wa) @ y[active])
        if np.abs(new - theta).max() < 1e-7:
            break
        theta = new
    return theta


def fit_words(positive: dict[str, float], easy: list[str], hard: dict[str, float]) -> KernelModel:
    """Nyström SVM on positive words, any negative ones and those taken for positive before, folded into one table.

    Words weigh by the texts they stand for; the hard ones, together, three times as much as the easy ones.
    """
    plus = sorted(positive, key=lambda w: (-positive[w], w))
    worst = sorted(hard, key=lambda w: (-hard[w], w))
    minus = worst + [w for w in easy if w not in hard]
    marks = _landmarks(plus, LANDMARKS // 2) + _landmarks(minus[len(worst) :] or minus, LANDMARKS // 4)
    marks = list(dict.fromkeys([*worst[: LANDMARKS // 4], *marks]))
    l, columns = _matrix(marks)
    l = l.astype(np.float64)
    values, vectors = np.linalg.eigh(l @ l.T + 1e-6 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-9)) @ vectors.T
    x, _ = _matrix(plus + minus, columns)
    z = (x @ l.T.astype(np.float32)).astype(np.float64) @ root
    y = np.array([1.0] * len(plus) + [-1.0] * len(minus))
    p, h = np.sqrt([positive[w] for w in plus]), np.array([hard[w] for w in worst])
    rest = len(minus) - len(worst)
    weight = np.concatenate([p / p.sum(), 1.5 * h / max(h.sum(), 1.0), np.full(rest, 0.5 / max(rest, 1))])
    theta = _svm(z, y, weight, REG)
    table = np.zeros(LETTERS**3, np.float32)
    table[columns] = l.T @ (root @ theta[:-1])
    return KernelModel(table, float(theta[-1]))


def _witnesses(model: KernelModel, part: pa.RecordBatch) -> pa.RecordBatch:
    """(label, most toxic string, its margin) of each bag."""
    bags = part.column(1)
    starts = np.asarray(bags.offsets).astype(np.int64)
    coded = bags.flatten().dictionary_encode()
    index = np.asarray(coded.indices)
    words = coded.dictionary.to_pylist()
    m = model.margins(words)[index] if len(index) else np.zeros(0)
    starts -= starts[0]
    best = [int(a + m[a:b].argmax()) if b > a else -1 for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
    word = [words[index[k]] if k >= 0 else "" for k in best]
    margin = [float(m[k]) if k >= 0 else model.floor for k in best]
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(word, pa.string()), pa.array(margin, pa.float64())], names=["label", "word", "margin"])


def _cover(rows: pd.DataFrame, gain: dict[str, float]) -> dict[str, float]:
    """Greedy cover: the word that explains most texts not yet explained, again and again."""
    of = {w: set(d) for w, d in rows.groupby("word")["doc_id"]}
    left, found = set(rows["doc_id"]), {}
    while left and of:
        word = max(of, key=lambda w: (len(of[w]) * gain[w], w))
        hit = of.pop(word)
        if not hit:
            break
        found[word] = float(len(hit))
        left -= hit
        of = {w: d - hit for w, d in of.items() if d - hit}
    return found


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, text: str = "text", most: int = TRAIN_ROWS) -> KernelModel | float:
    """Learn from labelled rows outside the held-out fold, about ``most`` at most."""
    ids = training_ids(labels, label, folds, held, most)
    sample = docs.select("doc_id", F.col(text).alias("_text")).join(small(ids), "doc_id").select("doc_id", "label", "_text")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS_AT_ONCE):
                part = b.slice(at, TEXTS_AT_ONCE)
                words = pa.array([_strings(t.as_py()) for t in part.column(2)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), words], names=["doc_id", "label", "words"])

    bags = materialize(sample.mapInArrow(strings, "doc_id long, label int, words array<string>"), "toxic-train")
    share = {r["label"]: r["count"] for r in bags.groupBy("label").count().collect()}
    if len(share) < 2:
        return (share.get(1, 0) + 1) / (sum(share.values()) + 2)
    ratio = share[1] / share[0]
    counts = bags.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("n1"), (F.count("*") - F.sum("label")).alias("n0"))
    counts = materialize(counts, "toxic-words")
    score = F.col("n1") / (F.col("n0") / F.lit(ratio**-1) * 20 + 1)
    best = counts.where((F.col("n1") >= 2) & (F.col("n0") * ratio * 4 < F.col("n1"))).select("word", score.alias("gain"), "n1", "n0")
    best = best.orderBy(F.desc("gain"), "word").limit(CANDIDATES).toPandas()
    clean = counts.where(F.col("n1") * 2 <= F.col("n0") * ratio * 3 + 1).where("n0 > 0")
    easy = {r[0]: None for part in (clean.orderBy(F.desc("n0"), "word").limit(NEGATIVES // 4), clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES)) for r in part.select("word").collect()}
    if best.empty:
        return share[1] / (share[0] + share[1])
    named = docs.sparkSession.createDataFrame([(w,) for w in best["word"]], "word string")
    pairs = bags.where("label = 1").select("doc_id", F.explode("words").alias("word")).join(F.broadcast(named), "word").toPandas()
    gain = {w: g / n1 for w, g, n1 in zip(best["word"], best["gain"], best["n1"])}
    # Words far more frequent in toxic texts than chance allows, then those that explain the remaining texts.
    expected = (best["n1"] + best["n0"]) * share[1] / (share[0] + share[1])
    sure = best[(best["n1"] - expected) > SURE * np.sqrt(expected)]
    positive = _cover(pairs, gain) | {w: float(n) for w, n in zip(sure["word"], sure["n1"])}
    certain, hard, model = set(sure["word"]), {}, None
    for _ in range(ROUNDS):
        hard = {w: n for w, n in hard.items() if w not in positive}
        rest = [w for w in easy if w not in positive]
        if not rest:
            return share[1] / (share[0] + share[1])
        model = fit_words(positive, rest, hard)

        def top(batches: Iterator[pa.RecordBatch], m=model) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, TEXTS_AT_ONCE):
                    yield _witnesses(m, b.slice(at, TEXTS_AT_ONCE))

        # A row per text of the bounded sample.
        witness = bags.select("label", "words").mapInArrow(top, "label int, word string, margin double").toPandas()
        taken = witness[(witness["label"] == 0) & (witness["margin"] > -0.6)]
        for w, n in Counter(taken["word"]).items():
            hard[w] = max(hard.get(w, 0.0), float(n))
        chosen = Counter(witness.loc[(witness["label"] == 1) & (witness["margin"] > -0.5), "word"])
        for w, n in chosen.items():
            positive[w] = max(positive.get(w, 0.0), float(n))
        positive = {w: n for w, n in positive.items() if w in chosen or w in certain} or positive
    slope, offset = _platt(witness["margin"].to_numpy(), witness["label"].to_numpy())
    return KernelModel(model.table, model.bias, slope, offset)


def _platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset with balanced classes and smoothed targets (Platt 1999)."""
    n1, n0 = label.sum(), (1 - label).sum()
    y = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.where(label == 1, 0.5 / n1, 0.5 / n0)
    x, theta = np.stack([margin, np.ones(len(margin))], 1), np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + 1e-4 * np.eye(2), x.T @ (w * (y - p)) - 1e-4 * theta)
        theta = theta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 0.1)), float(theta[1])
