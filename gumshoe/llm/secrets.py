"""Secret scan: fixed credential shapes plus password guess-cost dynamic programming.

The three base kinds find credential shapes by pattern.  The method adds values
that stand in a credential context (``password is ...``, ``pwd: ...``,
``login with user / password``) and would be hard to guess: the value is cut into
dictionary words, dates, repeats, keyboard walks, sequences and brute-force
spans so that the summed log-cost is least, and values whose least cost reaches
``MIN_LOG10`` are reported as kind ``password``.  Whole values are weighed, in
time linear in their length: repeats (of units of any length), walks and sequences
are taken as maximal runs, units that alone cost enough are left out, and the cut
ends once every way on already costs enough.

Null text counts as empty; offsets are code points, ends exclusive; texts of any
length are scanned whole; repeated rows give equal results; an empty table gives
no rows; extra columns are ignored by ``scan_secrets`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.llm.tokenize import vocabulary_path

KINDS = ("assign", "access", "hex", "password")
# The three base shapes and the least length of what they match.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_HEX_RUN = re.compile(r"[0-9a-f]{24}")

# Ways to name a credential whose value the base shapes miss.
CONTEXT = re.compile(
    r"(?ai:\b(?:pass(?:word|wd|phrase|code)?|pwd|pin|credentials?|secret|login)\b)[\"']?(?:\x20{0,3}(?:is|was|=>|->|:=|[:=])\x20{0,3}|\x20\()[\"'`]?([^\s\"'`<>(){}]{6,})"
)
LOGIN = re.compile(r"(?ai:\blog[\x20-]?in\x20{1,3}with)\x20{1,3}[\"'`]?[^\s\"'`<>(){}/]+[\"'`]?\x20{0,3}/\x20{0,3}[\"'`]?([^\s\"'`<>(){}]{6,})")
MIN_LOG10 = 8.0

# Common words of passwords, most frequent first.
WORDS = """password the and qwerty admin letmein welcome monkey dragon login master hello shadow sunshine princess football
baseball superman batman love iloveyou secret summer winter spring autumn access flower hunter killer soccer jordan
michael charlie jessica pepper freedom whatever computer internet trustno starwars cookie cheese ginger thomas robert
root user guest test demo default changeme example sample token server database system service account company office
monday friday january february march april june july august september october november december true false null none
this that with from your have will not for you are was here there when where what how home work day night year time
new old big red blue green black white gold silver happy lucky magic power super mega ultra king queen angel devil""".split()
LEET = str.maketrans("0134578@$!+", "oleastbasit")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
NEXT_KEY = {a + b for row in ROWS for a, b in zip(row, row[1:])} | {b + a for row in ROWS for a, b in zip(row, row[1:])}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
RANK = {w: n for n, w in enumerate(WORDS, 1)}


@lru_cache(maxsize=1)
def _prose() -> dict[str, int]:
    """Ranks of words and word parts of a public vocabulary, most frequent first."""
    with open(vocabulary_path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks: dict[str, int] = {}
    for unit, n in sorted(vocabulary.items(), key=lambda u: u[1]):
        word = unit.removesuffix("</w>")
        if len(word) >= 3 and word.isalpha():
            ranks.setdefault(word, n + 1)
    return ranks


@lru_cache(maxsize=1)
def _longest_word() -> int:
    return max(map(len, [*WORDS, *_prose()]))


def _alphabet(span: str) -> int:
    return max(1, 10 * any(c.isdigit() for c in span) + 26 * any("a" <= c <= "z" for c in span) + 26 * any("A" <= c <= "Z" for c in span) + 33 * any(not c.isalnum() for c in span))


def _runs(text: str, enough: float = math.inf) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, log10 guesses) of every maximal repeat, keyboard walk and sequence.

    Units of repeats may have any length; those that alone cost ``enough`` are left out, as no cut
    with one of them costs less.
    """
    n, brute = len(text), math.log10(max(10, _alphabet(text)))
    longest = n // 2 if math.isinf(enough) else min(n // 2, int(enough / brute) + 1)
    for size in range(1, max(1, longest) + 1):  # text[i] == text[i - size] over a whole run repeats its first ``size`` letters
        a = 0
        for i in range(size, n + 1):
            if i < n and text[i] == text[i - size]:
                continue
            times = (i - a) // size
            if times >= (3 if size == 1 else 2):
                unit = math.log10(_alphabet(text[a])) if size == 1 else size * brute
                yield a, a + times * size, "repeat", unit + math.log10(times)
            a = i - size + 1
    low = text.lower()
    a = 0
    for i in range(1, n + 1):
        if i == n or low[i - 1 : i + 1] not in NEXT_KEY:
            if i - a >= 4:
                yield a, i, "walk", math.log10(47 * 4 * (i - a))
            a = i
    a, step = 0, 0
    for i in range(1, n + 1):
        by = ord(text[i]) - ord(text[i - 1]) if i < n and text[i].isalnum() and text[i - 1].isalnum() else 0
        if by != step or abs(by) != 1:
            if abs(step) == 1 and i - a >= 3:
                yield a, i, "sequence", math.log10(26 * (i - a))
            a, step = i - 1, by


def segments_at(text: str, i: int, low: str) -> Iterator[tuple[int, str, float]]:
    """(end, kind, log10 guesses) of every word and date that begins at ``i``."""
    prose = _prose()
    for j in range(i + 3, min(len(text), i + _longest_word()) + 1):
        span = text[i:j]
        rank = RANK.get(low[i:j]) or prose.get(span.lower())
        if rank:
            varied = (span != span.lower()) + (low[i:j] in RANK and span.lower() != low[i:j])
            yield j, "word", math.log10(rank + 1) + 0.7 * varied
    m = DATE.match(text, i)
    if m:
        yield m.end(), "date", math.log10(365 * 120) if m.end() - i > 4 else 2.1


#: What each pattern adds to the cost of its parts: patterns may stand in any order.
PATTERN = 0.3


def guess_cost(value: str, enough: float = math.inf) -> tuple[float, tuple[tuple[str, int, int], ...]]:
    """(log10 guesses, segments) of the cheapest cut of ``value``.

    Once every cut costs at least ``enough``, that least cost so far is returned without segments;
    a cost of at least ``enough`` may exceed the least one.  Without ``enough`` repeats of every
    length are looked for, in time quadratic in the value's length.
    """
    n, brute = len(value), math.log10(max(10, _alphabet(value)))
    best: list[float] = [0.0] + [math.inf] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    low, reach, check = value.lower().translate(LEET), 0, 0
    if len(low) != n:  # a few letters grow when lowered
        low = "".join(c.lower()[:1] for c in value).translate(LEET)
    runs: dict[int, list[tuple[int, str, float]]] = {}
    for a, b, kind, cost in _runs(value, enough):
        runs.setdefault(a, []).append((b, kind, cost))
    for i in range(n):
        here = best[i]
        if here + brute < best[i + 1]:
            best[i + 1], back[i + 1] = here + brute, ("brute", i)
        for j, kind, cost in (*segments_at(value, i, low), *runs.get(i, ())):
            reach = max(reach, j)
            if here + cost + PATTERN < best[j]:
                best[j], back[j] = here + cost + PATTERN, (kind, i)
        if i >= check and here >= enough:
            # Every cut passes one of the places from here to the farthest reached; a cheap one among them settles nothing until it is passed.
            least = min(range(i, max(reach, i) + 1), key=best.__getitem__)
            if best[least] >= enough:
                return best[least], ()
            check = least + 1
    segments, j = [], n
    while j:
        kind, i = back[j]
        if kind == "brute" and segments and segments[-1][0] == "brute":
            segments[-1] = ("brute", i, segments[-1][2])
        else:
            segments.append((kind, i, j))
        j = i
    return best[n], tuple(reversed(segments))


@lru_cache(maxsize=65_536)
def hard_to_guess(value: str, least: float) -> bool:
    return guess_cost(value, least)[0] >= least


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Fixed shapes of each kind, leftmost and not overlapping within a kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    at = 0
    while m := _HEX_RUN.search(text, at):  # the leftmost run of 24 begins a maximal run
        full = HEX.match(text, m.start())
        found.append(("hex", *full.span()))
        at = full.end()
    return found


def guessed_spans(text: str, taken: list[tuple[str, int, int]], least: float = MIN_LOG10) -> list[tuple[str, int, int]]:
    """Hard-to-guess values in a credential context, outside the base spans."""
    found = []
    for m in sorted([*CONTEXT.finditer(text), *LOGIN.finditer(text)], key=lambda m: m.start(1)):
        value = m[1].rstrip(".,;:!?")
        a = m.start(1)
        b = a + len(value)
        if len(value) < 6 or any(s < b and a < e for _, s, e in taken + found[-1:]):
            continue
        if (hard_to_guess if len(value) <= 256 else hard_to_guess.__wrapped__)(value, least):
            found.append(("password", a, b))
    return found


def _joined(spans: list[tuple[str, int, int]]) -> str:
    spans = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_password, base_sha256, spans) per row; ``spans`` lists kind:start:end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digest, spans = {k: [] for k in KINDS}, [], []
            for t in b.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                every = base + guessed_spans(t, base)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in every))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            cols = [b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return docs.select(id_col, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def mask(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every secret replaced by ``mark``."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for _, a, b in sorted(base + guessed_spans(text, base), key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at:a], mark] if a >= at else []
        at = b
    return "".join(out) + text[at:] if at else text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; all columns and rows stay, ``n_chars`` follows the new text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def masked(texts):
        return texts.map(mask, na_action="ignore")

    out = docs.withColumn(text, masked(F.col(text)))
    return out.withColumn("n_chars", F.length(text).cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
