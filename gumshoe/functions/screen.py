"""Screens: plain-text tests that any text a pattern matches must pass, far cheaper than the pattern itself."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

try:  # Python's own pattern parser isn't public; without it nothing is screened
    from re import _constants as K
    from re import _parser
except ImportError:
    K = _parser = None

MOST_WORDS = 64
MOST_STRINGS = 24


@lru_cache(maxsize=1024)
def needed_words(pattern: str) -> tuple[tuple[str, ...], bool]:
    """Strings of which each match of ``pattern`` holds at least one, and whether they are in lower case as the pattern ignores case.

    Of the parts that a match must have, the one whose shortest string is longest is taken.  No strings if no part is
    fixed, there are too many, or Python can't parse the pattern.
    """
    try:
        tree = _parser.parse(pattern)
        fold = bool(tree.state.flags & re.IGNORECASE)
        words = _words(tree, fold)
    except (re.error, AttributeError, TypeError, ValueError, IndexError):  # or it changed
        return (), False
    return (tuple(sorted(words)) if len(words) <= MOST_WORDS else ()), fold


def _words(tree, fold: bool) -> frozenset[str]:
    """``needed_words`` of a parsed sequence; empty if nothing is fixed."""
    found, run = [], ""
    for op, arg in tree:
        if op is K.LITERAL and (arg < 128 or not fold):
            run += chr(arg).lower() if fold else chr(arg)
            continue
        found.append(frozenset({run} - {""}))
        run = ""
        if op is K.SUBPATTERN and not arg[1] and not arg[2]:  # groups with flags of their own aren't looked into
            found.append(_words(arg[3], fold))
        elif op is K.BRANCH:
            each = [_words(a, fold) for a in arg[1]]
            found.append(frozenset().union(*each) if all(each) else frozenset())
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
            found.append(_words(arg[2], fold))
    found.append(frozenset({run} - {""}))
    return max(found, key=lambda words: (min(map(len, words), default=0), -len(words)))


@lru_cache(maxsize=1024)
def needs(pattern: str) -> tuple | None:
    """What a text that ``pattern`` matches holds, in lower case and with line ends and tabs as spaces.

    ("word", w), ("all", parts) or ("any", parts); None if nothing is fixed, there are too many words, or Python can't parse the pattern.
    """
    try:
        tree = _needs(_parser.parse(pattern))
    except (re.error, AttributeError, TypeError, ValueError, IndexError):
        return None
    return tree if tree and _n_words(tree) <= MOST_WORDS else None


def _n_words(tree: tuple) -> int:
    return 1 if tree[0] == "word" else sum(map(_n_words, tree[1]))


def _least(tree: tuple) -> int:
    """Length of the longest word that the tree has in every case: the longer, the rarer."""
    return len(tree[1]) if tree[0] == "word" else (max if tree[0] == "all" else min)(map(_least, tree[1]))


def _any(parts) -> tuple | None:
    """One of ``parts``; a word that holds another of them adds nothing."""
    words = {p[1] for p in parts if p and p[0] == "word"}
    if None in parts or "" in words:
        return None
    kept = [("word", w) for w in sorted(words) if not any(v != w and v in w for v in words)]
    kept += dict.fromkeys(p for p in parts if p[0] != "word")
    return kept[0] if len(kept) == 1 else ("any", tuple(kept))


def _all(parts) -> tuple | None:
    """Each of ``parts``, the rarest first; blanks alone say nothing."""
    kept = sorted(dict.fromkeys(p for p in parts if p and p != ("word", " ")), key=lambda p: -_least(p))
    return kept[0] if len(kept) == 1 else ("all", tuple(kept)) if kept else None


def _strings(tree) -> frozenset[str] | None:
    """All strings, in lower case and with spaces for blanks, that a parsed sequence matches; None if they are many or unknown."""
    out = frozenset({""})
    for op, arg in tree:
        if op is K.AT:
            continue
        if op is K.LITERAL:
            each = frozenset({_plain(arg)})
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg):
            each = frozenset(_plain(c) for _, c in arg)
        elif op is K.SUBPATTERN and not arg[1] and not arg[2]:
            each = _strings(arg[3])
        elif op is K.BRANCH:
            every = [_strings(a) for a in arg[1]]
            each = None if None in every else frozenset().union(*every)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] == 1:
            each = _strings(arg[2])
            each = each | {""} if each is not None and not arg[0] else each
        else:
            return None
        if each is None or None in each or len(out) * len(each) > MOST_STRINGS:
            return None
        out = frozenset(a + b for a in out for b in each)
    return out


def _plain(code: int) -> str | None:
    """An ASCII character as texts are screened; None for others, whose lower case may be several characters."""
    return None if code >= 128 else " " if chr(code) in "\t\n" else chr(code).lower()


def _needs(tree) -> tuple | None:
    """``needs`` of a parsed sequence."""
    parts, runs = [], frozenset({""})
    end = lambda: parts.append(_any([("word", r) for r in runs]))
    for item in tree:
        op, arg = item
        each = _strings([item])
        if each is not None and len(runs) * len(each) <= MOST_STRINGS:
            runs = frozenset(a + b for a in runs for b in each)
            continue
        if op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0 and _strings(arg[2]) == {" "}:
            runs = frozenset(r + " " for r in runs)
            end()
            runs = frozenset({" "})
            continue
        end()
        runs = frozenset({""}) if each is None else each
        if each is not None:
            continue
        if op is K.SUBPATTERN and not arg[1] and not arg[2]:  # groups with flags of their own aren't looked into
            parts.append(_needs(arg[3]))
        elif op is K.BRANCH:
            parts.append(_any([_needs(a) for a in arg[1]]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
            parts.append(_needs(arg[2]))
    end()
    return _all(parts)


#: Gates that mean the same to Java on text and to RE2 on bytes: ASCII sets and characters, groups, counts.
_PLAIN = re.compile(r"(?:\[[A-Za-z0-9 ._%+/-]+\]|\\\.|[A-Za-z0-9@ /-]|\(\?:|\)|\||[?*+]|\{[0-9]+(?:,[0-9]*)?\})+")
_FOLDED = bytes(32 if c in (9, 10) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _test(tree: tuple | None):
    """``needs`` as a test of bytes; one of no needs passes all."""
    if tree is None:
        return lambda t: True
    if tree[0] == "word":
        return lambda t, w=tree[1].encode(): w in t
    each, whole = [_test(p) for p in tree[1]], tree[0] == "all"

    def test(t):
        for f in each:
            if f(t) is not whole:
                return not whole
        return whole

    return test


def candidates(rows: DataFrame, rules: list, text_col: str, every: bool = False) -> tuple[DataFrame, list[Column]]:
    """Rows whose text some rule may match, or ``every`` row, and a test of each rule, false only where it can't.

    Texts go by Arrow through Python, whose search for fixed strings is an order of magnitude faster than
    ``contains``; few texts and no patterns go on.
    """
    quick = [r.gate if _PLAIN.fullmatch(r.gate) else "" for r in rules]
    needed = [needs(r.pattern) for r in rules]
    at = rows.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        tests = [_test(n) for n in needed]
        for batch in batches:
            raw = batch.column(at).cast(pa.binary())
            gates = {g: pc.match_substring_regex(raw, g).to_pylist() for g in set(quick) - {""}}
            found = []
            for n, text in enumerate(raw):
                text = text.as_py()
                low = text.translate(_FOLDED) if text is not None else None
                found.append([] if text is None else [k for k, (test, g) in enumerate(zip(tests, quick)) if (not g or gates[g][n]) and test(low)])
            keep = pa.array([every or bool(f) for f in found], pa.bool_())
            held = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, held], names=[*batch.schema.names, "_rules"]).filter(keep)

    few = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_rules", ArrayType(IntegerType()))]))
    holds = [F.array_contains("_rules", F.lit(n)) for n in range(len(rules))]
    return few, [h & F.col(text_col).rlike(r.gate) if r.gate and not q else h for h, r, q in zip(holds, rules, quick)]


def may_match(text: Column, lowered: Column, pattern: str, gate: str = "") -> Column | None:
    """False or null only where ``pattern`` can't match ``text``: its needed words, then ``gate``, a cheap pattern; None if there is no screen.

    ``lowered`` is the text in lower case, a column computed once for all patterns.
    """
    words, fold = needed_words(pattern)
    tests = [reduce(lambda a, b: a | b, [F.contains(lowered if fold else text, F.lit(w)) for w in words])] if words else []
    if gate:
        tests.append(text.rlike(gate))
    return reduce(lambda a, b: a & b, tests) if tests else None


def screened(matches: Column, text: Column, lowered: Column, pattern: str, gate: str = "") -> Column:
    """``matches``, evaluated only where ``pattern`` may match, else null."""
    test = may_match(text, lowered, pattern, gate)
    return matches if test is None else F.when(test, matches)
