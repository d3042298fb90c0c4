"""Batch tokenization with the ``tokenizers`` library, one call per distinct unit.

Both supported vocabularies split text into pre-tokens that never reach across a
single space between two non-blank characters, so a text may be cut there and
each *distinct* piece encoded once per Python worker.  Pieces made of Latin
letters plus at most one mark go straight to the BPE model; every other piece
takes the library's whole pipeline, and texts with other blank runs are encoded
uncut.  The ids equal those of encoding the whole text (tested).

Memory is bounded: one Arrow batch of texts plus a unit cache of
``CACHE_UNITS`` entries that is emptied when full.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_UNITS = 600_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_UNIT = f"^(?P<lead>\\n?)(?P<word>[{LETTERS}]+)(?P<mark>[.,!?;:]?)$"
SLICE_BYTES = 4 << 20
#: Uncut texts are encoded together up to about this size.
WHOLE_BYTES = 256 << 10
_OPEN: dict[str, "UnitCodec"] = {}


#: Texts with blank runs, blanks at an end, other blanks, or letters outside the Latin, Greek, Cyrillic and general blocks aren't cut.
_ODD = r"^\s|\s$|[^\S\n][^\S ]|[^\S ][^\S\n]| [^\S\n]|\n\s|[^\S \n]|[^\x00-\x{024F}\x{1E00}-\x{2BFF}]"


def gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[begin[i]:begin[i] + size[i]] for i in ``index``, joined, and where each ends."""
    each = size[index]
    ends = np.cumsum(each)
    if not len(ends) or not ends[-1]:
        return pool[:0], ends
    at = np.repeat((begin[index] - (ends - each)).astype(np.int32), each)
    at += np.arange(ends[-1], dtype=np.int32)
    return pool[at], ends


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; ``folder`` overrides the installed one."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others are shifted past 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(shifted)}


class UnitCodec:
    """Encodes Arrow string arrays to flat uint16/uint32 ids and offsets."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.keeps_space = self.tokenizer.encode("a b", add_special_tokens=False).ids != [
            i for p in ("a", "b") for i in self.tokenizer.encode(p, add_special_tokens=False).ids
        ]
        self.alphabet = byte_letters()
        self.model = self.tokenizer.model
        # Words and other pieces are kept apart: a spaced word's name in the byte alphabet may be another piece's text.
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _pack(self, ids) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def _room(self) -> None:
        if len(self.words) + len(self.pieces) > CACHE_UNITS:
            self.words.clear()
            self.pieces.clear()

    def _words(self, words: list[str], spaced: bool) -> list[bytes]:
        """Packed ids of words of Latin letters; ``spaced`` if a space stands before them."""
        self._room()
        lead = "Ġ" if spaced and self.keeps_space else ""
        cache, get, tokenize, kind, found = self.words, self.words.get, self.model.tokenize, self.dtype.char, []
        for word in words:
            got = get(key := lead + word)
            if got is None:
                form = word if self.keeps_space else word.lower()
                if not form.isascii():
                    form = form.encode().decode("latin-1").translate(self.alphabet)
                got = cache[key] = array(kind, [t.id for t in tokenize(lead + form)]).tobytes()
            found.append(got)
        return found

    def _others(self, units: list[str]) -> list[bytes]:
        """Packed ids of any other pieces, by the library's whole pipeline."""
        self._room()
        found = [self.pieces.get(u) for u in units]
        rest = [n for n, got in enumerate(found) if got is None]
        for n, e in zip(rest, self.tokenizer.encode_batch([units[n] for n in rest], add_special_tokens=False)):
            found[n] = self._pack(e.ids)
            if len(units[n]) < 64:
                self.pieces[units[n]] = found[n]
        return found

    def _units(self, units: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, begin, size): unit n's ids are pool[begin[n]:begin[n] + size[n]]."""
        parts = pc.extract_regex(units, pattern=_UNIT)
        plain = np.asarray(parts.is_valid())
        lead = np.asarray(pc.equal(pc.struct_field(parts, "lead"), "\n").fill_null(False))
        words = pc.struct_field(parts, "word").fill_null("").dictionary_encode()
        marks = pc.struct_field(parts, "mark").fill_null("").dictionary_encode()
        space = " " if spaced and self.keeps_space else ""
        texts = words.dictionary.to_pylist()
        rest = pc.filter(units, pa.array(~plain)).to_pylist()
        pieces = [b"", *self._others(["\n"])]
        at_words = len(pieces)
        pieces += self._words(texts, spaced)
        at_led = len(pieces)
        word = np.asarray(words.indices).astype(np.int64)
        led, of_led = np.unique(word[lead], return_inverse=True)
        pieces += self._words(words.dictionary.take(pa.array(led)).to_pylist(), False)
        at_marks = len(pieces)
        pieces += self._others(marks.dictionary.to_pylist())
        at_rest = len(pieces)
        pieces += self._others([u if u[:1] == "\n" else space + u for u in rest])
        of = np.zeros((len(units), 3), np.int64)
        of[:, 0] = lead
        of[:, 1] = at_words + word
        of[lead, 1] = at_led + of_led
        of[:, 2] = at_marks + np.asarray(marks.indices)
        of[~plain] = 0
        of[~plain, 1] = at_rest + np.arange(len(rest))
        pool = np.frombuffer(b"".join(pieces), self.dtype)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.dtype.itemsize
        pool, ends = gather(pool, np.cumsum(sizes) - sizes, sizes, of.ravel())
        ends = ends[2::3]
        begin = np.concatenate([[0], ends[:-1]])
        return pool, begin, ends - begin

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text n owns ids[offsets[n]:offsets[n + 1]]; null counts as empty."""
        done = [(ids, offsets) for _, ids, offsets in self.encode_slices(texts)]
        ids = np.concatenate([i for i, _ in done]) if done else np.zeros(0, self.dtype)
        sizes = np.concatenate([np.diff(o) for _, o in done]) if done else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def encode_slices(self, texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, offsets) of runs of texts of about ``size`` bytes, so that no more is held at a time."""
        size = size or SLICE_BYTES
        ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)), dtype=np.int64)
        cuts = np.searchsorted(ends, np.arange(size, ends[-1], size)) + 1 if len(texts) else []
        cuts = [0, *sorted({int(c) for c in cuts if c < len(texts)}), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                ids, offsets = self._slice(pc.fill_null(texts[a:b].cast(pa.large_string()), ""))
                yield a, ids, offsets.astype(np.int64)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        odd = pc.match_substring_regex(texts, _ODD)
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        starts = np.asarray(cut.offsets).astype(np.int64)
        starts -= starts[0]
        coded = cut.flatten().dictionary_encode()
        index = np.asarray(coded.indices).astype(np.int64)
        heads, of_head = np.unique(index[starts[:-1]], return_inverse=True)
        pool, begin, size = self._units(coded.dictionary, True)
        pool2, begin2, size2 = self._units(coded.dictionary.take(pa.array(heads)), False)
        index[starts[:-1]] = len(begin) + of_head
        pool, begin, size = np.concatenate([pool, pool2]), np.concatenate([begin, begin2 + len(pool)]), np.concatenate([size, size2])
        ids, ends = gather(pool, begin, size, index)
        offsets = np.concatenate([[0], ends])[starts]
        whole = np.flatnonzero(np.asarray(odd))
        return self._splice(ids, offsets, whole, texts) if len(whole) else (ids, offsets)

    def _splice(self, ids, offsets, whole, texts):
        """Put the uncut texts' ids in their places."""
        sizes = np.diff(offsets)
        parts = np.split(ids, offsets[1:-1])
        ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)[whole] if len(whole) else whole
        for some in np.split(whole, np.flatnonzero(np.diff(ends // WHOLE_BYTES)) + 1):
            for k, e in zip(some, self.tokenizer.encode_batch([texts[int(k)].as_py() for k in some], add_special_tokens=False)):
                parts[k] = np.asarray(e.ids, self.dtype)
                sizes[k] = len(parts[k])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def codec(path: str) -> UnitCodec:
    """The worker's codec for one vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = UnitCodec(path)
    return _OPEN[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every document."""
    n = len(offsets) - 1
    out = np.empty(len(ids) + n, ids.dtype)
    new = offsets + np.arange(n + 1)
    mask = np.ones(len(out), bool)
    mask[new[1:] - 1] = False
    out[mask] = ids
    out[new[1:] - 1] = end_id
    return out, new
