"""Pre-tokens of a text, for tokenizers whose merges never cross a pre-token.

A tokenizer of that kind gives a text the ids of its pre-tokens one after another, so each
distinct pre-token needs encoding once. Splitting is done here with a compiled pattern for
texts whose characters are all ``SAFE``: code points whose class (letter, number, white
space, other), lower-case form and normalised form are the same in every Unicode version
(tests compare them with the library one by one). Any other text, and any text that holds the
string of a special token, goes whole through the library's own steps.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _ranges(points) -> str:
    """A character class body for the code points."""
    out, points = [], sorted(points)
    start = last = None
    for p in [*points, None]:
        if start is None:
            start = last = p
        elif p is not None and p == last + 1:
            last = p
        else:
            out.append(f"\\U{start:08x}" if start == last else f"\\U{start:08x}-\\U{last:08x}")
            start = last = p
    return "".join(out)


def _safe_points() -> set[int]:
    latin = {p for p in range(0x250) if len(chr(p).lower()) == 1 and ord(chr(p).lower()) < 0x250}
    marks = {*range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0), *range(0x1F300, 0x1FB00)}
    return latin | marks


SAFE = _safe_points()
_SPACE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
_LETTER = {p for p in SAFE if p < 0x250 and unicodedata.category(chr(p))[0] == "L"}
_NUMBER = {p for p in SAFE if p < 0x250 and unicodedata.category(chr(p))[0] == "N"}
UNSAFE = re.compile(f"[^{_ranges(SAFE)}]")
_L, _N, _S = _ranges(_LETTER), _ranges(_NUMBER), _ranges(_SPACE)
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"  # fixed by the tokenizers' files
#: Byte-level pre-tokens (a word takes one blank before it).
BYTE_LEVEL = re.compile(f"{_CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Pre-tokens of the word tokenizer, on lower-cased text (white space is dropped).
WORD_LEVEL = re.compile(f"{_CONTRACTIONS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")

#: Bytes of pre-tokens and their values a worker remembers, by a rough count: workers live on between stages, so what each
#: keeps must be small.
CACHE_BYTES = 64 << 20
#: Of an entry besides its text and value: two object heads and a place in the table.
ENTRY_BYTES = 120
#: Pre-tokens handed to an encoder at a time.
LEARN_AT_ONCE = 4000
#: Characters of texts that are Python objects at a time.
BLOCK = 1 << 20


class PieceCache:
    """Values of pre-tokens, filled for all missing ones of a block of texts at once.

    Two generations of at most half of ``limit`` bytes are kept: when ``known`` is full it becomes the old one, whose entries are
    taken over as they are met again and else go when the next generation is full.
    """

    def __init__(self, pattern: re.Pattern, values_of, specials: tuple[str, ...], lower: bool, limit: int = CACHE_BYTES, weight=None):
        """``weight`` gives the bytes of a list of values (numbers weigh nothing)."""
        self.limit, self.size, self.old, self.weight = limit, 0, {}, weight or (lambda values: 0)
        self.findall, self.values_of, self.lower, self.known = pattern.findall, values_of, lower, {}
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def plain(self, text: str) -> bool:
        return (text.isascii() or not UNSAFE.search(text)) and not (self.special and self.special.search(text))

    def pieces(self, texts: list[str]) -> list[list[str] | None]:
        """The pre-tokens of each text with their values known; None for a text that needs the library."""
        split = [self.findall(t.lower() if self.lower else t) if self.plain(t) else None for t in texts]
        self.learn(split)
        return split

    def learn(self, split: list[list[str] | None]) -> None:
        if self.size > self.limit // 2:
            self.old, self.known, self.size = self.known, {}, 0
        found: set[str] = set()
        found.update(*[words for words in split if words])
        old, fresh = self.old, found.difference(self.known)
        taken = [w for w in fresh if w in old]
        self._keep(taken, list(map(old.__getitem__, taken)))
        missing = list(fresh.difference(old))
        for k in range(0, len(missing), LEARN_AT_ONCE):
            part = missing[k : k + LEARN_AT_ONCE]
            self._keep(part, self.values_of(part))

    def _keep(self, words: list[str], values: list) -> None:
        self.known.update(zip(words, values, strict=True))
        self.size += ENTRY_BYTES * len(words) + sum(map(len, words)) + self.weight(values)


def blocks(texts, limit: int = BLOCK):
    """Runs of consecutive texts of about ``limit`` characters (a longer text is a run of its own)."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def text_slices(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of ``batch`` whose ``column`` (strings or bytes) has about ``limit`` bytes, with that column's values: only one
    slice's texts are Python objects at a time. An empty batch gives none."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(sizes) - sizes
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(before + sizes, before[at] + limit, "right")))
        part = batch.slice(at, end - at)
        yield part, part.column(column).to_pylist()
        at = end
