"""Vectorised splitting of texts into the words of a tokenizer, and a cache of their ids.

A byte-pair tokenizer encodes each pre-token by itself, so a text's ids are the ids of its
pre-tokens in a row. Splitting is done with numpy over the code points of many texts at once;
each distinct word goes to its encoder once and is found by hash after that. Every hit is compared code point by
code point, so that words which share a hash keep their own ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import regex

from .common import U64, mixed, ring_sums, ring_windows

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_NONE = 255
#: Code points per numpy pass, and distinct words kept before a cache starts anew.
BLOCK, KEPT_WORDS = 300_000, 800_000

_classes: np.ndarray | None = None
_values: np.ndarray | None = None
_lower: np.ndarray | None = None


def classes() -> np.ndarray:
    """White space, letter, number or other for each code point."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):
            chars = "".join(map(chr, range(low, high)))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
                for m in regex.finditer(pattern, chars):
                    table[low + m.start() : low + m.end()] = kind
        _classes = table
    return _classes


def _code_values(cp: np.ndarray) -> np.ndarray:
    global _values
    if _values is None:
        _values = mixed(np.arange(1, 0x110001, dtype=U64) * U64(0xA0761D6478BD642F))
    return _values[cp]


def _lowered(cp: np.ndarray) -> np.ndarray:
    """Lower case below U+0300, where it is one to one (U+0130 is left alone)."""
    global _lower
    if _lower is None:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x300):
            low = chr(c).lower()
            if len(low) == 1:
                table[c] = ord(low)
        _lower = table
    return _lower[cp]


def _neighbours(cls: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.full(len(cls), _NONE, np.uint8), np.full(len(cls), _NONE, np.uint8)
    before[1:], after[:-1] = cls[:-1], cls[1:]
    inner = firsts[firsts < len(cls)]
    before[inner] = _NONE
    after[inner[inner > 0] - 1] = _NONE
    return before, after


def _contractions(cp: np.ndarray, start: np.ndarray, firsts: np.ndarray) -> None:
    """'s 't 're 've 'm 'll 'd that begin a pre-token become one of their own."""
    at = np.flatnonzero((cp == 39) & start)
    if not len(at):
        return
    ends = np.append(firsts, len(cp))
    end = ends[np.searchsorted(ends, at, "right")]
    padded = np.append(cp, [0, 0, 0])
    one = np.where(at + 1 < end, padded[at + 1], 0)
    two = np.where(at + 2 < end, padded[at + 2], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[at[short | long] + 1] = False
    rest = np.where(short, at + 2, at + 3)
    rest = rest[(short | long) & (rest < end)]
    start[rest] = True


def byte_level_starts(cp: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens of a byte-level tokenizer (a word takes one space before it)."""
    cls = classes()[cp]
    before, after = _neighbours(cls, firsts)
    start = cls != before
    last = (cls == SPACE) & (after != SPACE) & (after != _NONE)
    start |= last
    start[1:][(last & (cp == 32))[:-1]] = False
    _contractions(cp, start, firsts)
    at = np.flatnonzero(start)
    return at, np.ones(len(at), dtype=bool)


def word_level_starts(cp: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces of a word tokenizer that drops white space; the flag is false for white space.

    A run without white space that holds a code point from U+0300 on, or U+0130, whose
    normal form or lower case may change its class, is one piece; its encoder splits it.
    """
    cls = classes()[cp]
    before, _ = _neighbours(cls, firsts)
    start = (cls != before) | (cls == NUMBER)
    _contractions(cp, start, firsts)
    special = (cp >= 0x300) | (cp == 0x130)
    if special.any():
        edge = ((cls == SPACE) != (before == SPACE)) | (before == _NONE)
        run = np.cumsum(edge) - 1
        whole = np.bincount(run, weights=special, minlength=run[-1] + 1) > 0
        start = np.where(whole[run], edge, start)
    at = np.flatnonzero(start)
    return at, cls[at] != SPACE


def ranges(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + sizes[0] - 1, start[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(start - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Lists:
    """Lists of numbers, one after the other in a growing array."""

    def __init__(self):
        self.flat, self.used, self.n = np.zeros(1 << 16, dtype=np.uint32), 0, 0
        self.offsets, self.lengths = np.zeros((2, 1 << 14), dtype=np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        n = self.n + len(lengths)
        while n > len(self.offsets):
            self.offsets, self.lengths = np.concatenate([self.offsets, self.offsets * 0]), np.concatenate([self.lengths, self.lengths * 0])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.flat[self.used : self.used + len(flat)] = flat
        self.offsets[self.n : n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : n] = lengths
        self.used, self.n = self.used + len(flat), n

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the rows in a row, and how many each has."""
        lengths = self.lengths[rows]
        return self.flat[ranges(self.offsets[rows], lengths)], lengths


class WordTable:
    """Open-addressing hash table from 64-bit hashes to rows of ids, and each row's code points."""

    def __init__(self, bits: int = 17):
        self.keys = np.zeros(1 << bits, dtype=U64)
        self.rows = np.zeros(1 << bits, dtype=np.int32)
        self.n = 0
        self.ids, self.chars = _Lists(), _Lists()

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        mask = U64(len(self.keys) - 1)
        out = np.full(len(hashes), -1, dtype=np.int64)
        slot = hashes & mask
        key = self.keys[slot]
        hit = key == hashes
        out[hit] = self.rows[slot[hit]]
        left = np.flatnonzero(~hit & (key != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + U64(1)) & mask
            key = self.keys[slot]
            hit = key == hashes[left]
            out[left[hit]] = self.rows[slot[hit]]
            keep = ~hit & (key != 0)
            left, slot = left[keep], slot[keep]
        return out

    def _place(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        mask = U64(len(self.keys) - 1)
        slot = hashes & mask
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            done = self.keys[slot] == hashes
            self.rows[slot[done]] = rows[done]
            hashes, rows, slot = hashes[~done], rows[~done], (slot[~done] + U64(1)) & mask

    def add(self, hashes: np.ndarray, flat: np.ndarray, lengths: np.ndarray, chars: np.ndarray | None = None, sizes: np.ndarray | None = None) -> None:
        """New rows for distinct hashes that aren't in the table; without hashes, rows that no hash finds."""
        n = self.n + len(lengths)
        if 2 * n > len(self.keys):
            old, rows = self.keys, self.rows
            bits = (4 * n).bit_length()
            self.keys, self.rows = np.zeros(1 << bits, dtype=U64), np.zeros(1 << bits, dtype=np.int32)
            full = old != 0
            self._place(old[full], rows[full])
        self.ids.add(flat, lengths)
        self.chars.add(np.zeros(0, np.uint32) if chars is None else chars, lengths * 0 if sizes is None else sizes)
        self._place(hashes, np.arange(self.n, self.n + len(hashes), dtype=np.int32))
        self.n = n

    def others(self, rows: np.ndarray, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of the words cp[start : end] that aren't those of their rows."""
        sizes = end - start
        same = self.chars.lengths[rows] == sizes
        own, known = ranges(start[same], sizes[same]), self.chars.gather(rows[same])[0]
        wrong = np.flatnonzero(cp[own] != known)
        same[np.flatnonzero(same)[np.searchsorted(np.cumsum(sizes[same]), wrong, "right")]] = False
        return np.flatnonzero(~same)


class CachedEncoder:
    """Ids of whole texts from an encoder of words.

    ``encode_words``: the ids of a list of words, as one flat array and lengths.
    ``encode_text``: the ids of one whole text; used where a text holds one of ``specials``.
    """

    def __init__(self, starts: Callable, encode_words: Callable, encode_text: Callable, specials: list[str], lower: bool = False):
        self.starts, self.encode_words, self.encode_text, self.specials, self.lower = starts, encode_words, encode_text, specials, lower
        self.table = WordTable()

    def batches(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (number of texts, their ids in a row, how many each has), in order."""
        group: list[str] = []
        size = 0
        for text in texts:
            if any(s in text for s in self.specials):
                if group:
                    yield self._encode(group)
                    group, size = [], 0
                ids = np.asarray(self.encode_text(text), dtype=np.uint32)
                yield 1, ids, np.array([len(ids)])
                continue
            if group and size + len(text) > BLOCK:
                yield self._encode(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        if group:
            yield self._encode(group)

    def _encode(self, texts: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        if not len(cp):
            return len(texts), np.zeros(0, np.uint32), sizes
        if self.table.n > KEPT_WORDS:
            self.table = WordTable()
        firsts = np.unique((ends - sizes)[sizes > 0])
        if self.lower:
            cp = _lowered(cp)
        start, real = self.starts(cp, firsts)
        end = np.append(start[1:], len(cp))
        start, end = start[real], end[real]
        hashes = ring_windows(ring_sums(_code_values(cp)), start, end)
        hashes[hashes == 0] = 1
        rows = self.table.find(hashes)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            rows[missing] = self.table.n + back
            self._learn(new, cp, start[missing[first]], end[missing[first]])
        others = self.table.others(rows, cp, start, end)
        if len(others):
            rows[others] = self.table.n + np.arange(len(others))
            self._learn(np.zeros(0, U64), cp, start[others], end[others])
        ids, lengths = self.table.ids.gather(rows)
        sums = np.append(0, np.cumsum(lengths))
        at = np.searchsorted(start, np.append(ends - sizes, len(cp)), "left")
        return len(texts), ids, np.diff(sums[at])

    def _learn(self, hashes: np.ndarray, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        data = cp.tobytes()
        words = [data[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(start.tolist(), end.tolist())]
        self.table.add(hashes, *self.encode_words(words), cp[ranges(start, end - start)], end - start)


def library_words(tokenizer) -> Callable:
    """Encodes words with the tokenizers library."""

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))
        return flat, lengths

    return encode


_encoders: dict[tuple[str, str], CachedEncoder] = {}


def library_encoder(path: str) -> CachedEncoder:
    """A cached encoder around the tokenizers library's file at ``path``, one for each worker process.

    Truncation and padding are off. The file's added tokens are taken as the library takes them.
    """
    key = ("library", path)
    if key not in _encoders:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        lower = "Lowercase" in json.dumps(spec["normalizer"])
        _encoders[key] = CachedEncoder(
            word_level_starts if lower else byte_level_starts,
            library_words(tokenizer),
            lambda text: tokenizer.encode(text, add_special_tokens=False).ids,
            [x["content"] for x in spec["added_tokens"]],
            lower,
        )
    return _encoders[key]
