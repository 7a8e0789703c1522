"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round finds the rank of each neighbouring pair
by binary search over the sorted pair keys, takes the lowest rank of each word, merges all its
places at once, and drops the words that have no pair left. Words are deduplicated first
(``pretoken``), so that a batch costs as much as its new words.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows give
repeated results; a null ``doc_id`` stays null; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, with_fields
from .pretoken import CachedEncoder, byte_level_starts

_NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that print as themselves in Latin-1 do so; the others take the code points from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class ByteBPE:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        bytes_of = {c: b for b, c in symbols.items()}
        self.byte_ids = np.array([vocab.get(symbols[b], -1) for b in range(256)], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        parts = [b""] * size
        for token, i in vocab.items():
            parts[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()
        for content, i in self.added.items():
            parts[i] = content.encode()
        self.token_lengths = np.fromiter(map(len, parts), np.int64, size)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self._plain = CachedEncoder(byte_level_starts, self.encode_words, self.encode_text, [])
        self.token_bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], _NO_RANK)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        rank = np.full(len(symbol), _NO_RANK)
        if len(symbol) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self._ranks(symbol[:-1], symbol[1:]), _NO_RANK)
        done_words, done_symbols = [], []
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(np.append(first, len(word))))
            over = best == _NO_RANK
            if over.any():
                done_words.append(word[over])
                done_symbols.append(symbol[over])
                symbol, word, rank, best = symbol[~over], word[~over], rank[~over], best[~over]
                if not len(symbol):
                    break
            hit = rank == best
            begins = hit & ~np.append(False, hit[:-1])
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            hit &= since % 2 == 0  # of overlapping places, the leftmost
            at = np.flatnonzero(hit)
            symbol[at] = self.made[best[at]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            again = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            rank[again] = _NO_RANK
            inner = again[again + 1 < len(word)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self._ranks(symbol[inner], symbol[inner + 1])
        if not done_words:
            return np.zeros(0, np.uint32), sizes
        word, symbol = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.uint32), np.bincount(word, minlength=len(raw))

    def encode_text(self, text: str) -> np.ndarray:
        """Ids of a text that holds added tokens, which are found first, leftmost and longest."""
        import regex

        parts = regex.split("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")", text)
        out = []
        for part in parts:
            if part in self.added:
                out.append(np.array([self.added[part]], dtype=np.uint32))
            elif part:
                out += [ids for _, ids, _ in self._plain.batches([part])]
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, by table lookup."""
        lengths = self.token_lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return b""
        at = np.repeat(self.token_starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.token_bytes[at].tobytes()


_models: dict[str, tuple[ByteBPE, CachedEncoder]] = {}


def model(path: str) -> tuple[ByteBPE, CachedEncoder]:
    """The model at ``path`` and its cached encoder, one for each worker process."""
    if path not in _models:
        bpe = ByteBPE(path)
        _models[path] = bpe, CachedEncoder(byte_level_starts, bpe.encode_words, bpe.encode_text, list(bpe.added))
    return _models[path]


def id_batches(batches: Iterator[pa.RecordBatch], encoder: CachedEncoder, end: int | None = None, width: str = "<u4") -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids as little-endian binary) of batches of (doc_id, text); ``end`` is appended to each document."""
    for batch in batches:
        doc_ids, column, at = batch.column(0), batch.column(1).to_pylist(), 0
        for n, ids, lengths in encoder.batches(column):
            if end is not None:
                ids = np.insert(ids, np.cumsum(lengths), end)
                lengths = lengths + 1
            item = np.dtype(width).itemsize
            offsets = np.append(0, np.cumsum(lengths * item)).astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype(width).tobytes())])
            yield pa.RecordBatch.from_arrays([doc_ids.slice(at, n), pa.array(lengths, pa.int64()), data], ["doc_id", "n_tokens", "ids"])
            at += n


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every whole text."""

    def run(batches):
        yield from id_batches(batches, model(path)[1])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _decoded(batches: Iterator[pa.RecordBatch], bpe: ByteBPE) -> Iterator[pa.RecordBatch]:
    """The batches with ``text``, read from their ``ids``."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        out = [None if not x.is_valid else bpe.decode(np.frombuffer(x.as_buffer(), dtype="<u4")).decode("utf-8", "replace") for x in ids]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text``, decoded from ``ids``; bytes that aren't UTF-8 become U+FFFD."""

    def run(batches):
        yield from _decoded(batches, model(path)[0])

    kept = encoded.drop("text")
    return kept.mapInArrow(run, with_fields(kept.schema, "text string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Round trip of every text: counts and hashes of its ids and of what they decode to.

    One worker encodes a block of texts and decodes its ids, so that a task holds the model once and ids aren't sent twice.
    """

    def run(batches):
        bpe, encoder = model(path)
        yield from _decoded(id_batches(batches, encoder), bpe)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string").select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
