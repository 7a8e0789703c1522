"""Very long texts and columns whose names clash with those of the operators, for the operators on single texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphlens.llm import bpe, exact_dedup, licenses, packing, token_store
from graphlens.llm.queries import BYTE_BPE, WORD_BPE

MORE = "h string, n long, start long, ids string, keep_id long, labels string, word string, _group long, piece int, length int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeéß日 ") for _ in range(rng.randrange(1, 9)))
    long = " ".join(word() for _ in range(150_000)) + " Under the MIT license."
    return [(1, long), (2, "z" * 400_000), (3, long), (4, "under the mit license " * 60_000), (5, None), (6, "cc by nc")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "i", 3, "l", "w", 4, 5, 6) for r in rows], f"doc_id long, text string, {MORE}")


def test_exact_dedup(docs, rows):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.report(docs).collect()}
    keep = {1: 3, 3: 3}
    assert got == {k: (keep.get(k, k), 1 + (k in keep), k != 1, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows}
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {2, 3, 4, 5, 6}


def test_licenses(docs, rows):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    phrases = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    for doc_id, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        places = [(i, label) for label, p in phrases.items() for i in range(len(words) - len(p) + 1) if words[i] == p[0] and words[i : i + len(p)] == p]
        r, starts = got[doc_id], [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))


def test_tokens(spark, docs, rows):
    library = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    got = {r.doc_id: r for r in bpe.digests(docs, public_tokenizers.path(BYTE_BPE)).collect()}
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_token_files(docs, rows):
    library, start = Tokenizer.from_file(public_tokenizers.path(WORD_BPE)), 0
    got = {r.doc_id: (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_store.round_trip(docs, public_tokenizers.path(WORD_BPE), 2, "<u2").collect()}
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert got[doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_packing(docs, rows):
    library, used = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE)), {}
    pieces = {}
    for r in packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE)).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own, at = sorted(pieces[doc_id]), 0
        for k, (piece, start, length, crc) in enumerate(own):
            assert (piece, start, crc) == (k, at, zlib.crc32(ids[at : at + length].tobytes())) and (length == 2048 or k == 0)
            at += length
        assert at == len(ids)
    for own in used.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
