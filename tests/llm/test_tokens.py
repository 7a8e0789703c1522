import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from graphlens.llm import bpe, packing, token_store

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ROWS = [
    (3, "Hello  world, it's 42 o'clock\n\n<|endoftext|> naïve 日本", "x"), (1, None, "y"), (2, "", "x"), (None, "null id", None),
    (5, "aaaa aaaaaaa   aaaaaaaaaaaaaaaaaaaaaaaaaa", "x"), (5, "aaaa aaaaaaa   aaaaaaaaaaaaaaaaaaaaaaaaaa", "x"), (7, "long words " * 3000, "z"), (-4, "minus", "z"),
]
SCHEMA = "doc_id long, text string, ids string"


def le(ids):
    return np.array(ids, dtype="<u4").tobytes()


def key(x):
    return (x is not None, x or 0)


def test_bpe_round_trip(spark):
    lib = Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, bpe.digests(spark.createDataFrame(ROWS, SCHEMA), BYTE).collect()), key=lambda r: (key(r[0]), r))
    want = []
    for doc_id, text, _ in ROWS:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: (key(r[0]), r))
    assert bpe.digests(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_bpe_words_equal_the_library(spark):
    lib, (model, _) = Tokenizer.from_file(BYTE), bpe.model(BYTE)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé日 tT'1!\x00") for _ in range(rng.randrange(1, 30))) for _ in range(500)] + ["a" * n for n in range(1, 40)]
    for w in words:
        for part, _ in lib.pre_tokenizer.pre_tokenize_str(w):
            raw = bytes({c: b for b, c in bpe.byte_symbols().items()}[c] for c in part)
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            assert model.encode_words([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_store(spark, tmp_path):
    lib = Tokenizer.from_file(WORD)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_store.round_trip(docs, WORD, 2).collect()]
    rows.sort(key=lambda r: r[1])
    at = 0
    for (doc_id, start, n, ids), (want_id, text, _) in zip(rows, sorted(ROWS, key=lambda r: key(r[0]))):
        want = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        assert (doc_id, start, n, ids) == (want_id, at, len(want), le(want))
        at += n
    assert token_store.round_trip(docs.limit(0), WORD, 2).count() == 0


def test_variable_length_values():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_store.encode_values(values)
        assert len(control) == -(-n // 4)
        assert (token_store.decode_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == values).all()


def check_packing(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_of_documents(spark):
    lib = Tokenizer.from_file(BYTE)
    rows = packing.pack_documents(spark.createDataFrame(ROWS, SCHEMA), BYTE, most=64).collect()
    check_packing(rows, 64)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc_id, text, _ in ROWS:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]})
        cut = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        assert own == [(k, a, b - a, zlib.crc32(le(ids[a:b]))) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    assert len(by_doc[5]) == 2 * len({r.piece for r in by_doc[5]})
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_packing_in_levels_is_tight(spark):
    rng = random.Random(5)
    sizes = [min(2048, int(rng.expovariate(1 / 500)) + 1) for _ in range(3000)]
    rows = packing.pack(spark.createDataFrame([(i, s, -1) for i, s in enumerate(sizes)], "doc_id long, length long, offset long"), 2048, group_pieces=100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    assert check_packing(rows, 2048) <= math.ceil(sum(sizes) / 2048) * 1.005 + 1


def test_local_search_empties_bins():
    lengths = [6, 5, 5, 4]  # 6 + 5 don't fit in 10; 6 + 4 and 5 + 5 do
    assert len(packing.local_search([[0], [1, 3], [2]], lengths, 10)) == 2
    assert len(packing.local_search([[0, 1], [2, 3, 4]], [7, 1, 3, 3, 4], 10)) == 2
    for seed in range(50):
        rng = random.Random(seed)
        sizes = [rng.randrange(1, 101) for _ in range(60)]
        before = packing.best_fit(sizes, 100)
        after = packing.local_search([list(b) for b in before], sizes, 100)
        assert sorted(i for b in after for i in b) == list(range(60)) and len(after) <= len(before)
        assert all(sum(sizes[i] for i in b) <= 100 for b in after)
