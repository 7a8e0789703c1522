import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphlens.llm.pretoken import WordTable, library_encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
LIBS = {name: Tokenizer.from_file(P.path(name)) for name in FILES}
ODD = [
    "", " ", "\n", "  a  b\n\n c\t", "don't can't 's 'll we've I'M you'RE x''s 'start it's're", "a   b   c  d",
    "é café İstanbul ΣΑΣ ﬁ ½ ² 123 4,5", "<|endoftext|> x <|endoftext|>y<|startoftext|>", "日本語 テキスト 한국어 ไทย हिन्दी", "\x1c\x1d a\x85b \x00 c", "🙂🙂 👩‍👩‍👧 a🙂b", "a" * 300 + "   ",
    "x\u0085y '́s", " 's", "\n's", "5's 5'd", "K K ſ", "ǅ ŉ ŉ",
]


def ids_of(name, texts):
    out = []
    for _, flat, lengths in library_encoder(P.path(name)).batches(texts):
        at = 0
        for n in lengths.tolist():
            out.append(flat[at : at + n].tolist())
            at += n
    return out


@pytest.mark.parametrize("name", FILES)
def test_same_ids_as_the_library(name):
    lib = LIBS[name]
    rng = random.Random(1)
    words = ["the", "Él", "don't", "--", "42", "naïve", "\n", "  ", "ß", "é", "'s", "'", "İ"]
    texts = ODD + ["".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    assert ids_of(name, texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(name, texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=40), max_size=4))
def test_any_text(texts):
    for name in FILES:
        lib = LIBS[name]
        assert ids_of(name, texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def thue_morse(n):
    """Two words of n letters that a polynomial hash modulo 2**64 can't tell apart (n >= 1024)."""
    ones = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones)


def test_words_of_one_hash():
    texts = [w for n in (1024, 2048, 4096) for w in thue_morse(n)] * 2
    for name in FILES:
        assert ids_of(name, texts) == [LIBS[name].encode(t, add_special_tokens=False).ids for t in texts]


def test_table_finds_what_it_holds():
    table = WordTable(bits=4)
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 2**63, 5000, dtype=np.uint64))
    for part in np.array_split(keys, 7):
        table.add(part, np.arange(len(part), dtype=np.uint32), np.ones(len(part), dtype=np.int64))
    assert sorted(table.find(keys).tolist()) == list(range(len(keys)))
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
