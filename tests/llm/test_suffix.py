import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from graphlens.llm import suffix_dedup


def brute(rows, least):
    raws = [(t or "").encode() for _, t in rows]
    counts = Counter(r[k : k + least] for r in raws for k in range(len(r) - least + 1))
    out = []
    for (doc_id, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for k in range(len(r) - least + 1):
            if counts[r[k : k + least]] > 1:
                gone[k : k + least] = b"\1" * least
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(r)))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((doc_id, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(10, 120))) for _ in range(6)]
    rows = []
    for k in range(140):
        text = ""
        for _ in range(rng.randrange(0, 5)):
            text += "".join(rng.choice("abcdefghij日") for _ in range(rng.randrange(0, 60)))
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                text += p[a : a + rng.randrange(10, 120)] + rng.choice(["", "x", "ab"])
        rows.append((k, text))
    rows += [(900, "a" * 200), (901, None), (902, ""), (903, "b" * 19), (904, "\x00" * 45), (905, "abab" * 30 + "q"), (906, "abab" * 30), (None, rows[3][1]), (None, "zz"), (5, rows[5][1])]
    rows += [(1000 + k, "head%d" % k + passages[0] + "tail%d" % (k * 7)) for k in range(40)]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    for seed, least, together in ((1, 20, 20_000), (2, 33, 10), (3, 8, 50)):
        monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", together)
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, fp int, rid string")
        found = suffix_dedup.report(docs, least, least - least // 3).collect()
        assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(brute(rows, least), key=repr)
        assert sorted(((r.doc_id, r.n_bytes, r.n_passage_bytes) for r in found), key=repr) == sorted((r[:3] for r in brute(rows, least - least // 3)), key=repr)


def test_strip_keeps_columns_and_characters(spark):
    rows = [(1, "é" * 30 + "x", 31, "a"), (2, "y" + "é" * 30, 31, "b"), (3, None, None, "c"), (4, "alone", 5, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, s string")
    out = sorted(map(tuple, suffix_dedup.strip_repeats(docs, 21).collect()))
    assert [r[0] for r in out] == [1, 2, 3, 4] and out[2] == (3, None, None, "c") and out[3] == rows[3]
    assert out[0][1:] == ("x", 1, "a") and out[1][1:] == ("y", 1, "b")
    assert suffix_dedup.report(docs.limit(0)).count() == 0


def test_hot_anchor_is_divided(spark, monkeypatch):
    """One passage with many different surroundings, cut at many places, and no task of more than a few contexts."""
    monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", 5)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(70))
    rows = []
    for k in range(150):
        a, b = sorted((rng.randrange(20), 70 - rng.randrange(20)))
        rows.append((k, "".join(rng.choice("xyz") for _ in range(rng.randrange(50))) + passage[a:b] + "".join(rng.choice("uvw") for _ in range(rng.randrange(50)))))
    for least in (40, 41, 64):
        found = suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"), least, 30).collect()
        assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(brute(rows, least), key=repr)
        assert sorted((r.doc_id, r.n_passage_bytes) for r in found) == sorted((r[0], r[2]) for r in brute(rows, 30))


def test_strip_with_clashing_columns_and_odd_rows(spark):
    rows = [(1, "q" * 30, 1, "a"), (2, "q" * 30, 2, "b"), (None, "", 3, "c"), (None, None, 4, None), (5, "z" * 100_000, 5, "e"), (5, "alone", 6, "f"), (5, "alone", 6, "f")]
    docs = spark.createDataFrame(rows, "dk long, text string, rid int, _spans string").withColumnRenamed("dk", "doc_id").withColumn("dk", F.lit("x")).withColumn("s", F.lit(1))
    out = suffix_dedup.strip_repeats(docs, 20)
    assert out.columns == docs.columns
    want = [(1, "", 1, "a"), (2, "", 2, "b"), (None, "", 3, "c"), (None, None, 4, None), (5, "", 5, "e"), (5, "alone", 6, "f"), (5, "alone", 6, "f")]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(*r, "x", 1) for r in want], key=repr)
    assert suffix_dedup.strip_repeats(docs.limit(0), 20).count() == 0
