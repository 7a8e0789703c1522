import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from graphlens.llm import exact_dedup, quality, spotsigs, toxicity
from graphlens.llm.queries import table
from tests.llm.test_suffix import brute as repeated_bytes

SF = "/root/testdata/sf0.01"
ODD = [(3, "The cat sat on the mat and the dog ran to a house in the big town " * 3), (None, "n"), (1, None), (7, ""), (9, "!!! ???"), (9, "!!! ???"), (12, "日本 é the " * 50), (20, "word")]


def key(x):
    return (x[0] is not None, x[0] or 0, x[1] or "")


def test_edited_texts(spark):
    got = sorted(spotsigs.edited_texts(spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, head string")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    rows = sorted(ODD, key=key)
    sets = list(spotsigs.signature_sets(pa.array([t or "" for _, t in rows])))
    assert len(got) == len(rows)
    for k, ((doc_id, text), r) in enumerate(zip(rows, got)):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, new, nxt = sets[k], next(spotsigs.signature_sets(pa.array([edited]))), sets[(k + 1) % len(rows)]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (spotsigs.fingerprint(own), spotsigs.fingerprint(new))
        assert (spotsigs.parsed(r.fingerprint) == own).all()
        jaccard = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())) if len(a) + len(b) else 1.0
        assert r.near_edited == pytest.approx(jaccard(own, new)) and r.near_next == pytest.approx(jaccard(own, nxt))
    one = spotsigs.edited_texts(spark.createDataFrame([(4, "to be or not to be")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.edited_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_follow_likeness(spark):
    docs = table(spark, SF, "documents")
    rows = spotsigs.edited_texts(docs).filter("n_chars > 400").toPandas()
    assert rows.near_edited.mean() > rows.near_next.mean() + 0.1
    assert spotsigs.fingerprints(docs).count() == docs.count()
    assert spotsigs.likeness(np.arange(10), np.arange(30), 0.8) == 0.0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").toPandas()
    assert (found.held_out == found.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    held = found[found.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.94
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.4
    assert ((found.score >= 0.3) == (found.predicted == 1)).all()


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in ODD], "doc_id long, text string, score double")
    none = spark.createDataFrame([(3, None), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()] == [0.0] * len(ODD)
    model = toxicity.learn(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert toxicity.score(docs, model).count() == len(ODD) and toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_isotonic_rises():
    at, value = toxicity.isotonic(np.array([3.0, 1, 2, 4, 4]), np.array([0.0, 0, 1, 1, 0]))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()


def test_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = quality.classify(docs).join(labels, "doc_id").toPandas()
    good = found[found.quality == 1]
    assert good.kept.mean() > 0.97
    assert (found.kept == (found.quality == 1)).mean() > 0.93
    out = quality.classify(spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, kept int")).collect()
    assert len(out) == len(ODD) and all(r.score == 0 and not r.kept for r in out if r.doc_id in (1, 7))
    assert quality.classify(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == columns
    toxic = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 1").collect()}
    harmless = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 0").collect()}  # other rows may be either
    kept = {r.doc_id for r in clean.collect()}
    everyone = {r.doc_id for r in docs.collect()}
    assert len(kept & toxic) <= 0.4 * len(everyone & toxic) and len(harmless - kept) <= 0.02 * len(harmless)
    single = corpus_pipeline.drop_copies(spark, clean, SF)
    largest = {}
    for r in clean.collect():
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(largest.values())
    near = corpus_pipeline.drop_near_copies(spark, single, SF)
    assert near.columns == columns and 0 < near.count() <= single.count()
    cut = corpus_pipeline.strip_repeats(spark, near, SF)
    assert cut.columns == columns
    brute = {r[0]: r for r in repeated_bytes([(r.doc_id, r.text) for r in near.collect()], corpus_pipeline.PASSAGE_BYTES)}
    for r in cut.collect():
        assert brute[r.doc_id][1] - len(r.text.encode()) <= brute[r.doc_id][2] and r.n_chars == len(r.text)
    packed = corpus_pipeline.pack(spark, cut, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in cut.collect()}
    assert exact_dedup.report(docs).count() == docs.count()


def test_isotonic_takes_ties_as_one_point():
    at, value = toxicity.isotonic(np.array([-9.0, -9.0, -9.0, 7.0, 7.0]), np.array([0.0, 0.0, 1.0, 1.0, 1.0]))
    assert np.interp(-9.0, at, value) == pytest.approx(1 / 3) and np.interp(7.0, at, value) == 1.0
