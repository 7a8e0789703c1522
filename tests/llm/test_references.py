"""Fingerprints, weak labels and trees against plain readings that share no code with them."""

import re
from bisect import bisect

import numpy as np
import pytest

from graphlens.llm import quality, spotsigs, suffix_dedup, toxicity

COMMON = set(spotsigs.ANTECEDENTS)


def signatures(text):
    words = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    content = [k for k, w in enumerate(words) if w not in COMMON]
    found = set()
    spots = 0
    for k, w in enumerate(words):
        if w in COMMON:
            at = bisect(content, k)
            after = content[at : at + spotsigs.CHAIN]
            if len(after) == spotsigs.CHAIN:
                spots += 1
                found.add((w, *(words[j] for j in after)))
    if spots < spotsigs.LEAST_SPOTS:
        n = spotsigs.CHAIN + 1
        found = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else {text} if text else set()
    return found


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, "a cat"), (10**6 + 1, None), (10**6 + 2, "!!"), (10**6 + 3, "the cat"), (10**6 + 4, "the cat sat " * 40_000)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.union(odd).collect()))
    got = {r.doc_id: r for r in spotsigs.edited_texts(docs.union(odd)).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own = signatures(text)
        assert got[i].near_edited == pytest.approx(likeness(own, signatures(edited))), i
        assert got[i].near_next == pytest.approx(likeness(own, signatures(following))), i
        assert int(got[i].fingerprint.split(":")[0]) == len(own)


def test_label_model_row_by_row():
    """Expectation-maximisation over rows instead of patterns, with the same smoothing."""
    rng = np.random.default_rng(4)
    n, k = 1500, len(quality.LABELLERS)
    truth = rng.random(n) < 0.6
    right = np.linspace(0.6, 0.95, k)
    seen = np.where(rng.random((n, k)) < 0.3, 0, np.where(rng.random((n, k)) < right, truth[:, None] + 1, 2 - truth[:, None]))
    numbers = (seen * 3 ** np.arange(k - 1, -1, -1)).sum(axis=1)
    patterns, back, counts = np.unique(numbers, return_inverse=True, return_counts=True)
    p, accuracy = quality.estimate(patterns, counts.astype(float))
    q = ((seen == 2).sum(axis=1) + 1) / ((seen == 2).sum(axis=1) + 3 * (seen == 1).sum(axis=1) + 2)
    for _ in range(60):
        share = (q.sum() + 1) / (n + 2)
        good, bad = np.log(np.full(n, share)), np.log(np.full(n, (1 - q).sum() + 1) / (n + 2))
        for j in range(k):
            for weight, log in ((q, good), (1 - q, bad)):
                told = np.array([weight[seen[:, j] == v].sum() + 1 for v in range(3)])
                log += np.log(told / told.sum())[seen[:, j]]
        new = 1 / (1 + np.exp(bad - good))
        done, q = np.abs(new - q).max() < 1e-9, new
        if done:
            break
    assert np.allclose(p[back], q, atol=1e-6)
    assert (((p[back] > 0.5) == truth).mean() > 0.9) and np.corrcoef(accuracy, right)[0, 1] > 0.9


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(2)
    x = np.round(rng.random((400, 3)), 2)
    y = (x[:, 1] + 0.2 * rng.random(400) > 0.6).astype(float)
    start, trees = toxicity.grow(x, y, rounds=3)
    p = y.mean()
    g, h = y - p, np.full(400, p * (1 - p))
    gain = lambda left: g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
    feature, limit = trees[0][0][0][0]
    best = max(gain(x[:, f] <= c) for f in range(3) for c in np.unique(x[:, f])[:-1])
    assert feature == 1 and gain(x[:, 1] <= limit) > 0.97 * best
    z = toxicity.log_odds(x, [start, trees])
    assert ((z > 0) == (y > 0)).mean() > 0.9 and start == pytest.approx(np.log(p / (1 - p)))


def test_very_long_texts_score(spark):
    docs = spark.createDataFrame([(1, "word and the other " * 80_000), (2, "you idiot " * 60_000), (3, None)], "doc_id long, text string")
    assert quality.classify(docs).count() == 3
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == 3
    assert suffix_dedup.report(docs).count() == 3


def test_similar_documents_by_signatures(spark):
    """Classes over all pairs, with a large group of near copies, texts of one id, and sets at the limit."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(300)] + ["the", "and", "of", "in"] * 40
    text = lambda n: [str(w) for w in rng.choice(words, n)]
    rows = [(k, t) for k, t in enumerate([text(int(n)) for n in rng.integers(1, 200, 60)])]
    for k in range(60):
        own = list(rows[int(rng.integers(0, 60))][1])
        for _ in range(int(rng.integers(0, 12))):
            own[int(rng.integers(0, len(own)))] = str(rng.choice(words))
        rows.append((100 + k, own))
    base = text(150)
    for k in range(120):
        own = list(base)
        for at in rng.integers(0, 150, 6):
            own[int(at)] = f"x{k}y{at}"
        rows.append((300 + k, own))
    rows = [(i, " ".join(t)) for i, t in rows] + [(3, "the other text of an id and the rest of it in the end of the day"), (None, " ".join(base)), (900, None), (901, ""), (902, "!!")]
    sets = [signatures(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min((x for x in (least.get(root(k)), i) if x is not None), default=None)
    want = sorted(((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)), key=repr)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int")
    assert sorted(map(tuple, spotsigs.similar_classes(docs).collect()), key=repr) == want
    assert spotsigs.similar_classes(docs.limit(0)).count() == 0
