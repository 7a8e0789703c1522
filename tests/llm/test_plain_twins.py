"""Features, trees, calibration and stripping against plain readings that share no code with them."""

import math
import re
import zlib

import numpy as np

import corpus_pipeline
from graphlens.llm import toxicity
from graphlens.llm.spotsigs import _hashes

SF = "/root/testdata/sf0.001"
SOUNDS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SECOND = set("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def plain_features(text, lexicon):
    """The 14 densities from the text's words, one by one."""
    size = max(1, len(text.encode()))
    words = re.findall(r"[^\x00-\x23\x25-\x2F\x3A-\x3F\x5B-\x60\x7B-\x7F]+", text)
    read = ["".join(SOUNDS.get(c, c) for c in lower(w)) for w in words]
    weights = [lexicon.get(w, 0.0) for w in read]
    second = [w in SECOND for w in read]
    near = [any(second[j] for j in range(max(0, k - 4), min(len(words), k + 5)) if j != k) for k in range(len(words))]
    disguised = [any(c in SOUNDS for c in w) and any(c.isalpha() or ord(c) > 127 for c in w) for w in words]
    n, hits = max(1, len(words)), [w > 0 for w in weights]
    share = lambda c: text.count(c) / size
    return [
        sum(hits), sum(hits) / n, sum(weights) / n, max(weights, default=0.0), sum(w > 4 for w in weights), sum(h and m for h, m in zip(hits, near)), sum(second) / n,
        sum(disguised) / n, sum(d and h for d, h in zip(disguised, hits)), sum("A" <= c <= "Z" for c in text) / size, share("!"), share("?"), share("*"), math.log1p(n),
    ]


def test_features_word_by_word():
    lexicon = {"idiot": 6.0, "stupid": 5.0, "meh": 2.5}
    hashed = dict(zip(_hashes(list(lexicon)).tolist(), lexicon.values()))
    terms = np.array(sorted(hashed), dtype=np.uint64)
    texts = ["You are an IDIOT, an 1d10t! st*pid? $tup1d", "", "meh meh; the town by the sea", "é tú idiot " * 30, "a b c d e idiot f g h i you", "@$ 44 4ever", "no words! ? *", "u" * 300, "stupid" + " x" * 3 + " your"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = toxicity.features(data, at, terms, np.array([hashed[t] for t in terms.tolist()]))
    assert np.allclose(got, [plain_features(t, lexicon) for t in texts])


def plain_trees(x, y, rounds):
    """Boosting by trying every limit for every node, in plain loops; the log odds after each round."""
    p = min(max(sum(y) / len(y), 1e-4), 1 - 1e-4)
    z = [math.log(p / (1 - p))] * len(y)
    cuts = []
    for f in range(len(x[0])):
        column = np.array([row[f] for row in x])
        own = set(np.quantile(column, np.linspace(0, 1, toxicity.BINS + 1)[1:-1]).tolist())
        above = column[column > column.min()]
        cuts.append(sorted(own | set((np.quantile(above, np.linspace(0, 1, 9)[:-1]) - 1e-12).tolist()) if len(above) else own))
    for _ in range(rounds):
        q = [1 / (1 + math.exp(-v)) for v in z]
        g, h = [a - b for a, b in zip(y, q)], [a * (1 - a) for a in q]
        groups = [list(range(len(y)))]
        for _ in range(toxicity.DEPTH):
            parts = []
            for group in groups:
                best, chosen = 1e-6, None
                score = lambda rows: sum(g[k] for k in rows) ** 2 / (sum(h[k] for k in rows) + 1)
                for f, own in enumerate(cuts):
                    found, place = 0.0, None
                    for c in own:
                        left, right = [k for k in group if x[k][f] <= c], [k for k in group if x[k][f] > c]
                        if sum(h[k] for k in left) >= 1 and sum(h[k] for k in right) >= 1 and (gain := score(left) + score(right) - score(group)) > found + 1e-12:
                            found, place = gain, c
                    if place is not None and found > best:
                        best, chosen = found, (f, place)
                f, c = chosen or (0, math.inf)
                parts += [[k for k in group if x[k][f] <= c], [k for k in group if x[k][f] > c]]
            groups = parts
        for group in groups:
            step = toxicity.RATE * sum(g[k] for k in group) / (sum(h[k] for k in group) + 1)
            for k in group:
                z[k] += step
    return z


def test_later_rounds_are_those_of_plain_loops():
    rng = np.random.default_rng(8)
    x = rng.random((160, 3))
    y = (x[:, 1] + 0.5 * x[:, 2] + 0.3 * rng.random(160) > 0.9).astype(float)
    got = toxicity.log_odds(x, toxicity.grow(x, y, rounds=4))
    assert np.allclose(got, plain_trees(x.tolist(), y.tolist(), 4), atol=1e-9)


def plain_isotonic(z, y):
    """The nearest rising values: the least over later ends of the greatest mean over earlier beginnings (equal z are one point)."""
    kinds = sorted(set(z))
    total = [sum(b for a, b in zip(z, y) if a == k) for k in kinds]
    count = [sum(a == k for a in z) for k in kinds]
    mean = lambda i, j: sum(total[i : j + 1]) / sum(count[i : j + 1])
    return kinds, [max(min(mean(i, j) for j in range(k, len(kinds))) for i in range(k + 1)) for k in range(len(kinds))]


def test_calibration_is_the_nearest_rising_function():
    rng = np.random.default_rng(9)
    z = np.round(rng.normal(0, 1, 80), 1)
    y = (z + rng.normal(0, 1, 80) > 0).astype(float)
    kinds, want = plain_isotonic(z.tolist(), y.tolist())
    at, value = toxicity.isotonic(z, y)
    assert np.allclose(np.interp(kinds, at, value), want)


def test_a_score_is_its_trees_calibrated(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    for r in toxicity.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").limit(60).collect():
        raw = (r.text or "").encode()
        x = toxicity.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model.terms, model.weights)[0]
        z = model.trees[0]
        for splits, value in model.trees[1]:
            node = 0
            for level in splits:
                f, limit = level[node]
                node = 2 * node + int(x[f] > limit)
            z += value[node]
        want = min(1.0, np.interp(z, *model.points) + 1e-6 / (1 + math.exp(-z)))
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_stripping_takes_all_repeats_and_nothing_else(spark):
    """Every character of the pipeline's strip stage on real documents: gone if and only if repeated strings cover all its bytes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, rows = corpus_pipeline.PASSAGE_BYTES, {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen, twice = set(), set()
    for raw in rows.values():
        for k in range(len(raw) - n + 1):
            (twice if (own := hash(raw[k : k + n])) in seen else seen).add(own)
    cut = {r.doc_id: r.text or "" for r in corpus_pipeline.strip_repeats(spark, docs, SF).collect()}
    changed = 0
    for doc_id, raw in rows.items():
        gone = bytearray(len(raw))
        for k in range(len(raw) - n + 1):
            if hash(raw[k : k + n]) in twice:
                gone[k : k + n] = b"\1" * n
        want, at = [], 0
        for c in raw.decode():
            size = len(c.encode())
            if not all(gone[at : at + size]):
                want.append(c)
            at += size
        assert cut[doc_id] == "".join(want)
        changed += bool(sum(gone))
    assert changed > 10
