import random
import re

from graphlens.llm import minhash_forest
from graphlens.llm.components import components


def brute_components(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in nodes}


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(500)] + ["É", "été", "ÀB", "x y"]
    docs = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 200))]
        docs.append(words)
        for _ in range(rng.randrange(0, 6)):
            copy = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 12) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(copy)
    base = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(150):  # one large group
        docs.append([*base[:60], "only%d" % k, *base[60:]])
    rows = [(k, rng.choice([" ", "\n", "  ", "\t"]).join(w).upper() if k % 7 == 0 else " ".join(w)) for k, w in enumerate(docs)]
    rng.shuffle(rows)
    return rows


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 330)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute_components({x for p in links for x in p}, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rows = [*corpus(4), (9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "ONE two"), (9006, "one"), (9007, "one two three four")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, sig int")
    for width in (4, 5):
        sets = {i: shingles(t, width) for i, t in rows}
        ids = sorted(sets)
        links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = brute_components(ids, links)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(docs, width).collect()}
        assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "q"), (5, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash_forest.near_duplicates(docs, 4).collect()), key=repr)
    want = [(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, 1, None, True), (5, 0, 5, True), (None, 0, None, True)]
    assert got == sorted(want, key=repr)
    assert minhash_forest.near_duplicates(docs.limit(0)).count() == 0
    assert minhash_forest.drop_near_duplicates(docs).columns == docs.columns


def test_rows_of_one_id_and_clashing_columns(spark):
    one, two = "a b c d e f g h", "q r s t u v w x"
    rows = [(5, one, "r", "c"), (5, two, "s", "d"), (2, one, "t", "e"), (5, two, "s", "d"), (None, two, "u", "f"), (None, "z y x w v", "v", "g"), (7, None, "w", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_kept_id` string, class string").withColumnRenamed("class", "th")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, 4, 2), (5, 4, 5), (2, 4, 2), (5, 4, 5), (None, 4, 5), (None, 1, None), (7, 0, 7)], key=repr)
    kept = minhash_forest.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[2], rows[1], rows[5], rows[6]], key=repr)
    assert minhash_forest.drop_near_duplicates(docs.limit(0)).count() == 0


def test_words_of_one_polynomial_hash(spark):
    ones = [bin(k).count("1") % 2 for k in range(2048)]
    rows = [(1, "".join("ab"[x] for x in ones)), (2, "".join("ba"[x] for x in ones)), (3, "word " * 3000 + "x"), (4, "word " * 9000 + "x")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 3), 4: (2, 3)}
