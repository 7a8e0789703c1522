import random

from graphlens.llm import minhash_forest
from tests.llm.test_near import brute_components, shingles


def template_corpus(n=700, pairs=120):
    """Forms with 12 fields: most are 0.73 alike; rows k and k + n / 2 share 4 fields (0.81) or, from ``pairs`` on, 3 (0.79)."""
    rng = random.Random(8)
    base = ["w%d" % k for k in range(392)]
    fields = list(range(20, 380, 30))
    rows = []
    for k in range(n):
        words, twin = list(base), k % (n // 2)
        shared = set(random.Random(twin).sample(range(12), 4 if twin < pairs else 3))
        for f, at in enumerate(fields):
            words[at] = f"v{twin}f{f}" if f in shared else f"v{k}g{f}"
        rows.append((k, " ".join(words)))
    rng.shuffle(rows)
    return rows


def test_links_inside_a_large_region(spark):
    rows = template_corpus()
    sets = {i: shingles(t, 5) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) == 120
    want = brute_components(ids, links)
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in ids if got[i] != want[i]} == set()


def test_crowded_pairs_hold_all_links(spark):
    """Sets of many sizes, of few classes, on the join alone; blocks are forced for frequent shingles."""
    rng = random.Random(3)
    words = ["w%d" % k for k in range(90)]
    rows = []
    for k in range(400):
        own = words[: rng.randrange(30, 90)]
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((k, " ".join(own), k % 7))
    sets = {i: shingles(t, 5) for i, t, _ in rows}
    links = {(a, b) for a in range(400) for b in range(a + 1, 400) if a % 7 != b % 7 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    block, minhash_forest.CROWD = minhash_forest.CROWD, 50
    try:
        got = {(r.a, r.b) for r in minhash_forest.crowded_pairs(spark.createDataFrame(rows, "id long, text string, class long"), 5, 80).collect()}
    finally:
        minhash_forest.CROWD = block
    assert len(links) > 1000 and links <= got and all(a % 7 != b % 7 for a, b in got)
