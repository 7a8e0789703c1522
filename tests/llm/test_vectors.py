import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.llm import hard_negatives, vector_codes
from graphlens.llm.vectors import LIMIT

ROWS = "vec_id long, label int, embedding array<float>, score long, anchor string, code string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], ROWS)


def whole(v, width):
    own = [max(-LIMIT, min(LIMIT, math.floor(256.0 * float(np.float32(x))))) for x in v]
    return own + [0] * (width - len(own))


def complete(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def mined(rows, positives, negatives, low, high):
    """Straight from the contract: all scores of every anchor, sorted."""
    rows = [r for r in rows if r[1] is not None and complete(r[2])]
    width = max((len(r[2]) for r in rows), default=0)
    rows = [(r[0], r[1], whole(r[2], width)) for r in rows]
    out, late = [], lambda x: (x[0] is None, x[0] or 0)
    for name in sorted({r[0] for r in rows if r[0] is not None and r[0] % 50 == 0}):
        anchor = min((r for r in rows if r[0] == name), key=lambda r: r[1:])
        others = sorted(((r[0], r[1], sum(a * b for a, b in zip(anchor[2], r[2]))) for r in rows if r[0] != name), key=lambda r: (-r[2], late(r)))
        for positive in [r for r in others if r[1] == anchor[1]][:positives]:
            fit = [r for r in others if r[1] != anchor[1] and low * positive[2] <= 100 * r[2] <= high * positive[2]]
            out += [(name, positive[0], k + 1, r[0], positive[2], r[2]) for k, r in enumerate(fit[:negatives])]
    return sorted(out, key=repr)


def odd_rows(seed, n, width, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (4, width))
    rows = [(k, int(rng.integers(4)), None) for k in range(n)]
    rows = [(k, c, (scale * np.round(centres[c] + rng.normal(0, 0.2, width), 2)).astype(np.float32).tolist()) for k, c, _ in rows]
    rows += [rows[3], rows[3], (50, 1, rows[n - 5][2]), (None, 2, rows[7][2]), (None, 1, rows[8][2]), (n + 1, None, rows[1][2])]
    rows += [(n + 2, 1, None), (n + 3, 1, [None] * width), (n + 4, 1, [float("nan")] * width), (n + 5, 2, [float("inf")] * width), (n + 6, 3, []), (100 * n, 3, rows[5][2][:3])]
    return rows


@pytest.mark.parametrize("scale", [1.0, 3000.0, 1e30])
def test_negatives_are_those_of_all_scores(spark, scale):
    rows = odd_rows(1, 300, 8, scale)
    docs = table(spark, rows).repartition(3)
    got = hard_negatives.mine(docs, F.col("label"), F.col("vec_id") % 50 == 0, anchors=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=repr) == mined(rows, 5, 3, 50, 95)
    other = hard_negatives.mine(docs, F.col("label"), F.col("vec_id") % 50 == 0, positives=2, negatives=1, low=-20, high=120)
    assert sorted(map(tuple, other.collect()), key=repr) == mined(rows, 2, 1, -20, 120)


def test_negatives_of_nothing(spark):
    for rows in ([], [(1, 1, [1.0])], [(50, None, [1.0]), (100, 1, None)], [(50, 1, [])]):
        assert hard_negatives.mine(table(spark, rows), F.col("label"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("high", [3, 300, 1 << 20, LIMIT])
def test_packed_products_are_exact(high):
    rng = np.random.default_rng(high)
    rows, anchors = rng.integers(-high, high + 1, (37, 64)), rng.integers(-high, high + 1, (5, 64))
    packed = hard_negatives.Packed(rows, anchors)
    assert (packed.fields > 1) == (high <= 300)
    want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in rows] for x in anchors]
    assert packed.scores(anchors).tolist() == want


def quantised(rows, parts, entries, rounds):
    """Plain rounds, a distance of every part to every entry."""
    rows = [r for r in rows if complete(r[2])]
    width = -(-max((len(r[2]) for r in rows), default=0) // parts) or 1
    rows = sorted(((r[0], r[1], whole(r[2], parts * width)) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in rows[:entries]] for p in range(parts)]
    gone = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((gone(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[nearest(r[2], p)[1] for r in rows] for p in range(parts)]
        for p in range(parts):
            own = [[cut(r[2], p) for r, k in zip(rows, found[p]) if k == e] for e in range(len(books[p]))]
            books[p] = [[sum(c) // len(v) for c in zip(*v)] if v else books[p][e] for e, v in enumerate(own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(r[0], r[1], [nearest(r[2], p) for p in range(parts)]) for r in rows]
    errors = [sum(d for d, _ in c) for *_, c in coded]
    by_label = {}
    for (_, label, _), e in zip(coded, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((v, "".join(f"{k:02x}" for _, k in c), e, by_label[label], sha) for (v, label, c), e in zip(coded, errors)), key=repr)


@pytest.mark.parametrize("n,width,parts,entries,scale", [(700, 8, 4, 16, 1.0), (300, 10, 4, 64, 1.0), (40, 6, 3, 64, 1.0), (120, 8, 2, 5, 1e30)])
def test_codes_are_those_of_plain_rounds(spark, n, width, parts, entries, scale):
    rows = odd_rows(n, n, width, scale) + [(k, 2, [0.5] * width) for k in range(5, 25)]
    got = vector_codes.quantised(table(spark, rows).repartition(3), parts, entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == quantised(rows, parts, entries, 2)


def test_codes_of_nothing(spark):
    for rows in ([], [(1, 1, None), (2, 1, [float("nan")])]):
        assert vector_codes.quantised(table(spark, rows)).count() == 0
    assert [r.code for r in vector_codes.quantised(table(spark, [(1, None, []), (2, None, [])])).collect()] == ["00" * 16] * 2


def test_whole_nodes_are_taken_and_others_pruned():
    rng = np.random.default_rng(5)
    points, books = rng.integers(-300, 300, (2, 3000, 4)), rng.integers(-300, 300, (2, 64, 4))
    points[:, :1000] = points[:, :1] + rng.integers(0, 3, (2, 1000, 4))
    tree = vector_codes.Boxes(points, 8).with_sums()
    whole_nodes, places, _ = vector_codes.assign(tree, books)
    assert sum(len(node) << (tree.depth - level) for level, node, _ in whole_nodes) * 8 + len(places) == 2 * tree.size
    assert any(level < tree.depth and len(node) for level, node, _ in whole_nodes)
    code, error = vector_codes.codes(tree, books)
    gone = ((points[:, :, None] - books[:, None]) ** 2).sum(axis=3)
    assert (code.T == gone.argmin(axis=2)).all() and (error == gone.min(axis=2).sum(axis=0)).all()
    total, count = vector_codes.sums(tree, books)
    assert (count == [np.bincount(c, minlength=64) for c in code.T]).all() and (total.sum(axis=1) == points.sum(axis=1)).all()
