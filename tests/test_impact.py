"""Impact against a plain breadth-first reading of small graphs."""

import random

from graphlens.operators import graph


def plain(edges, seed, depth, limit):
    """id: (depth, via, kind) in the order of what was reached before, then calls before extends, then edge order, then id."""
    found, frontier = {}, [seed]
    for hop in range(1, depth + 1):
        best = {}
        for k, at in enumerate(frontier):
            for source, target, kind, seq in edges:
                if target == at and kind in ("calls", "extends") and source != seed and source not in found:
                    key = (k, kind == "extends", seq, at, kind)
                    best[source] = min(best.get(source, key), key)
        frontier = [i for _, i in sorted((best[i][:3], i) for i in best)][: limit - len(found)]
        found |= {i: (hop, best[i][3], best[i][4]) for i in frontier}
    return found


def test_impact_by_plain_walks(spark):
    rng = random.Random(5)
    ids = [f"n{k}" for k in range(14)]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice(["calls", "calls", "extends", "contains"]), k // 2) for k in range(70)]
    edges += [(a, b, "extends" if kind == "calls" else "calls", seq) for a, b, kind, seq in edges[:9] if kind != "contains"]
    df = spark.createDataFrame([(*e, "resolved") for e in edges], "source string, target string, kind string, seq long, provenance string")
    seeds = spark.createDataFrame([(i,) for i in [*ids[:9], ids[0], "none"]], "id string")
    for depth, limit in ((1, 3), (2, 4), (3, 100), (4, 7)):
        got = {}
        for r in graph.impact(df, seeds, depth, limit).collect():
            assert r.id not in got.setdefault(r.seed, {})
            got[r.seed][r.id] = (r.depth, r.via, r.kind)
        assert got == {s: w for s in ids[:9] if (w := plain(edges, s, depth, limit))}, (depth, limit)


def test_a_hop_shuffles_each_of_its_tables_once(spark, monkeypatch):
    """Of two hops: edges twice, seeds, the first hop by its ids, and what the edges reach by seed, with no shuffle of its own for numbers and limits."""
    kept, real = [], graph.stored

    def counted(df, label):
        kept.append(df)
        return real(df, label)

    monkeypatch.setattr(graph, "stored", counted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(300).selectExpr("concat('a', id % 40) AS source", "concat('a', id % 7) AS target", "'calls' AS kind", "id AS seq")
        found = graph.impact(edges, edges.selectExpr("source AS id").distinct(), 2, 5)
        assert found.count() > 0
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in [*kept, found]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(kept) == 1
    assert sum(p.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") for p in plans) <= 7
