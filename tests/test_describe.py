"""Descriptions: limits hold for each kind of relation, and the edges are read once a direction."""

from graphlens.operators import context
from graphlens.plans import context_queries


def test_limits_hold_for_each_kind(spark):
    nodes = spark.createDataFrame([(f"g#{k}#x", "function", f"m.f{k}", "f", 1, 1) for k in range(12)], "id string, kind string, qualname string, file string, start_line int, end_line int")
    kinds, rows = ["exemplifies", "tests", "calls"], []
    for k in range(1, 12):
        rows += [(f"g#{k}#x", "g#0#x", kind, "resolved" if k % 2 else "heuristic", 100 - k) for kind in kinds]
    rows += [("g#99#x", "g#0#x", "calls", "resolved", 1), ("g#0#x", "g#5#x", "calls", "heuristic", 2), ("g#0#x", "g#7#x", "calls", "resolved", 3)]
    edges = spark.createDataFrame(rows, "source string, target string, kind string, provenance string, seq long")
    refs = spark.createDataFrame([("s@local:hash:1:g#0#x",), ("s@local:hash:0:g#1#x",), ("s@local:hash:1:g#2#x",)], "ref string")
    sources = spark.createDataFrame([("s", "local:hash:1", "fresh")], "source string, snapshot string, freshness string")
    rules = spark.createDataFrame([("m", "t", ["r"])], "scope string, title string, rules array<string>")
    got = {r.node: r for r in context.describe(refs, sources, nodes, edges, rules).collect()}
    assert set(got) == {"g#0#x", "g#2#x"}
    ids = lambda xs: [x.id.split("#")[1] for x in xs]
    own = got["g#0#x"]
    assert ids(own.examples) == ["11", "10", "9"] and ids(own.tests) == ["11", "10", "9", "8", "7"]
    assert ids(own.callers) == ["11", "9", "7"] and ids(own.callees) == ["7"]
    assert [c.scope for c in own.conventions] == ["m"]
    other = got["g#2#x"]
    assert other.examples is None and other.tests is None and other.callers is None and other.callees is None


def test_edges_are_read_once_a_direction(spark):
    plan = context_queries.describe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_linenumber" in line for line in plan.split("\n")) == 2
