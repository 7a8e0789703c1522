"""Resolution of names that many nodes share and many references import."""

from graphlens.operators import resolve


def test_imports_are_summed_up_before_they_meet_nodes(spark, monkeypatch):
    """200 imports of a name that 50 nodes share are 50 rows, not 10 000, and count as often as they stand."""
    kept, real = {}, resolve.stored

    def counted(df, label):
        out = real(df, label)
        kept[label] = out.count()
        return out

    monkeypatch.setattr(resolve, "stored", counted)
    nodes = spark.range(50).selectExpr("concat('p', lpad(id, 2, '0')) AS id", "'function' AS kind", "'f' AS name", "'m.f' AS qualname", "'x' AS file", "id AS seq")
    imports = spark.range(200).selectExpr("'p00' AS from_node", "'m.f' AS name", "'imports' AS kind", "'a' AS file", "id AS seq")
    calls = spark.range(1).selectExpr("'p00' AS from_node", "'f' AS name", "'calls' AS kind", "'a' AS file", "1000L AS seq")
    found = resolve.ladder(imports.union(calls), nodes).filter("kind = 'calls'").collect()
    assert [(r.target, r.provenance, r.via) for r in found] == [("p01", "heuristic", "import")]
    assert kept["imports"] == 50
