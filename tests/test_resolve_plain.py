"""The ladder of rules against a plain reading of them, over names that many nodes and files share."""

import random

from graphlens.operators import resolve
from graphlens.schemas import CALLABLE_KINDS, MODULE_KINDS, TYPE_KINDS

KINDS = ["function", "method", "test", "class", "enum", "module", "package", "constant"]


def some_graph(seed=3):
    rng = random.Random(seed)
    nodes = []
    for k in range(60):
        kind, owner = rng.choice(KINDS), rng.choice(["x", "x.m", "y.m", "y", "z.n"])
        name = rng.choice(["m", "n"]) if kind in MODULE_KINDS else rng.choice("abcde")
        nodes.append((f"n{k:02}", kind, name, f"{owner}.{name}", rng.choice(["f1", "f2", "f3"]), k))
    modules, names = ["x.m", "y.m", "z.n", "x.n"], [n[3] for n in nodes]
    refs = []
    for k in range(700):
        kind = rng.choice(["imports", "calls", "calls", "extends", "references"])
        if kind == "imports":
            name = rng.choice([rng.choice(names), rng.choice(modules), ".m", "..x.m", ".a"])
        else:
            name = rng.choice([rng.choice("abcdem"), "m." + rng.choice("abcde"), "n." + rng.choice("abc"), "x.m." + rng.choice("abcde"), rng.choice(names), "self", "no.such"])
        refs.append((rng.choice(nodes)[0] if rng.random() < 0.95 else "gone", name, kind, rng.choice(["f1", "f2", "f4", None]), 10_000 - 7 * k))
    return nodes, refs


def plainly(nodes, refs):
    of, found, known, by_id = {}, {}, [], {n[0]: n for n in nodes}
    last = lambda name: name.rpartition(".")[2]
    for ref in refs:
        importer, name, kind, file, seq = ref
        if kind == "imports":
            dots = len(name) - len(name.lstrip("."))
            if dots:
                parts = by_id[importer][3].split(".") if importer in by_id else None
                keep = parts and parts[: max(0, len(parts) - (by_id[importer][1] != "package") - (dots - 1))]
                name = "" if parts is None else ".".join(filter(None, [".".join(keep), name[dots:]]))
            of[seq] = name
            known += [(file, last(name), n, name, seq) for n in nodes if n[3] == name and file is not None]
    some = lambda own, ids: [i for i in ids if i != own]
    how = lambda ids: "resolved" if len(ids) == 1 else "heuristic"

    def call(own, name, file):
        end, module = last(name), last(name.rpartition(".")[0])
        owners = {}
        for f, segment, n, qualname, seq in known:
            if f == file and "." in name and segment == module and n[1] in MODULE_KINDS:
                owners[qualname] = min(seq, owners.get(qualname, seq))
        for owner in sorted(owners, key=owners.get):
            ids = some(own, [n[0] for n in nodes if n[1] in CALLABLE_KINDS and f"{n[3].rpartition('.')[0]}.{n[2]}" == f"{owner}.{end}"])
            if ids:
                return min(ids), how(ids), "import"
        for kinds in (CALLABLE_KINDS, TYPE_KINDS):
            ids = some(own, [n[0] for f, segment, n, *_ in known if f == file and segment == end and n[1] in kinds])
            if ids:
                return min(ids), how(ids), "import"
        ids = some(own, [n[0] for n in nodes if n[1] in TYPE_KINDS and n[2] == end])
        if len(ids) == 1:
            return ids[0], "resolved", None
        able = [n for n in nodes if n[1] in CALLABLE_KINDS and n[2] == end]
        ids = some(own, [n[0] for n in able if n[4] == file]) or some(own, [n[0] for n in able])
        return (ids[0], "heuristic", None) if len(ids) == 1 else None

    def nearest(able, file):
        return min([n[0] for n in able if n[4] == file] or [n[0] for n in able], default=None)

    for own, name, kind, file, seq in refs:
        edge = None
        if name in resolve.IGNORED:
            continue
        if kind == "calls":
            edge = call(own, name, file)
        elif kind == "extends":
            types = [n for n in nodes if n[1] in TYPE_KINDS]
            exact, loose = nearest([n for n in types if n[3] == name], file), nearest([n for n in types if n[2] == last(name)], file)
            edge = (exact, "resolved", None) if exact else (loose, "heuristic", None) if loose else None
        elif kind == "imports":
            edge = nearest([n for n in nodes if n[3] == of[seq]], file)
            edge = edge and (edge, "resolved", None)
        if edge:
            found[seq] = (own, edge[0], kind, edge[1], edge[2], file)
    return found


def test_ladder_as_a_plain_reading_finds_it(spark):
    nodes, refs = some_graph()
    of_nodes = spark.createDataFrame(nodes, "id string, kind string, name string, qualname string, file string, seq long")
    of_refs = spark.createDataFrame(refs, "from_node string, name string, kind string, file string, seq long")
    want = plainly(nodes, refs)
    assert {(e[2], e[3], e[4]) for e in want.values()} >= {("calls", "resolved", "import"), ("calls", "heuristic", "import"), ("calls", "heuristic", None), ("extends", "heuristic", None), ("imports", "resolved", None)}
    rows = resolve.ladder(of_refs, of_nodes).collect()
    got = {r.seq: (r.source, r.target, r.kind, r.provenance, r.via, r.file) for r in rows}
    assert len(got) == len(rows) and got == want


def test_nodes_are_stored_once_however_many_files_import_them(spark, monkeypatch):
    """40 files that import a name of 50 nodes leave 50 rows and one pool, not 2 000; a file's own count of candidates stays."""
    kept, real = {}, resolve.stored

    def counted(df, label):
        out = real(df, label)
        kept[label] = out.count()
        return out

    monkeypatch.setattr(resolve, "stored", counted)
    nodes = spark.range(50).selectExpr("concat('p', lpad(id, 2, '0')) AS id", "'function' AS kind", "'f' AS name", "'m.f' AS qualname", "'x' AS file", "id AS seq")
    imports = spark.range(40).selectExpr("'p00' AS from_node", "'m.f' AS name", "'imports' AS kind", "concat('a', id) AS file", "id AS seq")
    calls = spark.range(40).selectExpr("'p00' AS from_node", "'f' AS name", "'calls' AS kind", "concat('a', id) AS file", "1000 + id AS seq")
    found = resolve.ladder(imports.union(calls), nodes).filter("kind = 'calls'").collect()
    assert len(found) == 40 and {(r.target, r.provenance, r.via) for r in found} == {("p01", "heuristic", "import")}
    assert kept["imports"] == 50 and max(kept.values()) == 80
