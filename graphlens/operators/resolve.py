"""Name resolution as a priority ladder of joins.

Candidates are summed up by key before references join them: how many there are and the two smallest ids with how often
each stands, which is what self-exclusion needs. So a name that thousands of nodes share costs one row, and references are dealt once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from graphlens.schemas import CALLABLE_KINDS, MODULE_KINDS, TYPE_KINDS
from graphlens.storage import stored

#: References to these names are passed over.
IGNORED = ["", "self", "cls", "super"]


def last_segment(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.]*)$", 1)


def absolute_names(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``absolute``: names with leading dots are taken from the importer's qualified name.

    A package keeps its own parts and a module drops its last; each dot after the first drops one more; where nothing is left to drop the rest stands alone; an unknown importer gives ''.
    """
    importer = nodes.select(F.col("id").alias("from_node"), F.split("qualname", r"\.").alias("_parts"), (F.col("kind") == "package").alias("_package"))
    rows = refs.join(importer, "from_node", "left")
    dots = F.length(F.regexp_extract("name", r"^(\.*)", 1))
    keep = F.size("_parts") - F.when(F.col("_package"), 0).otherwise(1) - (dots - 1)
    tail = F.expr("substring(name, length(regexp_extract(name, '^(\\\\.*)', 1)) + 1)")
    base = F.array_join(F.slice("_parts", F.lit(1), F.greatest(keep, F.lit(0))), ".")
    relative = F.when(F.col("_parts").isNull(), "").otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(tail, F.lit(""))))
    return rows.withColumn("absolute", F.when(F.col("name").startswith("."), relative).otherwise(F.col("name"))).drop("_parts", "_package")


def import_map(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """file, segment, id, kind, qualname, seq: nodes that a file imports; importing one twice counts twice."""
    imports = absolute_names(refs.filter("kind = 'imports'"), nodes).select("file", "absolute", "seq")
    found = imports.join(nodes.select(F.col("qualname").alias("absolute"), "id", "kind"), "absolute")
    return found.select("file", last_segment(F.col("absolute")).alias("segment"), "id", "kind", F.col("absolute").alias("qualname"), "seq")


def imported_names(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """file, absolute, seq, times: each name that a file imports, its first ``seq`` and how often it is there."""
    return _absolute_imports(refs, nodes).groupBy("file", "absolute").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("times"))


def imported_nodes(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """absolute, id, kind: the nodes of ``imported_names``, once each, however many files import them."""
    return nodes.select(F.col("qualname").alias("absolute"), "id", "kind").join(names.select("absolute"), "absolute", "left_semi")


def _absolute_imports(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The imports with ``absolute``; only those with leading dots meet their importer."""
    imports = refs.filter("kind = 'imports'").select("from_node", "name", "kind", "file", "seq")
    dots = F.col("name").startswith(".")
    return absolute_names(imports.filter(dots), nodes).unionByName(imports.filter(~dots).withColumn("absolute", F.col("name")))


def _alone(nodes: DataFrame, *keys) -> DataFrame:
    """keys, pool: each node as a pool of its own."""
    none = F.struct(F.lit(1).cast("long").alias("n"), F.col("id").alias("first"), F.lit(1).cast("long").alias("n_first"), F.lit(None).cast("string").alias("second"), F.lit(None).cast("long").alias("n_second"))
    return nodes.select(*keys, none.alias("pool"))


def pools(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pool: pools put together by key: the number of candidates (n), the two smallest ids (first, second) and how often each stands (n_first, n_second).

    The two smallest ids of all are among the two smallest of each part, so that pools of finer keys can be put together again.
    """
    two = F.array(F.struct(F.col("pool.first").alias("id"), F.col("pool.n_first").alias("times")), F.struct(F.col("pool.second").alias("id"), F.col("pool.n_second").alias("times")))
    ids = parts.select(*keys, F.inline(F.filter(two, lambda x: x["id"].isNotNull()))).groupBy(*keys, "id").agg(F.sum("times").alias("times"))
    ranked = ids.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).filter("k <= 2")
    own = F.struct("id", "times")
    firsts = ranked.groupBy(*keys).agg(F.min(own).alias("a"), F.max(F.when(F.col("k") == 2, own)).alias("b"))
    whole = parts.groupBy(*keys).agg(F.sum("pool.n").alias("n")).join(firsts, keys)
    return whole.select(*keys, F.struct("n", F.col("a.id").alias("first"), F.col("a.times").alias("n_first"), F.col("b.id").alias("second"), F.col("b.times").alias("n_second")).alias("pool"))


def _left(pool: Column) -> Column:
    """How many candidates there are but the reference's own node; where three ids or more are, two at least."""
    node = F.col("from_node")
    own = F.when(pool["first"] == node, pool["n_first"]).when(pool["second"] == node, pool["n_second"]).otherwise(0)
    return F.coalesce(pool["n"] - own, F.lit(0))


def _picked(pool: Column, provenance: Column, via: str | None = None) -> Column:
    """The edge to the smallest id but the reference's own node."""
    target = F.when(pool["first"] == F.col("from_node"), pool["second"]).otherwise(pool["first"])
    return F.struct(target.alias("target"), provenance.alias("provenance"), F.lit(via).cast("string").alias("via"))


def _one_or_more(pool: Column) -> Column:
    return F.when(_left(pool) == 1, "resolved").otherwise("heuristic")


def _by_what(parts: DataFrame, keys: list[str], whats: list[str]) -> DataFrame:
    """keys and a column for each of ``whats``: the pool of the parts that are so."""
    found = pools(parts, ["what", *keys])
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("what") == x, F.col("pool"))).alias(x) for x in whats])


def _through(cases: DataFrame, nodes: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """file, name, through, through_next: of dotted names the callables in the first imported module that has such, and in the first that has others than that one, for the reference in it."""
    dotted = cases.filter(F.instr("name", ".") > 0).withColumn("module", F.regexp_extract("name", r"([^.]*)\.[^.]*$", 1))
    modules = names.join(known.filter(F.col("kind").isin(MODULE_KINDS)).select("absolute"), "absolute", "left_semi")
    modules = modules.select("file", last_segment(F.col("absolute")).alias("module"), F.col("absolute").alias("owner"), "seq")
    callables = nodes.filter(F.col("kind").isin(CALLABLE_KINDS))
    wholes = pools(_alone(callables, F.concat_ws(".", F.regexp_extract("qualname", r"^(.*)\.[^.]*$", 1), "name").alias("whole")), ["whole"])
    rows = dotted.join(modules, ["file", "module"]).withColumn("whole", F.concat_ws(".", "owner", "segment")).join(wholes, "whole")
    place = F.struct("seq", F.col("pool.first").alias("id"), "pool")
    rows = rows.withColumn("lead", F.first("pool").over(W.partitionBy("file", "name").orderBy("seq", "pool.first")))
    same = F.col("pool.second").isNull() & F.col("lead.second").isNull() & (F.col("pool.first") == F.col("lead.first"))
    found = rows.groupBy("file", "name").agg(F.min(place).alias("a"), F.min(F.when(~same, place)).alias("b"))
    return found.select("file", "name", F.col("a.pool").alias("through"), F.col("b.pool").alias("through_next"))


def _near(cases: DataFrame, nodes: DataFrame, names: DataFrame | None, known: DataFrame | None, whats: list[str]) -> DataFrame:
    """Adds pools by file and segment: callables and types that the file imports (as often as it does), callables that it has."""
    parts = []
    if known is not None:
        what = F.when(F.col("kind").isin(CALLABLE_KINDS), "imported").when(F.col("kind").isin(TYPE_KINDS), "imported_type")
        own = pools(_alone(known.withColumn("what", what).filter(F.col("what").isin(whats)), "what", "absolute"), ["what", "absolute"])
        pool = F.struct(*[(F.col(f"pool.{c}") * F.col("times") if c.startswith("n") else F.col(f"pool.{c}")).alias(c) for c in ("n", "first", "n_first", "second", "n_second")])
        parts.append(names.join(own, "absolute").select("what", "file", last_segment(F.col("absolute")).alias("segment"), pool.alias("pool")))
    if "near" in whats:
        parts.append(_alone(nodes.filter(F.col("kind").isin(CALLABLE_KINDS)), F.lit("near").alias("what"), "file", F.col("name").alias("segment")))
    return cases.join(_by_what(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), ["file", "segment"], whats), ["file", "segment"], "left")


def _far(cases: DataFrame, nodes: DataFrame, whats: list[str]) -> DataFrame:
    """Adds pools by segment alone: callables (far) and types (type) of that name."""
    what = F.when(F.col("kind").isin(CALLABLE_KINDS), "far").when(F.col("kind").isin(TYPE_KINDS), "type")
    parts = _alone(nodes.withColumn("what", what).filter(F.col("what").isin(whats)), "what", F.col("name").alias("segment"))
    return cases.join(_by_what(parts, ["segment"], whats), "segment", "left")


#: Each rule's edge of a call, from the pools of its file and name.
def _scoped_edge() -> Column:
    return F.coalesce(*[F.when(_left(F.col(c)) > 0, _picked(F.col(c), _one_or_more(F.col(c)), "import")) for c in ("through", "through_next", "imported")])


def _type_edge() -> Column:
    own, any_ = F.col("imported_type"), F.col("type")
    return F.when(_left(own) > 0, _picked(own, _one_or_more(own), "import")).when(_left(any_) == 1, _picked(any_, F.lit("resolved")))


def _named_edge() -> Column:
    near, far = F.col("near"), F.col("far")
    single = F.when(_left(near) == 1, _picked(near, F.lit("heuristic")))
    return F.when(_left(near) > 0, single).when(_left(far) == 1, _picked(far, F.lit("heuristic")))


def _cases(refs: DataFrame) -> DataFrame:
    """file, name, segment: what the rules look at, once for all references that are alike."""
    return refs.select("file", "name").distinct().withColumn("segment", last_segment(F.col("name")))


#: Rows of looked up names for each shuffle partition, up to which they are hashed there; more are sorted and merged.
_HASHED = 20_000


def _edges(refs: DataFrame, cases: DataFrame, edge: Column, key: str = "name") -> DataFrame:
    """The references with an edge, which is made of what stands for their file and name; a file may be null."""
    of = stored(cases.drop("segment").withColumnsRenamed({"file": "_file", key: "_key"}), "cases")
    few = of.count() <= _HASHED * int(of.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = refs.alias("r").join(of.hint("shuffle_hash" if few else "merge"), (F.col(f"r.{key}") == F.col("_key")) & F.col("r.file").eqNullSafe(F.col("_file")))
    made = F.inline(F.array_compact(F.array(edge)))  # once a row, where a filter would have it made again
    return rows.select("seq", F.col("from_node").alias("source"), "kind", "file", made).select("seq", "source", "target", "kind", "provenance", "via", "file")


def _of_kind(refs: DataFrame, kind: str) -> DataFrame:
    return refs.filter(F.col("kind") == kind).select("from_node", "name", F.lit(kind).alias("kind"), "file", "seq")


def _stored_kinds(refs: DataFrame, *kinds: str) -> DataFrame:
    return stored(refs.filter(F.col("kind").isin(*kinds)).select("from_node", "name", "kind", "file", "seq"), "refs")


def _known(refs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = stored(imported_names(refs, nodes), "names")
    return names, stored(imported_nodes(names, nodes), "imports")


def import_scoped_calls(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls through what the file imports: dotted names through the first imported module with such a callable, else by last segment."""
    real = _stored_kinds(refs, "imports", "calls")
    names, known = _known(real, nodes)
    calls = _of_kind(real, "calls")
    cases = _cases(calls)
    found = _near(cases, nodes, names, known, ["imported"]).join(_through(cases, nodes, names, known), ["file", "name"], "left")
    return _edges(calls, found, _scoped_edge())


def instantiations(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls of types: imported by last segment, else where the name is the snapshot's only type of that name."""
    real = _stored_kinds(refs, "imports", "calls")
    names, known = _known(real, nodes)
    calls = _of_kind(real, "calls")
    return _edges(calls, _far(_near(_cases(calls), nodes, names, known, ["imported_type"]), nodes, ["type"]), _type_edge())


def callable_fallback(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls by name alone: the file's callables of that name if any, else all; only where exactly one is left."""
    calls = _of_kind(_stored_kinds(refs, "calls"), "calls")
    return _edges(calls, _far(_near(_cases(calls), nodes, None, None, ["near"]), nodes, ["far"]), _named_edge())


def _nearest(refs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """References joined with the nodes of a key: the same file's smallest id, else the smallest of all."""
    any_file = nodes.groupBy(key).agg(F.min("id").alias("_any"))
    own_file = nodes.groupBy(key, "file").agg(F.min("id").alias("_own"))
    rows = refs.join(any_file, key).join(own_file, [key, "file"], "left")
    return rows.withColumn("target", F.coalesce("_own", "_any")).drop("_own", "_any")


def _fixed(provenance: str) -> Column:
    return F.struct("target", F.lit(provenance).alias("provenance"), F.lit(None).cast("string").alias("via"))


def _base_types(own: DataFrame, nodes: DataFrame) -> DataFrame:
    cases = _cases(own)
    types = nodes.filter(F.col("kind").isin(TYPE_KINDS))
    exact = _nearest(cases, types.withColumn("name", F.col("qualname")), "name").select("file", "name", _fixed("resolved").alias("exact"))
    loose = _nearest(cases, types.withColumn("segment", F.col("name")), "segment").select("file", "name", _fixed("heuristic").alias("loose"))
    both = exact.unionByName(loose, allowMissingColumns=True).groupBy("file", "name").agg(F.max("exact").alias("exact"), F.max("loose").alias("loose"))
    return _edges(own, both, F.coalesce("exact", "loose"))


def base_types(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """extends: by whole qualified name, else by last segment."""
    return _base_types(_of_kind(_stored_kinds(refs, "extends"), "extends"), nodes)


def _import_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    own = _absolute_imports(refs, nodes)
    found = _nearest(own.select("file", "absolute").distinct(), nodes.withColumn("absolute", F.col("qualname")), "absolute")
    return _edges(own, found.select("file", "absolute", _fixed("resolved").alias("edge")), F.col("edge"), "absolute")


def import_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """imports: by absolute name, nodes of any kind."""
    return _import_edges(_stored_kinds(refs, "imports"), nodes)


def ladder(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each reference (``seq`` is its own) the edge of the first rule that gives one. Kinds without a rule are never resolved.

    What the rules look at is a file's name, so each name of a file is looked up once; the references meet the outcome in one join,
    where only their own node is left out.
    """
    real = _stored_kinds(refs.filter(~F.col("name").isin(IGNORED)), "imports", "calls", "extends")
    nodes = stored(nodes.select("id", "kind", "name", "qualname", "file"), "nodes")
    names, known = _known(real, nodes)
    calls = _of_kind(real, "calls")
    cases = _cases(calls)
    found = _far(_near(cases, nodes, names, known, ["imported", "imported_type", "near"]), nodes, ["far", "type"])
    found = found.join(_through(cases, nodes, names, known), ["file", "name"], "left")
    called = _edges(calls, found, F.coalesce(_scoped_edge(), _type_edge(), _named_edge()))
    return called.union(_base_types(_of_kind(real, "extends"), nodes)).union(_import_edges(real, nodes))


def linked(resolved: DataFrame) -> DataFrame:
    """The first edge of each (source, target, kind). Few repeat, so they are sorted once, where they have been dealt, and not before too."""
    columns = ["provenance", "via", "file"]
    first = resolved.repartition("source", "target", "kind").groupBy("source", "target", "kind").agg(F.min(F.struct("seq", *columns)).alias("e"))
    return first.select("source", "target", "kind", "e.seq", *[F.col(f"e.{c}").alias(c) for c in columns])


def residue(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """References that stay unresolved; one that gave a repeated edge isn't among them."""
    return refs.filter(~F.col("name").isin(IGNORED)).join(resolved.select("seq"), "seq", "left_anti")


def test_links(nodes: DataFrame) -> DataFrame:
    """tests edges from test nodes to what their name is about, the same file's first."""
    tests = nodes.filter(F.col("kind") == "test").select(F.col("id").alias("from_node"), F.expr("substring(name, 6)").alias("about"), "file", F.lit("tests").alias("kind"), F.monotonically_increasing_id().alias("seq"))
    subjects = nodes.filter(F.col("kind").isin(CALLABLE_KINDS + TYPE_KINDS)).withColumn("about", F.col("name"))
    return _nearest(tests, subjects, "about").filter("target <> from_node").select(F.col("from_node").alias("source"), "target", "kind")


def catalog_links(entries: DataFrame, nodes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """id, name, target: the node that each listed qualified name means, the first by seq; null where unresolved."""
    able = nodes if kinds is None else nodes.filter(F.col("kind").isin(kinds))
    first = able.groupBy(F.col("qualname").alias("name")).agg(F.min_by("id", "seq").alias("target"))
    return entries.select("id", F.explode("names").alias("name")).join(first, "name", "left").select("id", "name", "target")


def capability_overlay(entries: DataFrame, nodes: DataFrame, file: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and unresolved references of capabilities (id, title, summary, implemented_by, examples).

    Each is a node; a qualified name that it lists gives a provides edge to the first node of that name, or stays unresolved;
    each example is a node with an edge to it.
    """
    own = entries.withColumn("node", F.concat_ws("#", F.lit(file), "id", F.lit("capability")))
    capabilities = own.select(F.col("node").alias("id"), F.lit("capability").alias("kind"), F.col("id").alias("name"), F.col("id").alias("qualname"), F.lit(file).alias("file"), F.coalesce(F.nullif("summary", F.lit("")), "title").alias("summary"))
    found = catalog_links(own.select(F.col("node").alias("id"), F.col("implemented_by").alias("names")), nodes)
    listed = own.select("id", "node", F.posexplode("examples").alias("k", "path"))
    number = (F.col("k") + 1).cast("string")
    qualname = F.concat("id", F.lit(" (example "), number, F.lit(")"))
    examples = listed.select(F.concat_ws("#", F.lit(file), qualname, F.lit("example")).alias("node"), F.concat("id", F.lit(" example "), number).alias("name"), qualname.alias("qualname"), "path", F.concat(F.lit("curated example for "), "id").alias("summary"), F.col("node").alias("about"))
    made = examples.select(F.col("node").alias("id"), F.lit("example").alias("kind"), "name", "qualname", F.col("path").alias("file"), "summary")
    edges = _overlay_edges(found, "provides_capability").union(examples.select(F.col("node").alias("source"), F.col("about").alias("target"), F.lit("exemplifies").alias("kind"), F.lit("heuristic").alias("provenance")))
    return capabilities.union(made), edges, _overlay_refs(found, "provides_capability")


def convention_overlay(entries: DataFrame, nodes: DataFrame, file: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``capability_overlay`` for conventions (id, title, scope): governs edges to packages, modules and namespaces."""
    own = entries.filter("id <> '' and size(scope) > 0").withColumn("node", F.concat_ws("#", F.lit(file), "id", F.lit("convention")))
    conventions = own.select(F.col("node").alias("id"), F.lit("convention").alias("kind"), F.col("id").alias("name"), F.col("id").alias("qualname"), F.lit(file).alias("file"), F.col("title").alias("summary"))
    found = catalog_links(own.select(F.col("node").alias("id"), F.col("scope").alias("names")), nodes, MODULE_KINDS)
    return conventions, _overlay_edges(found, "governs"), _overlay_refs(found, "governs")


def _overlay_edges(found: DataFrame, kind: str) -> DataFrame:
    return found.filter("target is not null").select(F.col("id").alias("source"), "target", F.lit(kind).alias("kind"), F.lit("resolved").alias("provenance"))


def _overlay_refs(found: DataFrame, kind: str) -> DataFrame:
    return found.filter("target is null").select(F.col("id").alias("from_node"), "name", F.lit(kind).alias("kind"))


def with_overlays(tables: tuple[DataFrame, ...], overlays: list[tuple[Callable, Callable]]) -> tuple[tuple[DataFrame, ...], list[str]]:
    """The graph's tables with those of each overlay (predicate, builder) whose predicate holds for them, and the messages of overlays that failed.

    Each overlay's tables are stored by themselves before they are added, so that one that fails, when it is planned or while it runs,
    leaves nothing behind and the others alone.
    """
    failed, out = [], tables
    for wanted, build in overlays:
        try:
            if wanted(tables):
                own = [stored(b, "overlay") for b in build(tables)]
                out = tuple(a.unionByName(b, allowMissingColumns=True) for a, b in zip(out, own))
        except Exception as e:  # whatever an overlay raises, the others go on
            failed.append(str(e).strip().splitlines()[0])
    return out, failed


def overlay_failures(spark: SparkSession, failed: list[str]) -> DataFrame:
    """ord, message: a row for each overlay that failed."""
    return spark.createDataFrame(list(enumerate(failed)), "ord int, message string")
