"""Descriptions, pages and bounded contexts of many requests at once. Limits and budgets hold for each request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from graphlens.functions.text import capped
from graphlens.operators import federate, graph
from graphlens.operators.search import best

# How many of each relation a description holds, characters of its texts, and what a clipped text ends with.
EXAMPLES, TESTS, CONVENTIONS, RELATIONS = 3, 5, 3, 6
SOURCE_CHARS, RULE_CHARS = 12_000, 1_200
CLIPPED = "\n... (truncated)"
#: Characters of ``,"source":""`` and those that a clipped text leaves free.
SOURCE_KEY, SPARE = 12, 24


def _plain(found: Column, fields: Sequence[str]) -> Column:
    """Structs of the ``fields`` in the order of ``rank``."""
    return F.transform(F.array_sort(found), lambda x: F.struct(*[x[f].alias(f) for f in fields]))


def _listed(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    """node and an array ``name`` of structs in the order of ``rank``: rows that a limit has bounded."""
    return rows.groupBy(F.col("ref").alias("node")).agg(_plain(F.collect_list(F.struct("rank", *fields)), fields).alias(name))


def _related(edges: DataFrame, nodes: DataFrame, asked: DataFrame, limits: dict[str, int], incoming: bool) -> DataFrame:
    """ref, kind, id, provenance, rank: as ``graph.walk`` over each kind of ``limits`` by itself, for the nodes of ``asked`` (node) alone.

    Edges are dealt by their far end, where unknown ones fall out, and then by the near one for all that is left to do.
    """
    near, far = ("target", "source") if incoming else ("source", "target")
    rows = edges.filter(F.col("kind").isin(*limits)).select(F.col(near).alias("ref"), F.col(far).alias("id"), "kind", "seq", "provenance")
    rows = rows.join(nodes.select("id"), "id", "left_semi").join(asked.select(F.col("node").alias("ref")), "ref", "left_semi")
    first = rows.groupBy("ref", "kind", "id").agg(F.min(F.struct("seq", "provenance")).alias("e")).select("ref", "kind", "id", "e.seq", "e.provenance")
    within = F.coalesce(*[F.when(F.col("kind") == kind, limit) for kind, limit in limits.items()])
    return best(first, ["ref", "kind"], [F.col("seq"), F.col("id")], max(limits.values())).filter(F.col("rank") < within).drop("seq")  # ranks are from 0


def _lists(related: DataFrame, **names: tuple) -> DataFrame:
    """node and an array of each name (kind, fields, condition or None) of its structs by ``rank``: rows that limits have bounded; null where there are none."""
    lists = []
    for name, (kind, fields, condition) in names.items():
        held = F.col("kind") == kind if condition is None else (F.col("kind") == kind) & condition
        found = F.collect_list(F.when(held, F.struct("rank", *fields)))
        lists.append(F.when(F.size(found) > 0, _plain(found, fields)).alias(name))
    return related.groupBy(F.col("ref").alias("node")).agg(*lists)


def describe(refs: DataFrame, sources: DataFrame, nodes: DataFrame, edges: DataFrame, conventions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A row for each distinct ref of a known source's current snapshot: the node, its first examples, tests and conventions, its reliable callers and callees,
    and with ``files`` (file, text) the lines that it spans. Stale and unknown refs give none.

    ``sources``: source, snapshot, freshness; ``conventions``: scope, title, rules (array). Only edges at asked nodes are walked.
    """
    asked = refs.select("ref").distinct().withColumn("p", federate.parsed_ref(F.col("ref")))
    asked = asked.select("ref", "p.source", "p.snapshot", F.col("p.node").alias("node")).join(sources, ["source", "snapshot"])
    rows = asked.join(nodes.withColumnRenamed("id", "node"), "node")
    rules = graph.scope_match(rows.select(F.col("qualname").alias("name")).distinct(), conventions, CONVENTIONS).join(conventions, "scope")
    rules = rules.select(F.col("name").alias("ref"), "rank", "scope", "title", F.transform("rules", lambda r: capped(r, RULE_CHARS)).alias("rules"))
    reliable = F.col("provenance").isin(federate.RELIABLE)  # after the limit
    inward = _lists(
        _related(edges, nodes, asked, {"exemplifies": EXAMPLES, "tests": TESTS, "calls": RELATIONS}, True),
        examples=("exemplifies", ["id"], None),
        tests=("tests", ["id"], None),
        callers=("calls", ["id", "provenance"], reliable),
    )
    outward = _lists(_related(edges, nodes, asked, {"calls": RELATIONS}, False), callees=("calls", ["id", "provenance"], reliable))
    own = rows  # texts and rules are joined before the lists, which so aren't dealt again
    rows = rows.join(_listed(rules, "conventions", "scope", "title", "rules").withColumnRenamed("node", "qualname"), "qualname", "left")
    if files is not None:
        start = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).cast("int")
        size = F.greatest(F.coalesce("end_line", start) - start + 1, F.lit(1)).cast("int")
        span = {"_start": start, "_size": size}
        code = _spans(own.withColumns(span).select("file", "_start", "_size"), files)
        rows = rows.withColumns(span).join(code, ["file", "_start", "_size"], "left").withColumn("source_code", F.coalesce("source_code", F.lit("<source unavailable>"))).drop("_start", "_size")
    return rows.join(inward, "node", "left").join(outward, "node", "left")


def _spans(asked: DataFrame, files: DataFrame) -> DataFrame:
    """file, _start, _size, source_code of the asked spans; a file's text moves once, however many of its spans are asked for, and only clipped spans leave it."""
    spans = asked.groupBy("file").agg(F.collect_set(F.struct("_start", "_size")).alias("_spans"))  # distinct spans of one file
    whole = files.join(spans, "file").select("file", "_spans", F.split("text", "\n").alias("_lines"))
    cut = F.transform("_spans", lambda s: F.struct(s["_start"].alias("_start"), s["_size"].alias("_size"), capped(F.array_join(F.slice("_lines", s["_start"], s["_size"]), "\n"), SOURCE_CHARS).alias("source_code")))
    return whole.select("file", F.inline(cut))


def describe_registry(refs: DataFrame, items: DataFrame) -> DataFrame:
    """The registry's items of the refs that begin with @ (each once), with their execution: an item that is ready can be executed under its own ref.

    ``items``: id, kind, status, freshness, and what else an item tells.
    """
    rows = refs.filter(F.col("ref").startswith("@")).select("ref").distinct().join(items.withColumnRenamed("id", "ref"), "ref")
    able = F.when(F.col("kind") != "executable", "none").otherwise(F.coalesce("status", F.lit("unavailable")))
    ready = able == "ready"
    return rows.withColumns({"execution_status": able, "executable": ready, "executable_capability_id": F.when(ready, F.col("ref")), "freshness": F.coalesce(F.nullif("freshness", F.lit("")), F.lit("unknown"))})


def open_pages(refs: DataFrame, described: DataFrame) -> DataFrame:
    """ref, ok, code, markdown, examples, tests, has_signature, has_summary: a page for each asked ref; one that wasn't found says so."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    told = F.coalesce(F.nullif("summary", F.lit("")), F.nullif("docstring", F.lit("")))
    page = described.select(
        "ref",
        F.greatest(size("examples"), F.lit(0)).alias("examples"),
        F.greatest(size("tests"), F.lit(0)).alias("tests"),
        (F.coalesce("signature", F.lit("")) != "").alias("has_signature"),
        told.isNotNull().alias("has_summary"),
        F.concat_ws("\n", F.concat(F.lit("# "), "qualname"), F.concat(F.lit("`"), F.nullif("signature", F.lit("")), F.lit("`")), told, F.concat(F.lit("ref: "), "ref")).alias("markdown"),
        F.lit(True).alias("ok"),
    )
    rows = refs.select("ref").distinct().join(page, "ref", "left")
    code = F.when(F.col("ok").isNull(), "SYMBOL_NOT_FOUND")
    return rows.select("ref", F.coalesce("ok", F.lit(False)).alias("ok"), code.alias("code"), F.coalesce("markdown", F.lit("")).alias("markdown"), F.coalesce("examples", F.lit(0)).alias("examples"), F.coalesce("tests", F.lit(0)).alias("tests"), F.coalesce("has_signature", F.lit(False)).alias("has_signature"), F.coalesce("has_summary", F.lit(False)).alias("has_summary"))


def compose(parts: list[DataFrame], budget: int) -> DataFrame:
    """task_id, markdown: the pages of each task in the order of ``parts`` (task_id, ord, text), as far as the budget goes."""
    numbered = [p.select("task_id", F.struct(F.lit(k).alias("part"), F.col("ord").cast("long").alias("ord")).alias("ord"), "text").filter("text <> ''") for k, p in enumerate(parts)]
    pages = numbered[0]
    for more in numbered[1:]:
        pages = pages.union(more)
    shown = federate.pack_pages(pages, budget)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n")  # of one budget
    return shown.groupBy("task_id").agg(text.alias("markdown"))


def fit_context(hits: DataFrame, details: DataFrame, budget: int, envelope: int = 0) -> DataFrame:
    """task_id, part (hit or detail), rank, item, compacted, used: what of each task fits ``budget`` characters.

    First the leading hits (task_id, rank, ref, item), then the leading details (task_id, rank, ref, item, compact, source) of kept
    hits. ``item`` and ``compact`` are compact JSON and cost their length and a comma. The detail at the cut gives its compact
    form, with as much of ``source`` as there is room for.
    """
    along = W.partitionBy("task_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    sized = hits.withColumn("used", envelope + F.sum(F.length("item") + 1).over(along))
    kept = sized.filter(F.col("used") <= budget)
    base = kept.groupBy("task_id").agg(F.max("used").alias("base"))
    own = details.join(kept.select("task_id", "ref"), ["task_id", "ref"], "left_semi").join(base, "task_id")
    own = own.withColumn("used", F.col("base") + F.sum(F.length("item") + 1).over(along)).withColumn("before", F.col("used") - F.length("item") - 1)
    whole = F.col("used") <= budget
    room = budget - F.col("before")
    at_cut = ~whole & (F.col("before") <= budget) & (room > 0) & (F.length("compact") <= room)
    space = room - F.length("compact") - SOURCE_KEY - SPARE
    clipped = F.concat(F.left("source", space.cast("int")), F.when(F.length("source") > space, CLIPPED).otherwise(""))
    with_source = F.concat(F.expr("left(compact, length(compact) - 1)"), F.lit(',"source":'), F.to_json(F.array(clipped)).substr(F.lit(2), F.length(F.to_json(F.array(clipped))) - 2), F.lit("}"))
    short = F.when((F.coalesce(F.length("source"), F.lit(0)) > 0) & (space > 0), with_source).otherwise(F.col("compact"))
    shown = own.filter(whole | at_cut).select("task_id", F.lit("detail").alias("part"), "rank", F.when(whole, F.col("item")).otherwise(short).alias("item"), (~whole).alias("compacted"))
    found = kept.select("task_id", F.lit("hit").alias("part"), "rank", "item", F.lit(False).alias("compacted")).union(shown)
    order = W.partitionBy("task_id").orderBy(F.desc("part"), "rank").rowsBetween(W.unboundedPreceding, 0)
    return found.withColumn("used", (envelope + F.sum(F.length("item") + 1).over(order)).cast("long"))


def context_warnings(states: DataFrame) -> DataFrame:
    """group, warnings: freshness that isn't fresh, failed sources, and a registry that isn't available. ``states``: group, freshness, failed, registry."""
    registry = F.coalesce("registry", F.lit("unknown"))
    told = F.array_compact(
        F.array(
            F.when(F.coalesce("freshness", F.lit("unknown")) != "fresh", F.concat(F.lit("collection freshness is "), F.coalesce("freshness", F.lit("unknown")))),
            F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" selected source(s) failed during retrieval"))),
            F.when(registry != "available", F.concat(F.lit("registry status is "), registry)),
        )
    )
    return states.select("group", told.alias("warnings"))


def routing_guide(tasks: DataFrame, cues: DataFrame, inventory: DataFrame, fragments: DataFrame, extra: DataFrame, hints: DataFrame, texts: DataFrame) -> DataFrame:
    """task_id, ord, role, when, prefer, available, search_query, avoid, warning: the checklist of each task.

    A task has a row for each of its intents; one without any has a row for each role that a source plays, in the order of the sources'
    names. ``cues`` (ord, cue, role), ``fragments`` and ``extra`` (ord, fragment, role), ``hints`` (ord, role, package) and ``texts`` (role,
    when, avoid) are fixed small tables; ``inventory`` (name, status) are the sources. A role prefers its sources that are ok, by name,
    else the hinted ones.
    """
    played = inventory.filter("status = 'ok'").join(federate.all_roles(inventory.select("name"), fragments, extra), "name")
    ready = played.groupBy("role").agg(F.array_sort(F.collect_set("name")).alias("ready"), F.min(F.struct("name", "ord")).alias("first"))  # sources of an inventory
    order = F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"])  # roles of the fixed tables
    every = F.broadcast(ready.agg(F.array_join(order, ",").alias("every")))  # one row
    hinted = hints.groupBy("role").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "package"))), lambda x: x["package"]).alias("hinted"))
    told = federate.intents(tasks, cues).crossJoin(every).withColumn("intents", F.when(F.col("intents") != "", F.col("intents")).otherwise(F.col("every")))
    asked = told.filter("intents <> ''").select("task_id", F.posexplode(F.split("intents", ",")).alias("ord", "role"))
    rows = asked.join(ready.select("role", "ready"), "role", "left").join(F.broadcast(hinted), "role", "left").join(F.broadcast(texts), "role", "left")
    prefer = F.coalesce("ready", "hinted", F.array().cast("array<string>"))
    query = F.concat_ws(" ", F.slice(prefer, 1, 2), "role", F.lit("public API"))
    warning = F.when(F.col("ready").isNull(), F.concat(F.lit("intent '"), "role", F.lit("' has no installed/ok source")))
    return rows.select(
        "task_id", "ord", "role",
        F.coalesce("when", F.concat(F.lit("tasks related to role '"), "role", F.lit("'"))).alias("when"),
        F.array_join(prefer, ",").alias("prefer"),
        F.col("ready").isNotNull().alias("available"),
        query.alias("search_query"),
        F.coalesce("avoid", F.lit("inventing interfaces that no source returned")).alias("avoid"),
        warning.alias("warning"),
    )


def suggested_queries(tasks: DataFrame, guide: DataFrame) -> DataFrame:
    """task_id, ord, query: what each task should search for: its text, then for each row of its checklist that prefers a package two queries; each once."""
    text = F.trim(F.col("text"))
    own = tasks.select("task_id", F.lit(-1).alias("ord"), F.lit(0).alias("part"), text.alias("query"))
    prefers = guide.filter("prefer <> ''")
    roles = prefers.select("task_id", "ord", F.lit(0).alias("part"), F.col("search_query").alias("query"))
    able = prefers.select("task_id", "ord", F.lit(1).alias("part"), F.concat(F.substring_index("prefer", ",", 1), F.lit(" public API capabilities")).alias("query"))
    first = own.union(roles).union(able).filter("query <> ''").groupBy("task_id", "query").agg(F.min(F.struct("ord", "part")).alias("m"))
    return first.select("task_id", (F.row_number().over(W.partitionBy("task_id").orderBy("m")) - 1).alias("ord"), "query")


def probes(inventory: DataFrame, fragments: DataFrame) -> DataFrame:
    """name, query: what every task should search for besides: each source that is ok and has a role. They are the same for all tasks, so they stand once."""
    able = inventory.filter("status = 'ok'").select("name").join(federate.roles(inventory.select("name"), fragments).filter("role <> 'other'"), "name")
    return able.select("name", F.concat("name", F.lit(" public API")).alias("query")).distinct()


def preferred_packages(guide: DataFrame) -> DataFrame:
    """task_id, packages: the sources that any row of a task's checklist prefers and has, by name."""
    rows = guide.filter("available").select("task_id", F.explode(F.split("prefer", ",")).alias("package"))
    return rows.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("package")), ",").alias("packages"))


def top_hits(hits: DataFrame, most: int = 12) -> DataFrame:
    """The first hits of each task (task_id, rank, ref, title, qualname, source, executable, signature, summary) as a guide lists them."""
    first = hits.withColumn("_k", F.row_number().over(W.partitionBy("task_id").orderBy("rank", "ref"))).filter(F.col("_k") <= most)
    title = F.coalesce(F.nullif("title", F.lit("")), "qualname")
    return first.select("task_id", (F.col("_k") - 1).alias("ord"), "ref", title.alias("title"), "source", F.coalesce("executable", F.lit(False)).alias("executable"), "signature", "summary")


def next_actions(hits: DataFrame) -> DataFrame:
    """query_id, ord, action, ref for the first five hits: hand an executable one over, describe another."""
    action = F.when(F.col("executable"), "execute").otherwise("describe")
    return hits.filter("rank < 5").select("query_id", F.col("rank").alias("ord"), action.alias("action"), "ref")


def allowed_sources(requests: DataFrame, listed: DataFrame, families: list[str]) -> DataFrame:
    """Requested sources whose root is a listed one's, begins one, or is a listed one before its first dot; equality joins on the beginnings of the listed roots."""
    root = federate.normal_source(F.col("source"), families)
    beginnings = F.explode(F.transform(F.sequence(F.lit(1), F.length("root")), lambda n: F.left(F.col("root"), n)))
    roots = listed.select(root.alias("root")).filter("root <> ''").distinct()
    known = roots.select(beginnings.alias("_n")).distinct()
    rows = requests.withColumn("_n", root).withColumn("_base", F.substring_index("_n", ".", 1))
    return rows.join(known.withColumn("_known", F.lit(True)), "_n", "left").join(roots.select(F.col("root").alias("_base"), F.lit(True).alias("_listed")), "_base", "left").filter("_known or _listed").drop("_n", "_base", "_known", "_listed")


def pinned_sources(requests: DataFrame, listed: DataFrame, families: list[str]) -> DataFrame:
    """query_id, sources: what each request (query_id, sources) may read of a list that isn't empty: its allowed sources as roots, in their order, or all listed roots where it names none."""
    root = federate.normal_source(F.col("source"), families)
    whole = F.broadcast(listed.agg(F.array_sort(F.array_compact(F.collect_set(F.nullif(root, F.lit(""))))).alias("_all")))  # one row: a list that a user writes
    named = requests.filter(F.size("sources") > 0).select("query_id", F.posexplode("sources").alias("ord", "source"))
    allowed = allowed_sources(named, listed, families).withColumn("root", root).filter("root <> ''")
    own = allowed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "root"))), lambda x: x["root"]).alias("own"))
    rows = requests.join(own, "query_id", "left").crossJoin(whole)
    asks = F.coalesce(F.size("sources"), F.lit(0)) > 0
    return rows.select("query_id", F.when(asks, F.coalesce("own", F.array().cast("array<string>"))).otherwise(F.col("_all")).alias("sources"))
