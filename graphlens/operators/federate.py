"""Federated ranking, hit shaping, bounded packing and routing. Requests are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RRF_K = 60
REGISTRY = "registry"
#: Provenances of relations that can be relied on.
RELIABLE = ["resolved", "scip"]


def selected(hits: DataFrame, requests: DataFrame, states: DataFrame) -> DataFrame:
    """The hits (query_id, channel, namespace, kind, ref, score) that each request (query_id, sources, namespaces, kinds; null: all) asks for, of the
    registry and of sources that are ok (``states``: channel, status). An empty list of sources leaves the registry. All filters come before any limit.
    """
    rows = hits.join(requests, "query_id").join(states.select("channel", "status"), "channel", "left")
    registry = F.col("channel") == REGISTRY
    listed = lambda c, x: F.col(c).isNull() | F.array_contains(c, F.col(x))
    source = registry | (listed("sources", "channel") & (F.coalesce("status", F.lit("")) == "ok"))
    return rows.filter(source & (~registry | listed("namespaces", "namespace")) & listed("kinds", "kind")).select("query_id", "channel", "ref", "score")


def failed_channels(requests: DataFrame, states: DataFrame) -> DataFrame:
    """query_id, channel, status: the asked sources of each request that aren't ok; a request without a list asks for all."""
    bad = states.filter("status <> 'ok'")
    named = requests.filter("sources is not null").select("query_id", F.explode(F.array_distinct("sources")).alias("channel")).join(bad, "channel")
    every = bad.groupBy().agg(F.collect_list(F.struct("channel", "status")).alias("bad"))  # one row of the sources that fail
    rest = requests.filter("sources is null").crossJoin(F.broadcast(every)).select("query_id", F.explode("bad").alias("b"))
    return named.select("query_id", "channel", "status").union(rest.select("query_id", "b.channel", "b.status"))


def channels(hits: DataFrame, limit: int, oversample: int = 3) -> DataFrame:
    """The first ``oversample`` times ``limit`` hits of each query and channel (query_id, channel, ref, score), with their rank from 1."""
    order = W.partitionBy("query_id", "channel").orderBy(F.desc("score"), "ref")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= oversample * limit)


def fuse(ranked: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, channel, ref, rank): a ref counts once in a channel.

    Ties go by best rank, then by the first channel, the registry before the sources and these by name, then by ref.
    """
    place = F.struct((F.col("channel") != REGISTRY).alias("source"), "channel")
    first = ranked.groupBy("query_id", "channel", "ref").agg(F.min("rank").alias("rank"))
    sums = first.groupBy("query_id", "ref").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 12).alias("score"), F.min("rank").alias("best"), F.min(place).alias("channel"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("matched"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "best", "channel", "ref")
    return sums.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query_id", "ref", "score", "matched", "place")


def symbol_ref(source: Column, snapshot: Column, node: Column) -> Column:
    return F.concat(source, F.lit("@"), snapshot, F.lit(":"), node)


def symbol_hits(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes (source, and the columns of a node) in the shape of hits, of the sources (source, namespace, snapshot, freshness) that are known; no symbol is executable."""
    given = lambda c: F.nullif(c, F.lit(""))
    rows = nodes.join(sources, "source")
    return rows.select(
        symbol_ref(F.col("source"), F.col("snapshot"), F.col("id")).alias("ref"), F.coalesce("kind", F.lit("symbol")).alias("kind"), "namespace", "source", "snapshot",
        F.coalesce(given("qualname"), given("name"), "id").alias("title"), "summary", "signature", F.lit(False).alias("executable"), F.lit(None).cast("string").alias("executable_capability_id"),
        F.struct(F.lit("code_graph").alias("type"), F.col("id").alias("node_id"), F.coalesce("language", F.lit("unknown")).alias("language")).alias("provenance"),
        F.coalesce("freshness", F.lit("unknown")).alias("freshness"),
        F.struct(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", "start_line", F.lit(0)).alias("end_line")).alias("span"),
    )


def parsed_ref(ref: Column) -> Column:
    """source, snapshot and node of a symbol ref; null where it isn't one (a node has two # at least)."""
    shape = r"^([^@]+)@(.*):([^:]*#.*#.*)$"
    part = lambda k: F.regexp_extract(ref, shape, k)
    return F.when(ref.rlike(shape), F.struct(part(1).alias("source"), part(2).alias("snapshot"), part(3).alias("node")))


def registry_hits(items: DataFrame) -> DataFrame:
    """Registry items whose id starts with @, with namespace and execution status."""
    able = F.when(F.col("kind") != "executable", "none").when(F.col("status") == "ready", "executable").otherwise("unavailable")
    return items.filter(F.col("id").startswith("@")).select("id", F.regexp_extract("id", "^@([^/]+)/", 1).alias("namespace"), able.alias("execution"))


def reliable(pairs: DataFrame, limit: int) -> DataFrame:
    """Of the first ``limit`` relations of each ref those that are resolved; the limit comes first."""
    first = pairs.withColumn("_k", F.row_number().over(W.partitionBy("ref").orderBy("seq", "id"))).filter(F.col("_k") <= limit)
    return first.filter(F.col("provenance").isin(RELIABLE)).drop("_k")


def freshness(states: DataFrame) -> DataFrame:
    """group, freshness: stale before pending before unknown before fresh."""
    any_of = lambda s: F.bool_or(F.col("state") == s)
    return states.groupBy("group").agg(F.when(any_of("stale"), "stale").when(any_of("pending"), "pending").when(any_of("unknown") | F.bool_or(F.col("state").isNull()), "unknown").otherwise("fresh").alias("freshness"))


def coverage(states: DataFrame) -> DataFrame:
    """group, total, ready, failed, share of ready ones."""
    return states.groupBy("group").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "fresh").alias("ready"), F.count_if(F.col("state") == "failed").alias("failed"))


def pack_budget(hits: DataFrame, details: DataFrame, budget: int) -> DataFrame:
    """task_id, hits, details, omitted, used: the leading hits that fit, then the leading details of kept hits that fit."""
    along = W.partitionBy("task_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    sized = hits.withColumn("sum", F.sum("size").over(along))
    kept = sized.filter(F.col("sum") <= budget)
    base = kept.groupBy("task_id").agg(F.max("sum").alias("base"))
    own = details.join(kept.select("task_id", "rank"), ["task_id", "rank"], "left_semi").join(base, "task_id")
    fitting = own.withColumn("sum", F.col("base") + F.sum("size").over(along)).filter(F.col("sum") <= budget)
    per = fitting.groupBy("task_id").agg(F.count(F.lit(1)).alias("details"), F.max("sum").alias("used"))
    counted = sized.groupBy("task_id").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("sum") <= budget).alias("hits"), F.coalesce(F.max(F.when(F.col("sum") <= budget, F.col("sum"))), F.lit(0)).alias("base"))
    rows = counted.join(per, "task_id", "left")
    return rows.select("task_id", "hits", F.coalesce("details", F.lit(0)).cast("long").alias("details"), (F.col("all") - F.col("hits")).alias("omitted"), F.coalesce("used", "base").cast("long").alias("used"))


def pack_pages(pages: DataFrame, budget: int, least_cut: int = 80) -> DataFrame:
    """task_id, ord, text: pages in order up to the first that overflows, which is cut where more than ``least_cut`` characters are left."""
    before = W.partitionBy("task_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    cost = F.length("text") + 2
    rows = pages.withColumn("_used", F.coalesce(F.sum(cost).over(before), F.lit(0))).withColumn("_left", budget - F.col("_used"))
    whole = cost <= F.col("_left")
    cut = ~whole & (F.col("_left") > least_cut)
    shown = rows.filter(whole | cut)
    return shown.select("task_id", "ord", F.when(whole, F.col("text")).otherwise(F.left("text", F.col("_left").cast("int") - 2)).alias("text"))


def post_filtered(hits: DataFrame, path: str, executable: bool | None, limit: int) -> DataFrame:
    """Filters that come after the limit (1 to 100), so that fewer may be left: ``path`` in the ref or the file, or, with dots for slashes, in the title."""
    first = hits.withColumn("_k", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "ref"))).filter(F.col("_k") <= min(max(limit, 1), 100)).drop("_k")
    bare = path.strip().strip("/")
    inside = lambda c, x: F.contains(F.coalesce(c, F.lit("")), F.lit(x))
    held = inside("ref", bare) | inside("title", bare.replace("/", ".")) | inside("file", bare)
    return first.filter(held) if executable is None else first.filter(held & (F.col("executable") == executable))


def intents(tasks: DataFrame, cues: DataFrame) -> DataFrame:
    """task_id, intents: roles whose cue the text holds, in the order of the table. ``cues`` (ord, cue, role) is a fixed small table."""
    hits = tasks.join(F.broadcast(cues), F.contains(F.lower("text"), F.col("cue"))).groupBy("task_id", "role").agg(F.min("ord").alias("ord"))
    told = hits.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "role"))), lambda x: x["role"]), ",").alias("intents"))
    return tasks.select("task_id").join(told, "task_id", "left").select("task_id", F.coalesce("intents", F.lit("")).alias("intents"))


def _plain_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def roles(names: DataFrame, fragments: DataFrame) -> DataFrame:
    """name, role: that of the longest fragment in the name, the first of equally long ones; ``fragments`` (ord, fragment, role) is a fixed small table."""
    hits = names.join(F.broadcast(fragments), F.contains(_plain_name(F.col("name")), F.col("fragment")))
    best = hits.groupBy("name").agg(F.min(F.struct((-F.length("fragment")).alias("n"), "ord", "role")).alias("m"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.coalesce("m.role", F.lit("other")).alias("role"))


def all_roles(names: DataFrame, fragments: DataFrame, extra: DataFrame) -> DataFrame:
    """name, ord, role: a name's own role first (if it has one), then the further ones of the fragments that it holds (``extra``: ord, fragment, role), each once."""
    own = roles(names, fragments).filter("role <> 'other'").select("name", F.lit(-1).alias("ord"), "role")
    more = names.select("name").distinct().join(F.broadcast(extra), F.contains(_plain_name(F.col("name")), F.col("fragment"))).select("name", "ord", "role")
    first = own.union(more).groupBy("name", "role").agg(F.min("ord").alias("ord"))
    return first.select("name", (F.row_number().over(W.partitionBy("name").orderBy("ord")) - 1).alias("ord"), "role")


def routed(tasks: DataFrame, planes: DataFrame, default: tuple[str, str], companions: list[tuple[str, str, str]]) -> DataFrame:
    """task_id, ord, plane, reason: every plane with a keyword in the text, in the order of the table, each once with its first reason.

    ``planes`` (ord, keyword, plane, reason) is a fixed small table. A task without any goes to the ``default`` (plane, reason).
    ``companions`` (plane, companion, reason): a task that has the plane gets the companion too, last.
    """
    text = F.lower(F.trim(F.col("text")))
    hits = tasks.join(F.broadcast(planes), F.contains(text, F.col("keyword"))).groupBy("task_id", "plane").agg(F.min(F.struct("ord", "reason")).alias("m"))
    matched = F.transform(F.array_sort(F.collect_list(F.struct("m.ord", "plane", "m.reason"))), lambda x: F.struct(x["plane"].alias("plane"), x["reason"].alias("reason")))  # planes of the table
    pair = lambda plane, reason: F.array(F.struct(F.lit(plane).alias("plane"), F.lit(reason).alias("reason")))
    rows = tasks.select("task_id").join(hits.groupBy("task_id").agg(matched.alias("planes")), "task_id", "left").withColumn("planes", F.coalesce("planes", pair(*default)))
    for plane, companion, reason in companions:
        has = lambda x: F.exists("planes", lambda p: p["plane"] == x)
        rows = rows.withColumn("planes", F.when(has(plane) & ~has(companion), F.concat("planes", pair(companion, reason))).otherwise(F.col("planes")))
    return rows.select("task_id", F.posexplode("planes").alias("ord", "p")).select("task_id", "ord", "p.plane", "p.reason")


def _substrings(rows: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """``rows`` with a row for each distinct substring of ``column`` that is as long as some ``other``, in a column of that name."""
    lengths = F.broadcast(others.agg(F.array_sort(F.collect_set(F.length(other))).alias("_lengths")))  # one row, of as many numbers as the longest name has letters
    text = F.col(column)
    of_length = lambda k: F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: text.substr(i, k))
    pieces = F.array_distinct(F.flatten(F.transform(F.filter("_lengths", lambda k: (k > 0) & (k <= F.length(text))), of_length)))
    return rows.crossJoin(lengths).select(*rows.columns, F.explode(pieces).alias(other))


def aliases(asked: DataFrame, inventory: DataFrame, table: DataFrame) -> DataFrame:
    """asked, name: by exact name, then by alias, then by substring either way, first in order; null without any.

    Substrings are equality joins on those of the lengths that occur on the other side.
    """
    names, wanted = inventory.select(F.col("name").alias("found"), "ord"), asked.select("asked").distinct()
    hit = lambda rows, p: rows.select("asked", F.struct(F.lit(p).alias("p"), "ord", "found").alias("m"))
    exact = hit(wanted.join(names, F.col("asked") == F.col("found")), 0)
    alias = hit(wanted.join(table, F.col("asked") == F.col("alias")).join(names, F.col("target") == F.col("found")), 1)
    inside = hit(_substrings(wanted, "asked", names, "found").join(names, "found"), 2)
    around = hit(_substrings(names, "found", wanted, "asked").join(wanted, "asked"), 2)
    best = exact.union(alias).union(inside).union(around).groupBy("asked").agg(F.min("m").alias("m"))
    return wanted.join(best, "asked", "left").select("asked", F.col("m.found").alias("name"))


def normal_source(name: Column, families: list[str]) -> Column:
    """The root of a source's name: without a namespace, the last part after the name of a family, or what stands before the first dot."""
    bare = F.regexp_replace(F.lower(F.trim(name)), "^@[^/]*/", "")
    parts = F.filter(F.split(F.replace(bare, F.lit("_"), F.lit("-")), "-"), lambda x: x != "")
    family = (F.size(parts) >= 2) & F.get(parts, F.lit(0)).isin(families)
    return F.when(family, F.try_element_at(parts, F.lit(-1))).when(F.contains(bare, F.lit(".")) & ~bare.startswith("."), F.regexp_extract(bare, r"^([^.]*)", 1)).otherwise(bare)


def catalog_page(cards: DataFrame) -> DataFrame:
    """One page of all cards, a line each, by name. Cards are one per source."""
    line = F.format_string("- **%s** (%d modules): %s", F.col("source"), F.col("modules"), F.coalesce("summary", F.lit("no summary")))
    return cards.select("source", line.alias("line"))
