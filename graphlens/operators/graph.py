"""Walks and cards over the node and edge tables. Requests are tables; limits hold for each request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from graphlens.functions.text import prefixes
from graphlens.operators.search import best
from graphlens.schemas import KIND_ORDER, MEMBER_KINDS, OTHER_ORDER, TOPLEVEL_KINDS, TYPE_KINDS
from graphlens.storage import stored


def best_node(nodes: DataFrame) -> DataFrame:
    """qualname, id: the node of each qualified name by order of kinds, then id."""
    order = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KIND_ORDER.items() for x in pair]), F.col("kind")), F.lit(OTHER_ORDER))
    return nodes.groupBy("qualname").agg(F.min(F.struct(order.alias("o"), F.col("id").alias("id"))).alias("m")).select("qualname", "m.id")


def scope_match(names: DataFrame, scopes: DataFrame, limit: int, separator: str = ".") -> DataFrame:
    """name, scope: scopes that are the name or lead it, the longest first. An equality join on the name's beginnings."""
    leading = names.select("name", F.explode(prefixes(F.split("name", f"\\{separator}"), separator)).alias("scope"))
    return best(leading.join(scopes.select("scope").distinct(), "scope"), ["name"], [F.desc(F.length("scope")), F.col("scope")], limit)


def walk(edges: DataFrame, nodes: DataFrame, kinds: list[str], limit: int, incoming: bool = True) -> DataFrame:
    """ref, id, kind, provenance, rank: neighbours of every node over edges of ``kinds`` (in that order, then edge order).

    A neighbour counts at its first edge; edges to unknown nodes are passed over; the limit counts nodes.
    """
    near, far = ("target", "source") if incoming else ("source", "target")
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    rows = edges.filter(F.col("kind").isin(kinds)).select(F.col(near).alias("ref"), F.col(far).alias("id"), F.struct(order.alias("o"), "seq", "kind", "provenance").alias("e"))
    first = rows.groupBy("ref", "id").agg(F.min("e").alias("e")).join(nodes.select("id"), "id", "left_semi")
    return best(first.select("ref", "id", "e.o", "e.seq", "e.kind", "e.provenance"), ["ref"], [F.col("o"), F.col("seq"), F.col("id")], limit).drop("o", "seq")


def references(edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """As ``walk`` over every kind of incoming edge but contains."""
    rows = edges.filter("kind <> 'contains'").select(F.col("target").alias("ref"), F.col("source").alias("id"), F.struct("seq", "kind", "provenance").alias("e"))
    first = rows.groupBy("ref", "id").agg(F.min("e").alias("e")).join(nodes.select("id"), "id", "left_semi")
    return best(first.select("ref", "id", "e.seq", "e.kind", "e.provenance"), ["ref"], [F.col("seq"), F.col("id")], limit).drop("seq")


def impact(edges: DataFrame, seeds: DataFrame, depth: int, limit: int) -> DataFrame:
    """seed, id, depth, via, kind: what reaches each seed over calls and extends, breadth first; the first ``limit`` ids of each seed.

    An id counts at the first edge that reaches it (``kind``, to ``via``): in the order of what was reached before, then calls before extends,
    then edge order. Each hop but the last is stored. Edges are dealt by target and what they reach by seed, once a hop: there equal ids are
    summed up, those of earlier hops told, and the rest numbered and cut to what the limit leaves.
    """
    place = F.when(F.col("kind") == "calls", 0).otherwise(1)
    back = edges.filter(F.col("kind").isin("calls", "extends")).select(F.col("target").alias("at"), F.col("source").alias("next"), place.alias("place"), "seq").repartition("at")
    starts = seeds.select(F.col("id").alias("at"))
    own = W.partitionBy("seed")
    order = F.row_number().over(own.orderBy("e.ord", "e.place", "e.seq", "next"))
    hops: list[DataFrame] = []
    for hop in range(1, max(1, depth) + 1):
        if not hops:  # a seed's own edges are where it is
            rows = back.join(starts, "at", "left_semi").filter("next <> at").select(F.col("at").alias("seed"), "next", F.struct(F.lit(0).alias("ord"), "place", "seq", F.col("at").alias("via")).alias("e"))
            new = rows.groupBy("seed", "next").agg(F.min("e").alias("e")).withColumn("before", F.lit(0))
        else:
            rows = hops[-1].join(back, F.col("id") == F.col("at")).filter("next <> seed").select("seed", "next", F.struct("ord", "place", "seq", F.col("id").alias("via")).alias("e"))
            for seen in hops:
                rows = rows.union(seen.select("seed", "id", F.lit(None).cast(rows.schema["e"].dataType)))
            told = rows.repartition("seed").groupBy("seed", "next").agg(F.min("e").alias("e"), F.count_if(F.col("e").isNull()).alias("seen"))
            new = told.withColumn("before", F.sum("seen").over(own)).filter("seen = 0")
        ranked = new.withColumn("k", order).filter(F.col("before") + F.col("k") <= limit)
        found = ranked.select("seed", F.col("next").alias("id"), F.lit(hop).alias("depth"), F.col("k").alias("ord"), "e.via", F.when(F.col("e.place") == 0, "calls").otherwise("extends").alias("kind"))
        hops.append(stored(found, "frontier") if hop < depth else found)
    whole = hops[0]
    for more in hops[1:]:
        whole = whole.union(more)
    return whole.select("seed", "id", "depth", "via", "kind")


def package_card(nodes: DataFrame) -> DataFrame:
    """source, title, summary, modules: of each source the shortest package (else module) with a summary."""
    kind = F.col("kind")
    order = F.struct(F.when(kind == "package", 0).otherwise(1), F.length("qualname"), F.col("qualname"))
    told = kind.isin("package", "module") & (F.coalesce("summary", F.lit("")) != "")
    card = F.min_by(F.struct("qualname", "summary"), F.when(told, order))
    return nodes.groupBy("source").agg(card.alias("c"), F.count_if(kind == "module").alias("modules")).select("source", F.col("c.qualname").alias("title"), F.col("c.summary").alias("summary"), "modules")


def package_catalog(cards: DataFrame, sources: DataFrame, roles: DataFrame) -> DataFrame:
    """name, title, summary, modules, role, warnings: a card for every source (name, status, freshness), those without a graph too."""
    rows = sources.join(cards.withColumnRenamed("source", "name"), "name", "left").join(roles, "name", "left")
    told = F.array_compact(F.array(F.when(F.col("status") != "ok", F.concat(F.lit("source is "), "status")), F.when(F.coalesce("freshness", F.lit("unknown")) != "fresh", F.concat(F.lit("freshness is "), F.coalesce("freshness", F.lit("unknown")))), F.when(F.coalesce("summary", F.lit("")) == "", "no summary")))
    return rows.select("name", "title", "summary", F.coalesce("modules", F.lit(0)).cast("long").alias("modules"), F.coalesce("role", F.lit("other")).alias("role"), F.array_join(told, "; ").alias("warnings"))


def outline(nodes: DataFrame, edges: DataFrame, path: str | None = None) -> DataFrame:
    """module, symbols (by line, then edge order), members (of each symbol that is a type, in edge order), n_members: of every module and package, or of those
    whose file is ``path`` or lies under it."""
    inside = edges.filter("kind = 'contains'").select("source", "target", "seq")
    known = nodes.filter(F.col("kind").isin("module", "package"))
    if path is not None:
        known = known.filter((F.col("file") == path) | F.col("file").startswith(path.rstrip("/") + "/"))
    modules = known.select(F.col("id").alias("module"))
    top = nodes.filter(F.col("kind").isin(TOPLEVEL_KINDS)).select("id", "start_line", "kind")
    symbols = inside.join(modules, F.col("source") == F.col("module")).join(top, F.col("target") == F.col("id")).select("module", "id", "start_line", "seq", "kind")
    types = symbols.filter(F.col("kind").isin(TYPE_KINDS)).select(F.col("id").alias("source")).distinct()
    able = nodes.filter(F.col("kind").isin(MEMBER_KINDS)).select(F.col("id").alias("target"))
    below = inside.join(types, "source", "left_semi").join(able, "target", "left_semi")
    members = below.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "target"))), lambda x: x["target"]), ",").alias("listed"), F.count(F.lit(1)).alias("n"))
    rows = symbols.join(members, F.col("id") == F.col("source"), "left")
    item = F.struct("start_line", "seq", "id", F.coalesce("listed", F.lit("")).alias("listed"))
    whole = rows.groupBy("module").agg(F.array_sort(F.collect_list(item)).alias("s"), F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    joined = lambda f, by: F.array_join(F.transform("s", lambda x: x[f]), by)
    return modules.join(whole, "module", "left").select("module", joined("id", ",").alias("symbols"), joined("listed", ";").alias("members"), F.coalesce("n", F.lit(0)).alias("n_members"))


def first_members(outlined: DataFrame, limit: int) -> DataFrame:
    """The outline with its first ``limit`` symbols and their number."""
    listed = F.split("symbols", ",")
    return outlined.select("module", F.array_join(F.slice(listed, 1, limit), ",").alias("symbols"), F.coalesce(F.size(listed), F.lit(0)).cast("long").alias("n_symbols"))


def dedupe_last(nodes: DataFrame) -> DataFrame:
    """One row of each id, the last by ``seq``."""
    last = F.row_number().over(W.partitionBy("id").orderBy(F.desc("seq")))
    return nodes.withColumn("_last", last).filter("_last = 1").drop("_last")
