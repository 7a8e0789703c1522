"""Incremental maintenance and retention of snapshots and caches, as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from graphlens.functions.json import canonical

DAY_S, ORPHAN_S = 86_400, 3_600


def age_s(now: Column, then: Column) -> Column:
    """Seconds between two timestamps."""
    return F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(then.cast("timestamp")) / 1e6


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: added, removed, changed or unchanged by content hash."""
    both = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return both.select("path", change.alias("change"))


def stale_sources(known: DataFrame, now: DataFrame) -> DataFrame:
    """source, stale: whether a known file is gone or has another size or time; new files aren't seen."""
    rows = known.join(now.select("path", F.col("size").alias("s"), F.col("mtime").alias("m")), "path", "left")
    return rows.groupBy("source").agg(F.bool_or(F.col("s").isNull() | (F.col("s") != F.col("size")) | (F.col("m") != F.col("mtime"))).alias("stale"))


def extract_plan(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """path, hash, action: reuse where the cache holds a readable payload of path, hash and version, else extract."""
    held = cache.filter((F.col("version") == version) & F.try_parse_json("payload").isNotNull()).select("path", "hash").distinct().withColumn("_held", F.lit(True))
    return files.join(held, ["path", "hash"], "left").select("path", "hash", F.when(F.col("_held"), "reuse").otherwise("extract").alias("action"))


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the new payloads: one row of each (path, hash, version), the newest."""
    both = cache.unionByName(new)
    last = F.row_number().over(W.partitionBy("path", "hash", "version").orderBy(F.desc("created_at"), F.desc("payload")))
    return both.withColumn("_k", last).filter("_k = 1").drop("_k")


def age_prune(rows: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows that aren't older than ``days``; 0 disables."""
    return rows if days <= 0 else rows.filter(age_s(now, F.col("created_at")) <= days * DAY_S)


def _hourly(rows: DataFrame, newest: bool) -> DataFrame:
    """cache, hour, n, size, and n_before and size_before: those of the hours that come first in each cache, and the cache's total."""
    hours = rows.groupBy("cache", F.date_trunc("hour", F.col("created_at")).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    order = W.partitionBy("cache").orderBy(F.desc("hour") if newest else F.asc("hour"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    of_cache = W.partitionBy("cache")
    return hours.withColumns({"n_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "size_before": F.coalesce(F.sum("size").over(before), F.lit(0)), "all_n": F.sum("n").over(of_cache), "all_size": F.sum("size").over(of_cache)})


def shed_to_fit(rows: DataFrame, limit: int) -> DataFrame:
    """The newest rows of each cache whose sizes add up to ``limit``; 0 or less disables.

    Whole hours are decided by their sums; only the hour at the limit is sorted by row.
    """
    if limit <= 0:
        return rows
    hours = _hourly(rows, True).filter(F.col("size_before") <= limit).select("cache", "hour", F.col("size").alias("_size"), F.col("size_before").alias("_before"))
    near = rows.withColumn("hour", F.date_trunc("hour", F.col("created_at"))).join(hours, ["cache", "hour"])
    inside = near.filter(F.col("_before") + F.col("_size") <= limit)
    newest = W.partitionBy("cache", "hour").orderBy(F.desc("created_at"), F.desc("key")).rowsBetween(W.unboundedPreceding, 0)
    edge = near.filter(F.col("_before") + F.col("_size") > limit).withColumn("_sum", F.col("_before") + F.sum("size").over(newest)).filter(F.col("_sum") <= limit)
    return inside.select(*rows.columns).union(edge.select(*rows.columns))


def shed_pass(rows: DataFrame, limit: int) -> DataFrame:
    """One pass: of each cache over the limit the oldest tenth (one row at least) goes. Only the hour at the cut is sorted by row."""
    if limit <= 0:
        return rows
    cut = F.greatest(F.floor(F.col("all_n") / 10), F.lit(1))
    hours = _hourly(rows, False).select("cache", "hour", F.when(F.col("all_size") <= limit, 0).otherwise(cut - F.col("n_before")).alias("_gone"), F.col("n").alias("_n"))
    near = rows.withColumn("hour", F.date_trunc("hour", F.col("created_at"))).join(hours.filter("_gone < _n"), ["cache", "hour"])
    oldest = W.partitionBy("cache", "hour").orderBy("created_at", "key")
    edge = near.filter("_gone > 0").withColumn("_k", F.row_number().over(oldest)).filter("_k > _gone")
    return near.filter("_gone <= 0").select(*rows.columns).union(edge.select(*rows.columns))


def retain_newest(manifests: DataFrame, now: Column, days: int, keep: int) -> DataFrame:
    """The newest ``keep`` (1 at least) snapshots of each spec among those not older than ``days``."""
    recent = manifests.filter(age_s(now, F.col("indexed_at")) <= days * DAY_S)
    rank = F.row_number().over(W.partitionBy("spec").orderBy(F.desc("indexed_at"), F.desc("snapshot_id")))
    return recent.withColumn("_k", rank).filter(F.col("_k") <= max(1, keep)).drop("_k")


def latest_manifest(manifests: DataFrame) -> DataFrame:
    """The last manifest of each snapshot; ties by build id."""
    others = [c for c in manifests.columns if c not in ("snapshot_id", "indexed_at", "build_id")]
    last = F.max(F.struct("indexed_at", "build_id", *others)).alias("m")
    return manifests.groupBy("snapshot_id").agg(last).select("snapshot_id", "m.*").select(manifests.columns)


def out_of_scope(snapshots: DataFrame, kept: DataFrame) -> DataFrame:
    """spec, snapshots, bytes of specs that aren't kept."""
    gone = snapshots.join(kept.select("spec").distinct(), "spec", "left_anti")
    return gone.groupBy("spec").agg(F.count(F.lit(1)).alias("snapshots"), F.round(F.sum("size"), 2).alias("bytes"))


def orphans(folders: DataFrame, manifests: DataFrame, now: Column) -> DataFrame:
    """Folders without a manifest that are older than an hour."""
    return folders.join(manifests.select("snapshot_id").distinct(), "snapshot_id", "left_anti").filter(age_s(now, F.col("created_at")) > ORPHAN_S)


def build_id(components: Column, kind: T.StructType) -> Column:
    """24 hexadecimal digits over a struct of components (versions, digests, arrays of digests) as canonical JSON, so that nulls and separators count."""
    return F.left(F.sha2(canonical(components, kind, ascii_only=True), 256), F.lit(24))


def cache_valid(manifests: DataFrame, current: DataFrame) -> DataFrame:
    """snapshot_id, valid: whether versions and component digests are the current ones."""
    rows = manifests.join(current.select("schema_version", "components", F.lit(True).alias("_is")), ["schema_version", "components"], "left")
    return rows.select("snapshot_id", F.coalesce("_is", F.lit(False)).alias("valid"))


def commit_freshness(manifests: DataFrame, heads: DataFrame) -> DataFrame:
    """spec, freshness: fresh, stale, or unknown without a known head."""
    rows = manifests.join(heads.select("spec", F.col("commit").alias("head")), "spec", "left")
    return rows.select("spec", F.when(F.col("head").isNull() | F.col("commit").isNull(), "unknown").when(F.col("head") == F.col("commit"), "fresh").otherwise("stale").alias("freshness"))


def cache_report(rows: DataFrame, now: Column, days: int, limit: int) -> DataFrame:
    """cache, entries, used, over_limit, reclaimable of each cache."""
    old = age_s(now, F.col("created_at")) > days * DAY_S
    return rows.groupBy("cache").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("used"), (F.sum("size") > limit).alias("over_limit"), F.coalesce(F.sum(F.when(old, F.col("size"))), F.lit(0)).cast("long").alias("reclaimable"))


def source_dedupe(bindings: DataFrame) -> DataFrame:
    """ord, spec, name: the first binding of each spec; repeated names get -2, -3 and so on."""
    first = bindings.withColumn("_k", F.row_number().over(W.partitionBy("spec").orderBy("ord"))).filter("_k = 1")
    n = F.row_number().over(W.partitionBy("name").orderBy("ord"))
    return first.withColumn("_n", n).select("ord", "spec", F.when(F.col("_n") > 1, F.concat("name", F.lit("-"), "_n")).otherwise(F.col("name")).alias("name"))


def source_set(bindings: DataFrame, named: DataFrame) -> DataFrame:
    """name, spec, explicit: the sources of ``source_dedupe`` with those that a user names (name, spec) in place of any of the same name."""
    found = source_dedupe(bindings).join(named.select("name").distinct(), "name", "left_anti")
    own = named.groupBy("name").agg(F.max("spec").alias("spec"))
    return found.select("name", "spec", F.lit(False).alias("explicit")).union(own.select("name", "spec", F.lit(True)))


def normal_package(name: Column) -> Column:
    """A package's name in lower case with single dashes."""
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


def source_name(package: Column) -> Column:
    """A package's name as a source's: lower case, letters, digits, dots, dashes and underscores, from its first letter on; ``pkg`` and what there is where it has no letter."""
    bare = F.regexp_replace(F.lower(package), r"[^a-z0-9._-]", "")
    named = F.regexp_replace(bare, r"^[^a-z]+", "")
    return F.when(named != "", named).otherwise(F.concat(F.lit("pkg"), bare))


def top_level(package: Column, declared: Column, folders: Column) -> Column:
    """The name that a package is imported by: the first line that it declares; else of its checkout's folders (an array, of the first
    layout that decides) the one whose name is part of the package's, of several such the one that is its name, or, without any, the only folder; else its own name with underscores."""
    line = F.get(F.filter(F.transform(F.split(declared, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    inside = F.filter(folders, lambda x: F.contains(normal_package(package), normal_package(x)))
    exact = F.filter(inside, lambda x: normal_package(x) == normal_package(package))
    chosen = F.when(F.size(inside) == 1, F.get(inside, F.lit(0))).when(F.size(exact) == 1, F.get(exact, F.lit(0))).when((F.size(inside) == 0) & (F.size(folders) == 1), F.get(folders, F.lit(0)))
    return F.coalesce(line, chosen, F.replace(package, F.lit("-"), F.lit("_")))


def package_signals(packages: DataFrame, keywords: list[str], prefix: str, include: list[str], exclude: list[str]) -> DataFrame:
    """normal, identified_by, outcome of installed packages by entry points, keywords and editable installs; names compare after normalising.

    An excluded package that has a signal or is included is ``excluded``; one with neither is ``none``; the others are a
    ``source``, or ``skipped`` where no importable folder (``package_dir``) is known. An included one is identified by ``override`` too.
    """
    bare = normal_package(F.col("name"))
    included, excluded = bare.isin(include), bare.isin(exclude)
    signals = F.array_compact(F.array(F.when(F.exists("entry_point_groups", lambda g: g.startswith(prefix)), F.lit("entry_point")), F.when(F.arrays_overlap(F.split(F.lower("keywords"), r"[,\s]+"), F.array(*map(F.lit, keywords))), F.lit("keyword")), F.when(F.col("direct_url").isNotNull(), F.lit("editable"))))
    rows = packages.select("package_dir", bare.alias("normal"), signals.alias("signals"), included.alias("included"), excluded.alias("excluded"))
    wanted = (F.size("signals") > 0) | F.col("included")
    outcome = F.when(F.col("excluded") & wanted, "excluded").when(~wanted, "none").when(F.col("package_dir").isNull(), "skipped").otherwise("source")
    by = F.when(outcome.isin("source", "skipped"), F.concat_ws(",", "signals", F.when(F.col("included"), "override"))).otherwise("")
    return rows.select("normal", by.alias("identified_by"), outcome.alias("outcome"))


def index_report(sources: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, files, nodes, edges, cached of every source (source, cached)."""
    out = sources
    for name, rows in (("files", files), ("nodes", nodes), ("edges", edges)):
        out = out.join(rows.groupBy("source").agg(F.count(F.lit(1)).alias(name)), "source", "left")
    return out.select("source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "nodes", "edges")], "cached")
