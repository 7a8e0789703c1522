"""Adoption of data folders: survey, plan, ledger and verification over listing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from graphlens.functions.text import prefixes, slug
from graphlens.storage import stored

MAX_DEPTH = 6
# Suffixes of run artifacts, beginnings of names that mark one, and statuses that a resume never redoes.
ARTIFACT_SUFFIXES = ["log", "lammps", "out", "dat", "npy", "npz", "h5", "hdf5", "csv", "xyz", "pdb", "dcd", "xtc", "trr", "lammpstrj", "chk", "pt", "pth"]
ARTIFACT_STEMS = ["params", "result", "checkpoint", "thermo", "metrics", "log", "out"]
EVENT_FILES = "events.out.tfevents."
TERMINAL = ["verified", "moved", "skipped"]


def ancestors(listing: DataFrame) -> DataFrame:
    """path, size and ``dir``, each folder above the file; equality joins on it replace prefix joins."""
    parts = F.split("path", "/")
    return listing.select("path", "size", F.explode(prefixes(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).alias("dir"))


def excluded_dir(path: Column, names: list[str]) -> Column:
    """The topmost folder above a file whose name is excluded; null where there is none. It is found within the row."""
    parts = F.split(path, "/")
    above = prefixes(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    return F.get(F.filter(above, lambda d: F.substring_index(d, "/", -1).isin(names)), F.lit(0))


def excluded_dirs(listing: DataFrame, names: list[str]) -> DataFrame:
    """dir, files, bytes: each excluded folder once, whatever lies below it."""
    rows = listing.select("size", excluded_dir(F.col("path"), names).alias("dir")).filter("dir is not null")
    return rows.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def surveyed(listing: DataFrame, names: list[str]) -> DataFrame:
    """The files that aren't below an excluded folder: nothing else of a survey counts the others."""
    return listing.filter(excluded_dir(F.col("path"), names).isNull())


def log_summary(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """what, n: logs by format, runs with a metrics buffer and runs without logs. ``runs``: run, has_buffer; ``logs``: run, format."""
    own = logs.join(runs.select("run"), "run", "left_semi")
    by_format = own.groupBy("format").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("format "), "format").alias("what"), "n")
    counted = runs.join(own.select("run", F.lit(True).alias("_logged")).distinct(), "run", "left")
    totals = counted.agg(F.count_if("has_buffer").alias("runs_with_buffer"), F.count_if(F.col("_logged").isNull()).alias("runs_without_logs"))
    return by_format.union(totals.unpivot([], ["runs_with_buffer", "runs_without_logs"], "what", "n"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def dir_rollup(listing: DataFrame) -> DataFrame:
    """dir, depth, files and bytes below, and files directly in it; folders deeper than MAX_DEPTH are marked."""
    rows = ancestors(listing.filter(F.instr("path", "/") > 0))
    direct = F.count_if(parent(F.col("path")) == F.col("dir"))
    depth = F.size(F.split("dir", "/"))
    return rows.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), direct.alias("direct")).select("dir", depth.alias("depth"), "files", "bytes", "direct", (depth > MAX_DEPTH).alias("too_deep"))


def is_artifact(path: Column) -> Column:
    """By the file's name: an event file, a suffix of run output, or a beginning that marks one."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return name.startswith(EVENT_FILES) | F.lower(name).rlike(rf"^.+\.({'|'.join(ARTIFACT_SUFFIXES)})$|^({'|'.join(ARTIFACT_STEMS)})")


def classify_dirs(listing: DataFrame, deepest: int = MAX_DEPTH) -> DataFrame:
    """dir, depth, kind, from the deepest level up: all children runs: experiment; all experiments: project; artifacts and only
    loose children: run; else loose. Each level is stored and reads only the one below it."""
    dirs = ancestors(listing.filter(F.instr("path", "/") > 0)).groupBy("dir").agg(F.bool_or((parent(F.col("path")) == F.col("dir")) & is_artifact(F.col("path"))).alias("artifacts"))
    dirs = stored(dirs.select("dir", F.size(F.split("dir", "/")).alias("depth"), "artifacts"), "dirs")
    only = lambda k: F.col("kinds") == F.array(F.lit(k))
    kind = F.when(only("run"), "experiment").when(only("experiment"), "project").when(F.col("artifacts") & (F.col("kinds").isNull() | only("loose")), "run").otherwise("loose")
    below, done = None, None
    for depth in range(deepest, 0, -1):
        level = dirs.filter(F.col("depth") == depth)
        if below is None:
            found = level.withColumn("kinds", F.lit(None).cast("array<string>"))
        else:
            kinds = below.groupBy(parent(F.col("dir")).alias("dir")).agg(F.collect_set("kind").alias("kinds"))  # of four kinds
            found = level.join(kinds, "dir", "left")
        below = stored(found.select("dir", "depth", kind.alias("kind")), "level")
        done = below if done is None else done.union(below)
    return done


def oddities(listing: DataFrame, deepest: int = MAX_DEPTH) -> DataFrame:
    """path, oddity: broken links, links that leave the tree, files that can't be read (no size), empty files, and files below the depth limit."""
    linked = F.coalesce("is_symlink", F.lit(False))
    odd = F.when(linked & F.col("link_target").isNull(), "broken_symlink").when(linked & F.col("link_target").rlike(r"^(/|\.\./)"), "escaping_symlink")
    odd = odd.when(F.col("size").isNull(), "unreadable_file").when(F.col("size") == 0, "empty_file").when(F.size(F.split("path", "/")) - 1 > deepest, "depth_limit")
    return listing.select("path", odd.alias("oddity")).filter("oddity is not null")


def survey_summary(kinds: DataFrame, listing: DataFrame) -> DataFrame:
    """what, n: folders by kind, files, bytes and greatest depth."""
    by_kind = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("kind "), "kind").alias("what"), "n")
    totals = listing.agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"), F.max(F.size(F.split("path", "/")) - 1).cast("long").alias("depth"))
    return by_kind.union(totals.unpivot([], ["files", "bytes", "depth"], "what", "n"))


def plan_mapping(runs: DataFrame, root: str) -> DataFrame:
    """dir, project, experiment, run_id: a run's parent and grandparent; the root's name or ``default`` where it is shallow."""
    parts = F.split("dir", "/")
    name = lambda back: F.try_element_at(parts, F.lit(-back))
    return runs.select("dir", slug(F.coalesce(name(3), F.lit(root))).alias("project"), slug(F.coalesce(name(2), F.lit("default"))).alias("experiment"), slug(name(1)).alias("run_id"))


def run_files(listing: DataFrame, runs: DataFrame) -> DataFrame:
    """run, path: every file at or under each run."""
    return ancestors(listing).join(runs.select(F.col("dir")), "dir").select(F.col("dir").alias("run"), "path")


def lifted_parameters(files: DataFrame) -> DataFrame:
    """run, keys: of each run the first of params, parameters and config that is a JSON object."""
    kind = F.schema_of_variant(F.try_parse_json("content"))
    place = F.array_position(F.array(F.lit("params.json"), F.lit("parameters.json"), F.lit("config.json")), F.col("name"))
    good = files.filter((place > 0) & kind.startswith("OBJECT"))
    first = good.groupBy("run").agg(F.min(F.struct(place.alias("p"), "content")).alias("m"))
    return first.select("run", F.array_join(F.array_sort(F.json_object_keys("m.content")), ",").alias("keys"))


def skipped(listing: DataFrame, owned: DataFrame) -> DataFrame:
    """path, reason of files that no run owns."""
    rest = listing.join(owned.select("path").distinct(), "path", "left_anti")
    return rest.select("path", F.when(F.coalesce("size", F.lit(0)) == 0, "empty").otherwise("outside any run").alias("reason"))


def slug_conflicts(names: DataFrame) -> DataFrame:
    """scope, slug, names: slugs that several names of a scope claim, with the number of names."""
    return names.withColumn("slug", slug(F.col("name"))).groupBy("scope", "slug").agg(F.countDistinct("name").alias("names")).filter("names > 1")


def file_conflicts(owned: DataFrame) -> DataFrame:
    """path, runs, first, last: files that several runs claim (``owned``: run, path), with the number of runs and the first and last of them."""
    return owned.groupBy("path").agg(F.countDistinct("run").alias("runs"), F.min("run").alias("first"), F.max("run").alias("last")).filter("runs > 1")


def plan_totals(plan: DataFrame) -> DataFrame:
    """projects, experiments, runs and files of a plan."""
    return plan.agg(F.countDistinct("project").alias("projects"), F.countDistinct("project", "experiment").alias("experiments"), F.countDistinct("project", "experiment", "run_id").alias("runs"), F.count("file").alias("files"))


def ledger_plan(plan: DataFrame, want_ingest: bool = False, prior: DataFrame | None = None) -> DataFrame:
    """kind, source, target, status, run_id, size, ord: of each run its entry, where asked for its ingestion, and its files rebased under artifacts/, in this order.

    ``plan``: project, experiment, run_id, source, file and size (what a file held when it was listed; 0 where it couldn't be read).
    Runs that a ``prior`` ledger (kind, source, target, status, run_id) has finished keep their target and run id.
    """
    base = F.concat_ws("/", "project", "experiment", F.concat(F.lit("run-"), "run_id"))
    runs = plan.select("source", base.alias("target"), "run_id").distinct()
    if prior is not None:
        done = prior.filter((F.col("kind") == "run") & F.col("status").isin(TERMINAL)).groupBy("source").agg(F.min(F.struct("target", "run_id")).alias("old"))
        runs = runs.join(done, "source", "left").select("source", F.coalesce("old.target", "target").alias("target"), F.coalesce("old.run_id", "run_id").alias("run_id"))
    none = F.lit(0).cast("long")

    def entry(rows: DataFrame, kind: str, status: str, source: Column, target: Column, place: int, size: Column = none) -> DataFrame:
        order = F.struct(F.col("source").alias("run"), F.lit(place).alias("place"), source.alias("path"))
        return rows.select(F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"), F.lit(status).alias("status"), "run_id", size.alias("size"), order.alias("ord"))

    files = plan.select("source", "file", F.coalesce("size", none).cast("long").alias("size")).join(runs.select("source", "target", "run_id"), "source")
    path = F.concat_ws("/", "source", "file")
    out = entry(runs, "run", "verified", F.col("source"), F.col("target"), 0)
    if want_ingest:
        out = out.union(entry(runs, "ingest", "pending", F.col("source"), F.col("target"), 1))
    return out.union(entry(files, "file", "pending", path, F.concat_ws("/", "target", F.lit("artifacts"), "file"), 2, F.col("size")))


def incompatible(ledgers: DataFrame, asked: DataFrame) -> DataFrame:
    """ledger, field, have, want: where an existing ledger (ledger, source, target, mode, version) disagrees with what a resume asks for."""
    fields = ["source", "target", "mode", "version"]
    both = ledgers.join(asked.select("ledger", *[F.col(f).alias(f"_{f}") for f in fields]), "ledger")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("have"), F.col(f"_{f}").cast("string").alias("want")) for f in fields])
    return both.select("ledger", F.explode(pairs).alias("p")).filter(~F.col("p.have").eqNullSafe(F.col("p.want"))).select("ledger", "p.field", "p.have", "p.want")


def resumed(planned: DataFrame, old: DataFrame) -> DataFrame:
    """The plan with the entries of the old ledger that have ended in place of its own, in all columns that the old one has."""
    key = ["kind", "source", "target"]
    others = [c for c in planned.columns if c not in key and c in old.columns]
    ended = old.filter(F.col("status").isin(TERMINAL)).groupBy(*key).agg(F.min(F.struct(*others)).alias("_old"))
    rows = planned.join(ended, key, "left")
    return rows.select(*[F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) if c in others else F.col(c) for c in planned.columns])


def outstanding(ledger: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` entries of each ledger that haven't ended, by target."""
    rank = F.row_number().over(W.partitionBy("ledger").orderBy("target"))
    return ledger.filter(~F.col("status").isin(TERMINAL)).withColumn("place", rank).filter(F.col("place") <= limit)


def ingest_plan(logs: DataFrame, ingested: DataFrame) -> DataFrame:
    """run, path, format, action, reason: CSV logs without a step or series column are skipped; runs that have been ingested aren't ingested again."""
    rows = logs.join(ingested.select("run", F.lit(True).alias("_done")).distinct(), "run", "left")
    reason = F.when(F.coalesce("_done", F.lit(False)), "already ingested").when((F.col("format") == "csv") & (F.col("step").isNull() | (F.coalesce(F.size("series"), F.lit(0)) <= 0)), "csv needs step and series columns")
    return rows.select("run", "path", "format", F.when(reason.isNull(), "ingest").otherwise("skip").alias("action"), reason.alias("reason"))


def transfer_decision(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """path, decision of planned files: transfer, reuse, refuse, or skip where the source is gone."""
    rows = sources.join(targets.select("path", F.col("sha256").alias("there")), "path", "left")
    decision = F.when(F.col("sha256").isNull(), "skip").when(F.col("there").isNull(), "transfer").when(F.col("there") == F.col("sha256"), "reuse").otherwise("refuse")
    return rows.select("path", decision.alias("decision"))


def _first_failures(decisions: DataFrame) -> DataFrame:
    """ledger, _stop: the place of each ledger's first refusal; one row a ledger that has one, summed up before any shuffle."""
    return decisions.filter("decision = 'refuse'").groupBy("ledger").agg(F.min("ord").alias("_stop"))


def until_failure(decisions: DataFrame) -> DataFrame:
    """Entries of each ledger before its first refusal, in order, and that one."""
    rows = decisions.join(_first_failures(decisions), "ledger", "left")
    return rows.filter(F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop"))).drop("_stop")


def transfer_outcome(entries: DataFrame, mode: str) -> DataFrame:
    """The entries (ledger, ord, target, size, decision, and what else they have) with ``status`` and ``detail`` after a transfer.

    A file whose source is gone is skipped and the transfer goes on; one that is refused has failed and ends its ledger, of which the
    rest stays pending. The others are ``moved`` or ``verified``.
    """
    rows = entries.join(_first_failures(entries), "ledger", "left")
    reached = F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop"))
    status = F.when(~reached, "pending").when(F.col("decision") == "skip", "skipped").when(F.col("decision") == "refuse", "failed").otherwise("moved" if mode == "move" else "verified")
    detail = F.when(reached & (F.col("decision") == "skip"), "source vanished").when(reached & (F.col("decision") == "refuse"), "target holds another file")
    return rows.withColumns({"status": status, "detail": detail}).drop("_stop")


def outcome_report(outcome: DataFrame) -> DataFrame:
    """ledger, transferred, reused, bytes, problems, outstanding, ok of a transfer."""
    done = F.col("status").isin("moved", "verified")
    fresh = done & (F.col("decision") == "transfer")
    pending = F.count_if(~F.col("status").isin(TERMINAL))
    return outcome.groupBy("ledger").agg(
        F.count_if(fresh).alias("transferred"),
        F.count_if(done & (F.col("decision") == "reuse")).alias("reused"),
        F.coalesce(F.sum(F.when(fresh, F.col("size"))), F.lit(0)).alias("bytes"),
        F.count("detail").alias("problems"),
        pending.alias("outstanding"),
        ((F.count("detail") == 0) & (pending == 0)).alias("ok"),
    )


def verify(ledger: DataFrame, there: DataFrame) -> DataFrame:
    """target, problem: missing, size drift (a size of 0 isn't compared), hash drift, outstanding."""
    rows = ledger.join(there.select("target", F.col("size").alias("s"), F.col("sha256").alias("h")), "target", "left")
    problem = F.when(~F.col("status").isin(TERMINAL), "outstanding").when(F.col("s").isNull(), "missing").when((F.col("size") > 0) & (F.col("s") != F.col("size")), "size drift").when(F.col("h") != F.col("sha256"), "hash drift")
    return rows.select("target", problem.alias("problem")).filter("problem is not null")


def ledger_status(ledger: DataFrame) -> DataFrame:
    """ledger, status counts as columns and whether it is complete."""
    count = lambda s: F.count_if(F.col("status") == s)
    return ledger.groupBy("ledger").agg(*[count(x).alias(x) for x in ("pending", "verified", "moved", "skipped", "failed")], F.bool_and(F.col("status").isin(TERMINAL)).alias("complete"))


def wide_to_long(metrics: DataFrame, run: str, step: str, series: list[str]) -> DataFrame:
    """run, step, series, value: one row for each column and step; missing values are left out."""
    return metrics.unpivot([run, step], series, "series", "value").filter("value is not null")


#: A comma outside quotes, and quotes around a field.
_COMMA, _QUOTES = r',(?=(?:[^"]*"[^"]*")*[^"]*$)', r'^\s*"?|"?\s*$'


def csv_series(files: DataFrame) -> DataFrame:
    """run, path, step, series, value of CSV files, each by the columns of its own header.

    ``files``: run, path, content, step (the name of its step column) and series (its value columns; null: all others whose cells are
    numbers). Cells that aren't numbers, lines without a step and columns that the header lacks give none. Fields may be quoted, but
    don't go over lines.
    """
    fields = lambda line: F.transform(F.split(line, _COMMA), lambda x: F.replace(F.regexp_replace(x, _QUOTES, ""), F.lit('""'), F.lit('"')))
    lines = F.split("content", r"\r?\n")
    rows = files.select("run", "path", "step", "series", fields(F.get(lines, F.lit(0))).alias("header"), F.explode(F.slice(lines, F.lit(2), F.size(lines))).alias("line")).filter("trim(line) <> ''")
    rows = rows.withColumn("cells", fields(F.col("line")))
    number = F.get("cells", (F.array_position("header", F.col("step")) - 1).cast("int")).try_cast("double")
    told = rows.select("run", "path", number.alias("at"), "step", "series", F.explode(F.arrays_zip("header", "cells")).alias("x"))
    wanted = (F.col("x.header") != F.col("step")) & (F.col("series").isNull() | F.array_contains("series", F.col("x.header")))
    return told.filter(wanted & F.col("at").isNotNull()).select("run", "path", F.col("at").alias("step"), F.col("x.header").alias("series"), F.col("x.cells").try_cast("double").alias("value")).filter("value is not null")


def ingest_fan_out(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """request, root, run: the runs at or below the root of each request (request, root), by equality joins on the folders above each run (``runs``: dir)."""
    above = runs.select(F.col("dir").alias("run"), F.explode(prefixes(F.split("dir", "/"), "/")).alias("root"))
    return requests.join(above, "root").select("request", "root", "run")


def ingest_counts(plan: DataFrame) -> DataFrame:
    """run, counts, skipped: what an ingestion plan takes in of each run, as format=number by format, and how many files it passes over."""
    each = plan.groupBy("run", "format").agg(F.count_if(F.col("action") == "ingest").alias("n"), F.count_if(F.col("action") == "skip").alias("skipped"))
    told = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("format", "n")))), lambda x: F.concat(x["format"], F.lit("="), x["n"]))  # of the formats there are
    return each.groupBy("run").agg(F.array_join(told, ", ").alias("counts"), F.sum("skipped").alias("skipped"))


def preconditions(requests: DataFrame) -> DataFrame:
    """request, violation: unknown mode, source or target inside the other, unknown format."""
    nested = F.concat("source", F.lit("/")).startswith(F.concat("target", F.lit("/"))) | F.concat("target", F.lit("/")).startswith(F.concat("source", F.lit("/")))
    rules = F.array_compact(F.array(F.when(~F.col("mode").isin("copy", "move"), F.lit("mode")), F.when(nested, F.lit("nested")), F.when(~F.col("format").isin("csv", "log", "json", "none"), F.lit("format"))))
    return requests.select("request", F.explode(rules).alias("violation"))


def layout_problems(paths: DataFrame) -> DataFrame:
    """path, problem of folders whose names aren't kebab-case, or whose runs lack the prefix."""
    segments = F.slice(F.split("path", "/"), 1, 2)
    odd = F.exists(segments, lambda s: ~s.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"))
    third = F.get(F.split("path", "/"), F.lit(2))
    problem = F.when(odd, "not kebab-case").when(third.isNotNull() & ~third.startswith("run-"), "no run prefix")
    return paths.select("path", problem.alias("problem")).filter("problem is not null")
