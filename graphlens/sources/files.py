"""Source-file scans, snapshot digests and published graph tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.text import LANGUAGES

MOST_BYTES = 1 << 20
#: Files of a source that are digested at once.
LINES = 100_000
EXCLUDED = [".git", "__pycache__", "node_modules", ".venv", "build", "dist"]


def glob_pattern(glob: str) -> str:
    """A glob as a pattern over whole paths; a glob without a slash may stand at any depth."""
    body = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else "\\" + p if p in ".^$+{}()|[]\\" else p for p in _pieces(glob.strip("/")))
    return f"^{body}(/.*)?$" if "/" in glob.strip("/") else f"(^|/){body}(/.*)?$"


def _pieces(glob: str) -> list[str]:
    out, k = [], 0
    while k < len(glob):
        step = 2 if glob[k : k + 2] == "**" else 1
        out.append(glob[k : k + step])
        k += step
    return out


def kept(path: Column, size: Column, ignored: list[str]) -> Column:
    """Whether a scan takes the file: a known extension, no excluded folder, no ignored glob, not too large."""
    known = F.lower(path).rlike(rf"\.({'|'.join(sorted(LANGUAGES))})$")
    out = rf"(^|/)({'|'.join(map(_escaped, EXCLUDED))})(/|$)"
    keep = known & ~path.rlike(out) & (size <= MOST_BYTES)
    for glob in ignored:
        keep = keep & ~path.rlike(glob_pattern(glob))
    return keep


def _escaped(name: str) -> str:
    return name.replace(".", r"\.")


def ignore_globs(spark: SparkSession, path: str) -> list[str]:
    """The globs of an ignore file: its lines but blank ones, comments and negations. A file that isn't there has none."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", path.rsplit("/", 1)[-1]).load(path.rsplit("/", 1)[0])
    lines = there.select(F.explode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("glob")).select(F.trim("glob").alias("glob"))
    return [r.glob for r in lines.filter("glob <> '' and not glob rlike '^[#!]'").collect()]  # the lines of one file


def scan(spark: SparkSession, root: str, ignored: list[str] = ()) -> DataFrame:
    """path (below ``root``), sha256 and size of the files that are taken; contents are read only for those."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.rstrip("/").replace("file:", "") + "/", "")
    return files.filter(F.col("length") <= MOST_BYTES).select(path.alias("path"), F.col("length").alias("size"), "content").filter(kept(F.col("path"), F.col("size"), list(ignored))).select("path", F.sha2("content", 256).alias("sha256"), "size")


def snapshot_digest(files: DataFrame, most: int = LINES) -> DataFrame:
    """source, snapshot_id, n: a digest over the paths and hashes of each source, in order of path.

    A source of more than ``most`` files is dealt by a hash of the path to parts that are digested each, and its id, of another kind,
    is the digest of those: so no task holds all lines of a source.
    """
    sizes = files.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    digits = F.when(F.col("n") <= most, 0).otherwise(F.ceil(F.log(16.0, F.col("n") / most))).cast("int")
    line = F.concat("path", F.lit("\0"), "hash", F.lit("\n"))
    rows = files.join(sizes, "source").select("source", "n", F.substring(F.sha2("path", 256), F.lit(1), digits).alias("part"), F.struct("path", line.alias("line")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "")  # about ``most`` lines
    parts = rows.groupBy("source", "n", "part").agg(F.sha2(text, 256).alias("digest"))
    whole = F.array_sort(F.collect_list(F.struct("part", "digest")))
    out = parts.groupBy("source", "n").agg(whole.alias("parts"))
    tree = F.concat(F.lit("local:tree:sha256-"), F.left(F.sha2(F.array_join(F.transform("parts", lambda x: F.concat(x["part"], F.lit(":"), x["digest"])), "\n"), 256), F.lit(32)))
    plain = F.concat(F.lit("local:hash:sha256-"), F.left(F.get("parts", F.lit(0))["digest"], F.lit(32)))
    return out.select("source", F.when(F.col("n") <= most, plain).otherwise(tree).alias("snapshot_id"), "n")


_MANIFEST = "snapshot_id string, attempt string, published_at timestamp, tables array<string>"


def publish(tables: dict[str, DataFrame], path: str, snapshot_id: str) -> str:
    """Writes the tables of a snapshot into folders of a new attempt, then a manifest row that names the attempt, which it returns.

    Nothing that a reader may hold is written over: until the row is there readers see the attempt before, and one that fails between
    two tables is never seen.
    """
    spark = next(iter(tables.values())).sparkSession
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}/snapshot_id={snapshot_id}/attempt={attempt}")
    row = spark.createDataFrame([(snapshot_id, attempt, datetime.now(timezone.utc), sorted(tables))], _MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return attempt


def current_attempts(spark: SparkSession, path: str) -> DataFrame:
    """snapshot_id, attempt: the last attempt that was published of each snapshot."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    return rows.groupBy("snapshot_id").agg(F.max(F.struct("published_at", "attempt"))["attempt"].alias("attempt"))


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the published snapshots, each in its last attempt; the others are pruned as partitions."""
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("snapshot_id", "attempt")})
    return rows.join(current_attempts(spark, path), ["snapshot_id", "attempt"], "left_semi").drop("attempt")


def superseded(spark: SparkSession, path: str, name: str) -> DataFrame:
    """snapshot_id, attempt of a table's folders that no reader of the manifest finds any more: failed attempts and replaced ones."""
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").select(*[F.col(c).cast("string").alias(c) for c in ("snapshot_id", "attempt")])
    return rows.distinct().join(current_attempts(spark, path), ["snapshot_id", "attempt"], "left_anti")


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of a table of ids; unknown ids are absent."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def by_values(nodes: DataFrame, column: str, asked: DataFrame) -> DataFrame:
    """The nodes (or file records) whose ``column`` (qualname, path) is among the asked ones, by id where there is one."""
    return nodes.join(asked.select(column).distinct(), column, "left_semi")


def by_kind(nodes: DataFrame, kind: str, limit: int) -> DataFrame:
    """The first nodes of a kind, by id."""
    return nodes.filter(F.col("kind") == kind).orderBy("id").limit(limit)


def edges_at(edges: DataFrame, ids: DataFrame, end: str, kinds: list[str] | None = None) -> DataFrame:
    """The edges whose ``end`` (source or target) is among the ids, of some kinds or all."""
    own = edges if kinds is None else edges.filter(F.col("kind").isin(kinds))
    return own.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")


def catalog(entries: DataFrame) -> DataFrame:
    """id, scope: a row for each scope of the entries that have an id and a scope; a scope that is a string is the only one."""
    if entries.schema["scope"].dataType.typeName() == "string":
        entries = entries.withColumn("scope", F.when(F.col("scope").isNotNull(), F.array("scope")))
    good = entries.filter((F.coalesce("id", F.lit("")) != "") & (F.size("scope") > 0))
    return good.select("id", F.explode("scope").alias("scope"))
