"""Graph quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.schemas import STRUCTURAL_KINDS

# References that a file needs, and the share unresolved that it must exceed.
LEAST_REFS, MOST_UNRESOLVED = 5, 0.5


def undocumented(nodes: DataFrame) -> DataFrame:
    """Exported nodes, not structural, without docstring and summary."""
    bare = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return nodes.filter(F.col("is_exported") & ~F.col("kind").isin(STRUCTURAL_KINDS) & bare("docstring") & bare("summary")).select("id", "file", "start_line")


def untested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Public classes and functions that no tests edge comes to."""
    tested = edges.filter("kind = 'tests'").select(F.col("target").alias("id"))
    return nodes.filter(F.col("kind").isin("class", "function") & (F.col("visibility") == "public")).join(tested, "id", "left_anti").select("id", "file", "start_line")


def unresolved_files(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """file, unresolved, resolved, ratio of files where more than half of enough references stay unresolved."""
    open_refs = refs.groupBy("file").agg(F.count(F.lit(1)).alias("unresolved"))
    done = edges.filter("provenance = 'resolved'").groupBy("file").agg(F.count(F.lit(1)).alias("resolved"))
    rows = open_refs.join(done, "file", "left").withColumn("resolved", F.coalesce("resolved", F.lit(0)).cast("long"))
    total = F.col("unresolved") + F.col("resolved")
    return rows.filter((total >= LEAST_REFS) & (F.col("unresolved") / total > MOST_UNRESOLVED)).withColumn("ratio", F.round(F.col("unresolved") / total, 6))


def totals(nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """check, n: findings of each check."""
    found = {"undocumented": undocumented(nodes), "unresolved": unresolved_files(refs, edges), "untested": untested(nodes, edges)}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, df in found.items()]
    return counts[0].union(counts[1]).union(counts[2])
