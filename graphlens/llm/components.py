"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Links left, at most, that one task settles.
SETTLED = 100_000


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and component (smallest id reachable) of every id in the links (a, b) of a task: larger roots are hung on smaller ones until none differ."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    ends = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)]
    ids, at = np.unique(np.concatenate(ends), return_inverse=True)
    root, (a, b) = np.arange(len(ids)), at.reshape(2, -1)
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "component"])


def components(links: DataFrame, keep: Callable = staged) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every id in ``links`` (a, b).

    In each round every node joins the neighbour, or itself, of the smallest hash under that round's
    seed, and the links are renamed and made distinct; the number of nodes falls by a factor,
    so that the rounds grow with its logarithm; they end when ``SETTLED`` links or fewer are left. The tables of the rounds, and the result, are
    written by ``keep``; ``links`` should be stored. Hashes keep sorted chains from being slow.
    """
    settle = lambda x: x.select("a", "b").coalesce(1).mapInArrow(settled, "id long, component long")
    both = lambda x: x.select("a", "b").union(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if links.count() <= SETTLED:
        return keep(settle(links), "components")
    nodes = both(links).select(F.col("a").alias("id")).distinct()
    classes, edges, level = nodes.select("id", F.col("id").alias("class")), links.filter("a <> b").distinct(), 0
    edges = keep(edges, "links")
    while edges.count() > SETTLED:
        seed = F.lit(level)
        rank = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        joins = both(edges).groupBy("a").agg(F.min(F.least(rank("a"), rank("b"))).alias("m")).select(F.col("a").alias("x"), F.col("m.n").alias("y"))
        joins = keep(joins, "joins")
        classes = keep(classes.join(joins, F.col("class") == F.col("x"), "left").select("id", F.coalesce("y", "class").alias("class")), "classes")
        left, right = joins.toDF("a", "c"), joins.toDF("b", "d")
        renamed = edges.join(left, "a").join(right, "b").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))
        edges = keep(renamed.filter("a <> b").distinct(), "links")
        level += 1
    last = settle(edges).toDF("x", "y")
    classes = keep(classes.join(last, F.col("class") == F.col("x"), "left").select("id", F.coalesce("y", "class").alias("class")), "classes")
    least = classes.groupBy("class").agg(F.min("id").alias("component"))
    return keep(classes.join(least, "class").select("id", "component"), "components")
