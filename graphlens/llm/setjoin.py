"""Exact search for similar sets: a join on their rarest members, pruned by length, place and parity, and its verification."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import U64, mixed

#: 64-bit numbers in a parity map, and members by whose order sets are chained.
MAP, CHAINED = 8, 4


def verified(pairs: DataFrame, bodies: DataFrame, sets: Callable, percent: int) -> DataFrame:
    """The pairs whose full sets meet 100 * intersection >= percent * union. ``bodies``: id, text; ``sets``: the sets of an Arrow column of texts."""
    both = pairs.select("a", "b").join(bodies.toDF("a", "text_a").hint("merge"), "a").join(bodies.toDF("b", "text_b").hint("merge"), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for s, t in zip(sets(batch.column(2)), sets(batch.column(3))):
                common = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                keep.append(len(s) > 0 and 100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """64 * MAP bits; a bit is the parity of the shingles that fall on it, so that maps differ in no more bits than sets in shingles."""
    bits = np.bincount((mixed(shingles + U64(5)) % U64(64 * MAP)).astype(np.int64), minlength=64 * MAP) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def set_pairs(bodies: DataFrame, sets: Callable, percent: int, keep: Callable, crowd: int, by_length: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of ``bodies`` (id, text, class), of different classes, that may meet ``percent``: none that does is missing.

    The members of the sets are ordered from the rarest. Sets of n and m <= n members that meet the threshold share at least percent * (n + m) /
    (100 + percent), so that the first one they share stands early in both; how much can follow it, and how many bits of the
    parity maps differ, bound the pair. A frequent member is compared in blocks of ``crowd`` rows, and one that only a single class
    holds isn't compared. ``by_length``: sets also meet only in partitions of their length or the next ones below.
    """
    maps = [f"m{k}" for k in range(MAP)]

    def run(batches):
        for batch in batches:
            found = list(sets(batch.column(1)))
            n = np.array([len(s) for s in found], dtype=np.int64)
            own = [batch.column(k).take(pa.array(np.repeat(np.arange(len(n)), n))) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate([np.zeros(0, U64), *found]).view(np.int64))], ["id", "class", "token"])

    def measured(batches):
        for batch in batches:
            own = list(sets(batch.column(1)))
            found = np.array([parity_map(s) for s in own]).reshape(-1, MAP)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in own], pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in found.T]], ["id", "class", "n", *maps])

    rows = keep(bodies.select("id", "text", "class").mapInArrow(measured, "id long, class long, n long, " + ", ".join(f"{m} long" for m in maps)), "maps")
    tokens = keep(bodies.select("id", "text", "class").mapInArrow(run, "id long, class long, token long"), "tokens")
    known = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.min("class").alias("low"), F.max("class").alias("high"))
    known = known.filter("rows > 1").selectExpr("token", "rows", "low <> high as several")  # shingles of one row are the rarest, and shared with none
    own = W.partitionBy("id")
    early = tokens.select("id", "token").join(known.hint("merge"), "token")
    early = early.withColumn("later", F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("rows", "token")))
    early = early.filter("several").select("id", "token", "later", F.expr(f"int((rows + {crowd - 1}) div {crowd})").alias("parts"))
    early = early.join(rows.hint("merge"), "id").withColumn("place", F.expr("n - 1 - later"))
    early = keep(early.filter(f"place <= n - (({percent} * n + 99) div 100)").drop("later"), "early")
    part, parts = F.expr("int(pmod(xxhash64(id), parts))"), F.expr("explode(sequence(0, parts - 1))")

    step = -math.log(percent / 100) if by_length else math.inf
    length = F.floor(F.log("n") / step).cast("int")  # 0 for all without a step

    def side(letter, p, q):
        return [F.col("token"), p.alias("p"), q.alias("q"), F.col("id").alias(letter), F.col("class").alias(f"c{letter}"), F.col("n").alias(f"n{letter}"), F.col("place").alias(f"at_{letter}"), *[F.col(m).alias(f"{letter}{m}") for m in maps]]

    lengths = F.explode(F.array(length, length - 1, length - 2)) if by_length else length  # the second below is for rounding
    one = early.withColumn("part", lengths).select("part", *side("x", part, parts))
    two = early.filter(f"place <= n - ((2 * {percent} * n + {99 + percent}) div {100 + percent})").withColumn("part", length).select("part", *side("y", parts, part))
    differ = " + ".join(f"bit_count(x{m} ^ y{m})" for m in maps)
    fits = (
        f"cx <> cy and (ny < nx or (ny = nx and y < x)) and 100 * ny >= {percent} * nx and {100 + percent} * least(nx - at_x, ny - at_y) >= {percent} * (nx + ny)"
        f" and {100 + percent} * ({differ}) <= {100 - percent} * (nx + ny)"
    )
    found = one.hint("merge").join(two, ["token", "p", "q", "part"]).filter(fits)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def chained_pairs(bodies: DataFrame, sets: Callable, percent: int) -> DataFrame:
    """Pairs (a, b) of ``bodies`` (id, text) that are neighbours by length among those that share one of their few smallest members.

    A set has as many pairs as members by which it is chained, at most; so large groups of similar sets are joined at little cost.
    """

    def run(batches):
        for batch in batches:
            found = list(sets(batch.column(1)))
            least = [s[:CHAINED] for s in found]  # sets are sorted
            k = np.array([len(s) for s in least], dtype=np.int64)
            own = batch.column(0).take(pa.array(np.repeat(np.arange(len(k)), k)))
            n = np.repeat(np.array([len(s) for s in found], dtype=np.int64), k)
            yield pa.RecordBatch.from_arrays([own, pa.array(n), pa.array(np.concatenate([np.zeros(0, U64), *least]).view(np.int64))], ["id", "n", "token"])

    rows = bodies.select("id", "text").mapInArrow(run, "id long, n long, token long")
    before = W.partitionBy("token").orderBy("n", "id")
    pairs = rows.withColumns({"a": F.lag("id").over(before), "m": F.lag("n").over(before)}).filter(f"100 * m >= {percent} * n")
    return pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
