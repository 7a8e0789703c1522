"""Hard negatives by Kronecker-packed products.

Several candidates' components, made positive by a bias, lie in separate fields of one wide integer. One multiplication
for each component of an anchor then gives the anchor's products with all of them; the sums are taken out of their
fields and are exact. The wide integers are held in doubles (53 bits), where the matrix product of BLAS multiplies them
and every partial sum is below 2**53; numbers too large for two fields of a double go into 64-bit integers.

The anchors, a stated set of rows, are taken in blocks of ``ANCHORS``: each block is sent to all tasks, which read the
whole table once for the positives and once for the negatives. A task keeps only the first rows of each anchor.

Defined results: rows with a null label, a null vector or a null or infinite component take no part; a row without a
``vec_id`` is never an anchor and comes last among equal scores. Rows with the anchor's ``vec_id`` are the anchor itself.
Of anchors with one ``vec_id`` one is taken (the least label, then vector); repeated rows are candidates each. Short
vectors are filled up with zeros; components beyond 2**26 count as 2**26. Columns besides ``vec_id``, ``label`` and
``embedding`` are ignored; an empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import shared_dir
from .vectors import complete_rows, matrix, widened

#: Anchors of a pass over the table; of those, anchors of one product; candidates of one product.
ANCHORS, SIDE, BATCH = 16_384, 512, 4_096
#: A candidate without a vec_id within the tasks.
_NONE = np.iinfo(np.int64).max
_LEAST = np.iinfo(np.int64).min
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Packed:
    """Candidates packed for products with any of ``anchors``."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        self.n, width = rows.shape
        self.bias = max(0, -int(rows.min(initial=0)))
        biased = rows + self.bias
        bound = int(np.abs(anchors).sum(axis=1).max(initial=0)) * int(biased.max(initial=0))
        self.bits = bound.bit_length() + 1
        self.kind, self.fields = (np.float64, 53 // self.bits) if 2 * self.bits <= 53 else (np.int64, max(1, 63 // self.bits))
        self.lines = -(-self.n // self.fields) if self.n else 0
        spread = np.zeros((self.fields * self.lines, width), np.int64)
        spread[: self.n] = biased
        wide = np.zeros((self.lines, width), np.int64)
        for k in range(self.fields):
            wide += spread[k * self.lines : (k + 1) * self.lines] << (self.bits * k)
        self.wide = np.ascontiguousarray(wide.T.astype(self.kind))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The inner products, a row for each anchor and a column for each candidate."""
        sums = (anchors.astype(self.kind) @ self.wide).astype(np.int64)
        back = self.bias * anchors.sum(axis=1, keepdims=True)
        if self.fields == 1:
            return sums - back
        half = 1 << (self.bits - 1)
        sums += sum(half << (self.bits * k) for k in range(self.fields))
        out = np.empty((len(anchors), self.fields * self.lines), np.int64)
        for k in range(self.fields):
            np.bitwise_and(sums >> (self.bits * k), (1 << self.bits) - 1, out=out[:, k * self.lines : (k + 1) * self.lines])
        out -= back + half
        return out[:, : self.n]


class First:
    """The first ``most`` rows of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, most: int):
        self.most, self.least = most, np.full(slots, _LEAST)
        self.rows = [np.zeros(0, np.int64)] * 3

    def add(self, *more: np.ndarray) -> None:
        """Rows as slots, scores and ids."""
        if not len(more[0]):
            return
        slot, score, name = (np.concatenate(x) for x in zip(self.rows, more))
        order = np.lexsort((name, -score, slot))
        slot, score, name = slot[order], score[order], name[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
        keep = place < self.most
        self.rows = [slot[keep], score[keep], name[keep]]
        full = place == self.most - 1
        self.least[slot[full]] = score[full]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """vec_ids, labels and vectors, ``BATCH`` rows at most."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            part = whole.slice(at, BATCH)
            yield part.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), matrix(part.column(2))


def _sides(names: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> list[slice]:
    return [slice(a, min(a + SIDE, len(names))) for a in range(0, len(names), SIDE)]


def _products(batches: Iterator[pa.RecordBatch], vectors: np.ndarray, sides: list[slice]) -> Iterator[tuple]:
    """Of each block of candidates and each side of anchors: the side's number, scores, and the block's ids and labels."""
    for name, label, rows in _blocks(batches):
        width = max(rows.shape[1], vectors.shape[1])
        packed = Packed(widened(rows, width), vectors)
        for k, side in enumerate(sides):
            yield k, packed.scores(widened(vectors[side], width)), name, label


def _positives(block, most: int):
    """Partial results of a task: anchor, score, name of the first rows of the anchor's label."""

    def run(batches):
        names, labels, vectors = block.value
        sides = _sides(*block.value)
        found = [First(s.stop - s.start, most) for s in sides]
        for k, scores, name, label in _products(batches, vectors, sides):
            side, own = sides[k], found[k]
            fit = (labels[side, None] == label) & (names[side, None] != name) & (scores >= own.least[:, None])
            slot, at = np.nonzero(fit)
            own.add(slot, scores[slot, at], name[at])
        for side, own in zip(sides, found):
            slot, score, name = own.rows
            yield pa.RecordBatch.from_arrays([pa.array(slot + side.start, pa.int64()), pa.array(score), pa.array(name)], ["anchor", "score", "name"])

    return run


def _negatives(block, wanted, most: int):
    """Partial results of a task: slot (anchor times positives, plus the positive's number), score, name within the slot's bounds."""

    def run(batches):
        names, labels, vectors = block.value
        lows, highs = wanted.value
        each = lows.shape[1]
        sides = _sides(*block.value)
        found = [First((s.stop - s.start) * each, most) for s in sides]
        for k, scores, name, label in _products(batches, vectors, sides):
            side, own = sides[k], found[k]
            low = np.maximum(lows[side], own.least.reshape(-1, each))
            fit = (labels[side, None] != label) & (scores >= low.min(axis=1, keepdims=True)) & (scores <= highs[side].max(axis=1, keepdims=True))
            row, at = np.nonzero(fit & (names[side, None] != name))
            score = scores[row, at]
            for p in range(each):
                hit = (score >= low[row, p]) & (score <= highs[side][row, p])
                own.add(row[hit] * each + p, score[hit], name[at[hit]])
        for side, own in zip(sides, found):
            slot, score, name = own.rows
            yield pa.RecordBatch.from_arrays([pa.array(slot + side.start * each, pa.int64()), pa.array(score), pa.array(name)], ["slot", "score", "name"])

    return run


def _first(partial: DataFrame, slot: str, most: int) -> DataFrame:
    """The first ``most`` of each slot with ``rank`` from 1; a task gives a slot ``most`` rows at most."""
    order = W.partitionBy(slot).orderBy(F.desc("score"), F.asc("name"))
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _taken(anchors: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors in blocks of ``most`` rows; the driver holds one block and one partition at a time."""
    held: list = []

    def block():
        lists = pa.array([r.embedding for r in held], pa.list_(pa.float64()))
        return np.array([r.vec_id for r in held], np.int64), np.array([r.label for r in held], np.int64), matrix(lists)

    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == most:
            yield block()
            held = []
    if held:
        yield block()


def mine(embeddings: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first rows of the same label; a positive's negatives are the first rows of another label
    with a score of ``low`` to ``high`` percent of the positive's.
    """
    spark = embeddings.sparkSession
    rows = complete_rows(embeddings.filter(label.isNotNull()), label)
    chosen = rows.filter(F.col("vec_id").isNotNull() & is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.label", "row.embedding")
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], _RESULT).write.parquet(path)
    for names, labels, vectors in _taken(chosen, anchors):
        block = spark.sparkContext.broadcast((names, labels, vectors))
        best = _first(rows.mapInArrow(_positives(block, positives), "anchor long, score long, name long"), "anchor", positives)
        found = best.toArrow()  # at most ``positives`` rows for each anchor of the block
        at, rank = found["anchor"].to_numpy(), found["rank"].to_numpy() - 1
        score, name = np.zeros((2, len(names), positives), np.int64)
        score[at, rank], name[at, rank] = found["score"].to_numpy(), found["name"].to_numpy()
        lows, highs = -((-low * score) // 100), (high * score) // 100
        there = np.zeros(score.shape, bool)
        there[at, rank] = True
        lows[~there], highs[~there] = _NONE, _LEAST
        wanted = spark.sparkContext.broadcast((lows, highs))
        rest = _first(rows.mapInArrow(_negatives(block, wanted, negatives), "slot long, score long, name long"), "slot", negatives)

        def told(batches, names=names, score=score, name=name):
            for b in batches:
                anchor, p = np.divmod(b.column(0).to_numpy(), score.shape[1])
                ids = [pa.array(x, mask=x == _NONE) for x in (name[anchor, p], b.column(2).to_numpy())]
                yield pa.RecordBatch.from_arrays([pa.array(names[anchor]), ids[0], b.column(3), ids[1], pa.array(score[anchor, p]), b.column(1)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        rest.select("slot", "score", "name", "rank").mapInArrow(told, _RESULT).write.mode("append").parquet(path)
        block.unpersist()
        wanted.unpersist()
    return spark.read.schema(_RESULT).parquet(path)


#: The query's job: labels moved by one where vec_id is divisible by 7, anchors divisible by 50.
ORACLE_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
