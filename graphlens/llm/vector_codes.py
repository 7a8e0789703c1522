"""Product quantisation by dual-tree Lloyd rounds.

Vectors are cut into equal parts; each part position has a codebook of integer entries. A task builds a tree of boxes
over the parts of each block of its rows, for all part positions at once, with the sums of every node, and a tree over
each codebook. Pairs of nodes go down both trees, level by level: the least distance between two boxes against the
smallest greatest distance that a part's node has to any of its partners prunes a pair. A node with one entry left takes
it whole and adds its cached sum; the points of leaves with several entries left are compared in integers.

Every task sends one row for each part position and entry, so that a round moves no vectors; the driver holds the
codebooks only, parts times entries in number.

Defined results: rows with a null vector or a null or infinite component are dropped; a row without a ``vec_id`` comes
last in the order of the first entries, and rows of one ``vec_id`` are ordered by their vectors. Vectors are filled up
with zeros to a multiple of the number of parts; components beyond 2**26 count as 2**26. With fewer rows than entries the
codebooks are as small. Repeated rows are rows like others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, staged
from .vectors import complete_rows, matrix, widened

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows of a block at most, and points of a leaf.
BLOCK, LEAF = 8_192, 8


class Boxes:
    """A tree over each part position's points: points in tree order, and by level the nodes' boxes.

    ``points``: parts x n x width. The number of points is filled up to ``leaf`` times a power of two with the last point,
    which counts 0 there.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        parts, self.n, width = points.shape
        depth = max(0, int(np.ceil(np.log2(max(self.n, 1) / leaf))))
        size = leaf << depth
        points = np.concatenate([points, np.repeat(points[:, -1:], size - self.n, axis=1)], axis=1)
        order = np.broadcast_to(np.arange(size), (parts, size)).copy()
        for level in range(depth):
            nodes = 1 << level
            own = points.reshape(parts, nodes, size >> level, width)
            widest = (own.max(axis=2) - own.min(axis=2)).argmax(axis=2)
            rank = np.take_along_axis(own, widest[:, :, None, None], axis=3)[..., 0].argsort(axis=2, kind="stable")
            points = np.take_along_axis(own, rank[..., None], axis=2).reshape(parts, size, width)
            order = np.take_along_axis(order.reshape(rank.shape), rank, axis=2).reshape(parts, size)
        self.points, self.order, self.depth, self.size = points, order, depth, size
        leaves = points.reshape(parts, 1 << depth, leaf, width)
        low, high = [leaves.min(axis=2)], [leaves.max(axis=2)]
        for _ in range(depth):
            low.append(low[-1].reshape(parts, -1, 2, width).min(axis=2))
            high.append(high[-1].reshape(parts, -1, 2, width).max(axis=2))
        self.low = [x.reshape(-1, width) for x in reversed(low)]
        self.high = [x.reshape(-1, width) for x in reversed(high)]
        self.leaf = leaf

    def with_sums(self) -> Boxes:
        """Adds each node's sum of points and number of points, by level."""
        parts, _, width = self.points.shape
        real = self.order < self.n
        total = [(self.points * real[..., None]).reshape(parts, -1, self.leaf, width).sum(axis=2)]
        count = [real.reshape(parts, -1, self.leaf).sum(axis=2)]
        for _ in range(self.depth):
            total.append(total[-1].reshape(parts, -1, 2, width).sum(axis=2))
            count.append(count[-1].reshape(parts, -1, 2).sum(axis=2))
        self.total = [x.reshape(-1, width) for x in reversed(total)]
        self.count = [x.reshape(-1) for x in reversed(count)]
        return self


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


def _firsts(node: np.ndarray) -> np.ndarray:
    """Where each node's pairs start; pairs are in the order of their nodes."""
    return np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)


def _by_group(least: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(least, np.diff(np.append(start, n)))


def assign(tree: Boxes, books: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Nearest entries of all points of ``tree`` among ``books`` (parts x entries x width); of equal distances the lower entry.

    Returns the nodes taken whole (level, nodes, entries), and places (part times size plus place in the tree) and entries
    of the points that were compared one by one.
    """
    parts, entries, width = books.shape
    entry_tree = Boxes(books, 1)
    real = entry_tree.order < entries  # filled-up entries are none
    alive = [real.reshape(-1)]
    for _ in range(entry_tree.depth):
        alive.append(alive[-1].reshape(-1, 2).any(axis=1))
    alive.reverse()
    node, other = np.arange(parts), np.arange(parts)
    at, own = 0, 0  # levels in both trees
    whole, places, chosen = [], [], []
    while len(node):
        if own < entry_tree.depth and (at >= min(2, tree.depth) and own <= at or at == tree.depth):
            own += 1
            node, other = np.repeat(node, 2), (2 * other[:, None] + np.arange(2)).ravel()
            keep = alive[own][other]
        elif at < tree.depth:
            at += 1
            pairs = np.diff(np.append(_firsts(node), len(node)))  # pairs of each node: its children get the same
            start = _firsts(node)
            size = np.repeat(pairs, 2)
            ends = np.cumsum(size)
            step = np.arange(2 * len(node)) - np.repeat(ends - size, size)
            other = other[np.repeat(np.repeat(start, 2), size) + step]
            node = np.repeat((2 * node[start][:, None] + np.arange(2)).ravel(), size)
            keep = np.ones(len(node), bool)
        else:
            break
        node, other = node[keep], other[keep]
        a, b, c, d = tree.low[at][node], tree.high[at][node], entry_tree.low[own][other], entry_tree.high[own][other]
        nearest = _squares(np.maximum(np.maximum(c - b, a - d), 0))
        farthest = _squares(np.maximum(b - c, d - a))
        start = _firsts(node)
        keep = nearest <= _by_group(np.minimum.reduceat(farthest, start), start, len(node))
        if own == entry_tree.depth:  # single entries: against the one whose greatest distance is least
            entry = entry_tree.order.ravel()[other]
            best = _by_group(np.minimum.reduceat(farthest, start), start, len(node))
            lead = _by_group(np.minimum.reduceat(np.where(farthest == best, entry, entries), start), start, len(node))
            rival = books[node >> at, lead]
            more = c - rival
            gap = _squares(c) - _squares(rival) - 2 * np.maximum(a * more, b * more).sum(axis=1)
            keep &= (gap < 0) | ((gap == 0) & (entry < lead)) | (entry == lead)
        node, other = node[keep], other[keep]
        if own == entry_tree.depth:
            start = _firsts(node)
            size = np.diff(np.append(start, len(node)))
            done = start[size == 1]
            whole.append((at, node[done], entry_tree.order.ravel()[other[done]]))
            keep = np.repeat(size > 1, size)
            node, other = node[keep], other[keep]
    if len(node):  # leaves with several entries left
        order = np.lexsort((entry_tree.order.ravel()[other], node))
        node, entry = node[order], entry_tree.order.ravel()[other[order]]
        points = tree.points.reshape(-1, tree.leaf, width)
        start = _firsts(node)
        gone = ((points[node] - books[node >> tree.depth, entry][:, None]) ** 2).sum(axis=2)
        least = np.minimum.reduceat(gone, start, axis=0)
        size = np.diff(np.append(start, len(node)))
        hit = np.where(gone == np.repeat(least, size, axis=0), entry[:, None], entries)
        places.append((node[start][:, None] * tree.leaf + np.arange(tree.leaf)).ravel())
        chosen.append(np.minimum.reduceat(hit, start, axis=0).ravel())
    none = np.zeros(0, np.int64)
    return whole, np.concatenate([none, *places]), np.concatenate([none, *chosen])


def sums(tree: Boxes, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part position and entry: the sum of the points that are nearest to it, and their number."""
    parts, entries, width = books.shape
    total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    whole, places, chosen = assign(tree, books)
    for level, node, entry in whole:
        key = (node >> level) * entries + entry
        np.add.at(total, key, tree.total[level][node])
        np.add.at(count, key, tree.count[level][node])
    real = tree.order.ravel()[places] < tree.n
    places, chosen = places[real], chosen[real]
    key = places // tree.size * entries + chosen
    np.add.at(total, key, tree.points.reshape(-1, width)[places])
    np.add.at(count, key, 1)
    return total.reshape(books.shape), count.reshape(parts, entries)


def codes(tree: Boxes, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each row (rows x parts), and its squared distance summed over parts."""
    parts, _, width = books.shape
    entry = np.zeros((parts, tree.size), np.int64)
    whole, places, chosen = assign(tree, books)
    for level, node, own in whole:
        size = tree.size >> level
        entry.reshape(-1, size)[node] = own[:, None]
    entry.reshape(-1)[places] = chosen
    gone = ((tree.points - np.take_along_axis(books, entry[..., None], axis=1)) ** 2).sum(axis=2)
    out, error = np.zeros((tree.size, parts), np.int64), np.zeros(tree.size, np.int64)
    for k in range(parts):
        out[tree.order[k], k] = entry[k]
        error[tree.order[k]] += gone[k]
    return out[: tree.n], error[: tree.n]


def _trees(batches: Iterator[pa.RecordBatch], column: int, width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, Boxes]]:
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            block = whole.slice(at, BLOCK)
            rows = widened(matrix(block.column(column)), parts * width)
            yield block, Boxes(np.ascontiguousarray(rows.reshape(len(rows), parts, width).transpose(1, 0, 2)), LEAF)


def lloyd(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floors of the means; entries without points stay."""
    parts, entries, width = books.shape
    names = [f"s{k}" for k in range(width)]

    def run(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, tree in _trees(batches, 0, width, parts):
            more, n = sums(tree.with_sums(), books)
            total += more
            count += n
        key = np.flatnonzero(count)
        columns = [pa.array(key, pa.int64()), pa.array(count.ravel()[key]), *[pa.array(total.reshape(-1, width)[key, k]) for k in range(width)]]
        yield pa.RecordBatch.from_arrays(columns, ["key", "n", *names])

    partial = rows.select("embedding").mapInArrow(run, ", ".join(f"{x} long" for x in ["key", "n", *names]))
    found = partial.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).toArrow()  # parts * entries rows at most
    out = books.reshape(-1, width).copy()
    if len(found):
        total = np.stack([found[x].to_numpy() for x in names], axis=1)
        out[found["key"].to_numpy()] = total // found["n"].to_numpy()[:, None]
    return out.reshape(books.shape)


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) of complete rows, from the rows with the smallest ``vec_id``."""
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    width = max(1, -(-(longest or 0) // parts))
    start = widened(matrix(pa.array([r.embedding for r in first], pa.list_(pa.float64()))), parts * width)
    books = np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        books = lloyd(rows, books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error of complete rows."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("a code has two hex digits: 256 entries at most")

    def run(batches):
        for block, tree in _trees(batches, 2, width, parts):
            code, error = codes(tree, books)
            text = code.astype(np.uint8).tobytes().hex().encode()
            offsets = (np.arange(len(error) + 1) * 2 * parts).astype(np.int32)
            column = pa.StringArray.from_buffers(len(error), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), column, pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, label long, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def quantised(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all rows of the label, null labels together), codebooks_sha256."""
    rows = complete_rows(embeddings, F.col("label"))
    books = trained(rows, parts, entries, rounds)
    found = encoded(rows, books).select("vec_id", "code", "error", F.coalesce("label", F.lit(0)).alias("_label"), F.col("label").isNull().alias("_none"))
    found = staged(found, "codes")
    by_label = staged(found.groupBy("_label", "_none").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    total = by_label.agg(F.sum("n")).first()[0] or 0
    joined = join_counted(found, by_label, ["_label", "_none"], total)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(name: str, book: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT v, label, p.part, p.x, min(struct_pack(d := (p.x[1]-c.x[1])*(p.x[1]-c.x[1]) + (p.x[2]-c.x[2])*(p.x[2]-c.x[2]) + (p.x[3]-c.x[3])*(p.x[3]-c.x[3]) + (p.x[4]-c.x[4])*(p.x[4]-c.x[4]), e := c.entry)) AS a
  FROM p JOIN {book} c ON p.part = c.part GROUP BY ALL)"""


def _updated(name: str, assigned: str, book: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT c.part, c.entry, CASE WHEN n IS NULL THEN c.x ELSE s END AS x FROM {book} c LEFT JOIN (
    SELECT part, a.e AS entry, count(*) AS n, [floor(sum(x[1]) / count(*))::BIGINT, floor(sum(x[2]) / count(*))::BIGINT, floor(sum(x[3]) / count(*))::BIGINT, floor(sum(x[4]) / count(*))::BIGINT] AS s
    FROM {assigned} GROUP BY ALL) u ON c.part = u.part AND c.entry = u.entry)"""


#: For vectors of 64 components: 16 parts of 4.
ORACLE_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id AS v, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e, row_number() OVER (ORDER BY vec_id) - 1 AS place
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT v, label, place, part, e[4 * part + 1 : 4 * part + 4] AS x FROM k, range(16) t(part)),
c0 AS MATERIALIZED (SELECT part, place AS entry, x FROM p WHERE place < 64),
{_assigned("a0", "c0")},{_updated("c1", "a0", "c0")},{_assigned("a1", "c1")},{_updated("c2", "a1", "c1")},{_assigned("a2", "c2")},
r AS MATERIALIZED (SELECT v, label, string_agg(printf('%02x', a.e), '' ORDER BY part) AS code, sum(a.d)::BIGINT AS error FROM a2 GROUP BY v, label),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT v AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h
"""
