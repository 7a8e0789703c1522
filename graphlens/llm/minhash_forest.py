"""Near-duplicate documents by an LSH forest of MinHash signatures.

Documents with the same shingle set count once. Their signatures are sorted in several orders, one
for each tree of the forest; neighbours with a common prefix of the least depth are candidates. A region, the
rows that share such a prefix, is taken whole if it is small and by deeper prefixes
if it is large, so that the depth adapts to each region. Candidates whose signatures are too
unlike are passed over (by more than five standard deviations), the others are confirmed on their
full sets.

Two passes keep large groups cheap: the first takes neighbours in a few of the trees and joins those
that are confirmed; the second takes neighbours and small regions in all trees, of rows that aren't joined yet.
Rows of large regions that still hold several classes after both passes are
compared exactly, by a join on the rarest shingles of their sets (``setjoin``).
Joins with texts are sort-merge joins at every size.

Defined results: null and empty texts have an empty set and are linked with nothing; rows with the
same set are linked whatever their number; rows that share a ``doc_id``, or have none, are judged each by its text;
a class without any ``doc_id`` has a null component; columns besides ``doc_id``
and ``text`` are ignored; an empty table gives no rows. ``drop_near_duplicates`` keeps all columns, whatever
their names, and every row without words; of rows with the same ``doc_id`` and text it keeps one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .bytewords import word_ranges
from .common import U64, Scratch, blocks, join_counted, mixed, partitions, range_hashes, staged, text_buffers, texts
from .components import components

#: Trees, depth at which a region begins and ends, rows of a region taken whole, and rows of a sorted run that a task holds.
TREES, LEAST_DEPTH, MOST_DEPTH, REGION, RUN_ROWS = 20, 4, 6, 8, 60_000
#: Trees of the first pass.
FIRST_TREES = 4
#: How far a signature's estimate may lie below the threshold.
MARGIN = 0.2
BLOCK = 1_000_000
#: Rows of a shingle that one block of the exact join takes from each side, and the mark of a row of a large region.
CROWD, LARGE = 1_000, -2

_table = np.arange(256, dtype=np.uint8)
_table[65:91] += 32
_LOWER = _table
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_FACTORS = mixed(np.arange(1, TREES * MOST_DEPTH + 1, dtype=U64)) | U64(1)
_SHIFTS = mixed(np.arange(1001, 1001 + TREES * MOST_DEPTH, dtype=U64))


def shingle_sets(column, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of an Arrow column without nulls."""
    data, offsets = text_buffers(column)
    for first, last in blocks(offsets, BLOCK):
        part = _LOWER[data[offsets[first] : offsets[last]]]
        at = offsets[first : last + 1] - offsets[first]
        yield from _sets_of_block(part, at, width)


def _sets_of_block(part: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    n = len(at) - 1
    if not len(part):
        yield from (np.zeros(0, U64) for _ in range(n))
        return
    start, end, firsts = word_ranges(part, at, ~_SPACE)
    hashes = range_hashes(part, start, end)
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(hashes) - width + 1), dtype=U64)
        for k in range(width):
            whole += hashes[k : k + len(whole)] * (_FACTORS[k] << U64(1) | U64(1))
        whole = mixed(whole)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                short = (hashes[a:b] * (_FACTORS[: b - a] << U64(1) | U64(1))).sum(dtype=U64)
                yield mixed(np.array([short + U64(b - a)], dtype=U64))
            else:
                yield np.zeros(0, U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value, tree by tree, big-endian so that bytes sort as numbers."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 512):
            own = shingles[k : k + 512, None] * _FACTORS + _SHIFTS
            np.minimum(out, own.min(axis=0), out=out)
    return (mixed(out) >> U64(48)).astype(">u2")


def text_key() -> Column:
    """Tells the texts of one ``doc_id`` apart."""
    return F.xxhash64("text").alias("th")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th, n_shingles, two 64-bit keys of the set, and its signature (null for the empty set)."""

    def run(batches):
        for batch in batches:
            n, one, two, signs = [], [], [], []
            for s in shingle_sets(batch.column(2), width):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    one.append(int(np.bitwise_xor.reduce(s)) if len(s) else 0)
                    two.append(int(mixed(s + U64(77)).sum(dtype=U64)) if len(s) else 0)
                signs.append(signature(s).tobytes() if len(s) else None)
            keys = [pa.array(np.array(x, dtype=U64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *keys, pa.array(signs, pa.binary())], ["doc_id", "th", "n_shingles", "k1", "k2", "sig"])

    return texts(docs).select("doc_id", text_key(), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, k1 long, k2 long, sig binary")


def _trees(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(n, TREES, 2 * MOST_DEPTH)[:, :trees]
        keys = np.ascontiguousarray(signs.transpose(1, 0, 2)).tobytes()
        key = pa.Array.from_buffers(pa.binary(2 * MOST_DEPTH), n * trees, [None, pa.py_buffer(keys)]).cast(pa.binary())
        repeat = [pa.array(np.tile(batch.column(k).to_numpy(), trees)) for k in (0, 2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(trees, dtype=np.int32), n)), key, *repeat], ["tree", "key", "id", "class", "size"])


def region_pairs(tree: np.ndarray, keys: np.ndarray, classes: np.ndarray, whole: bool) -> list[tuple[int, int]]:
    """Pairs of places in one sorted run whose rows are candidates and of different classes.

    Not ``whole``: neighbours with a common prefix of the least depth. ``whole``: also all pairs of each
    region that is small at some depth.
    """
    n = len(tree)
    if n < 2:
        return []
    same = tree[1:] == tree[:-1]
    equal = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1) * same
    near = np.flatnonzero((equal >= LEAST_DEPTH) & (classes[1:] != classes[:-1]))
    pairs = list(zip(near.tolist(), (near + 1).tolist()))
    if not whole:
        return pairs
    todo = [(0, n, LEAST_DEPTH)]
    while todo:
        low, high, depth = todo.pop()
        edges = np.flatnonzero(equal[low : high - 1] < depth) + low + 1
        starts, ends = np.append(low, edges), np.append(edges, high)
        several = ends - starts > 2  # neighbours are pairs already
        for a, b in zip(starts[several].tolist(), ends[several].tolist()):
            if (classes[a:b] == classes[a]).all():
                continue
            if b - a <= REGION:
                i, j = np.nonzero(np.triu(classes[a:b, None] != classes[None, a:b], 2))
                pairs += zip((i + a).tolist(), (j + a).tolist())
            elif depth < MOST_DEPTH:
                todo.append((a, b, depth + 1))
    return pairs


def _region_edges(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the regions of the least depth of one sorted run begin, and the run's end."""
    new = (tree[1:] != tree[:-1]) | (keys[1:, :LEAST_DEPTH] != keys[:-1, :LEAST_DEPTH]).any(axis=1)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(tree)]])


def large_regions(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in one sorted run of the rows whose region of the least depth isn't taken whole."""
    sizes = np.diff(_region_edges(tree, keys))
    return np.flatnonzero(np.repeat(sizes > REGION, sizes))


def _keys_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["key"].to_pylist()), dtype=">u2").reshape(-1, MOST_DEPTH)


def sorted_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """A sorted partition as runs of about ``most`` rows that end with a region; a longer region goes on with its last ``REGION`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= most:
            table = pa.Table.from_batches(held)
            last = int(_region_edges(table["tree"].to_numpy(), _keys_of(table))[-2])
            yield table.slice(0, last or size)
            held = table.slice(last or size - REGION).combine_chunks().to_batches()
            size = sum(b.num_rows for b in held)
    if size:
        yield pa.Table.from_batches(held)


def candidates(signed: DataFrame, whole: bool, percent: int, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a, b) of ``signed`` (id, sig, class, size), of different classes; and if ``whole`` the rows (tree, key, id) of large regions, by the key's least depth.

    Pairs whose sizes alone rule out ``percent`` are left out: an intersection is no larger than the smaller set. The sorted
    orders are cut into partitions at any row; the rows beside a cut are looked at again, together.
    """
    trees = TREES if whole else FIRST_TREES
    rows = signed.select("id", "sig", "class", "size").mapInArrow(lambda batches: _trees(batches, trees), "tree int, key binary, id long, class long, size long")
    ordered = rows.repartitionByRange(partitions(signed.sparkSession), "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    schema = "a long, b long, cut int, tree int, key binary, id long, class long, size long"
    names, beside_names = [x.split()[0] for x in schema.split(", ")], ["a", "b", "tree", "key", "id"]

    def pairs_of(table):
        pairs = region_pairs(table["tree"].to_numpy(), _keys_of(table), table["class"].to_numpy(), whole)
        at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        size, ids = table["size"].to_numpy()[at], table["id"].to_numpy()[at]
        ids = ids[100 * size.min(axis=1) >= percent * size.max(axis=1)]
        return pa.table({"a": ids.min(axis=1), "b": ids.max(axis=1)}).group_by(["a", "b"]).aggregate([])

    def large_of(table):
        own = table.take(pa.array(large_regions(table["tree"].to_numpy(), _keys_of(table)) if whole else [], pa.int64()))
        k = len(own)
        return pa.table([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([LARGE] * k, pa.int32()), own["tree"], pc.binary_slice(own["key"], 0, 2 * LEAST_DEPTH), own["id"], own["class"], own["size"]], names)

    def run(batches):
        part, side, last = TaskContext.get().partitionId(), REGION if whole else 1, None

        def beside(cut, own):
            k = len(own)
            return pa.table([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([cut] * k, pa.int32()), own["tree"], own["key"], own["id"], own["class"], own["size"]], names).to_batches()

        for table in sorted_runs(batches, RUN_ROWS):
            if last is None:
                yield from beside(part - 1, table.slice(0, side))
            found = pairs_of(table)
            yield from pa.table([found["a"], found["b"], *[pa.nulls(len(found), t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())]], names).to_batches()
            yield from large_of(table).to_batches()
            last = table if last is None or len(table) >= side else pa.concat_tables([last, table])
            last = last.slice(max(0, len(last) - side))
        if last is not None:
            yield from beside(part, last)

    def at_cut(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tree", "ascending"), ("key", "ascending"), ("id", "ascending")])
        found, large = pairs_of(table), large_of(table)
        k = len(found)
        pairs = pa.table([found["a"], found["b"], pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], beside_names)
        return pa.concat_tables([pairs, large.select(beside_names)])

    out = keep(ordered.mapInArrow(run, schema), "forest")
    beside = out.filter(f"cut <> {LARGE}").groupBy("cut").applyInArrow(at_cut, "a long, b long, tree int, key binary, id long")  # REGION rows at most, on either side
    every = out.filter(f"cut is null or cut = {LARGE}").select(*beside_names).union(beside)
    return every.filter("a is not null").select("a", "b").distinct(), every.filter("a is null").select("tree", "key", "id")


def _likely(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose share of equal signature values isn't far below the threshold."""
    ids = signed.select("id", "sig")
    both = pairs.join(ids.toDF("a", "sig_a").hint("merge"), "a").join(ids.toDF("b", "sig_b").hint("merge"), "b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array((one == two).mean(axis=1) >= threshold - MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, bodies: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets meet 100 * intersection >= percent * union. ``bodies``: id, text."""
    return setjoin.verified(pairs, bodies, lambda column: shingle_sets(column, width), percent)


def crowded(large: DataFrame, classes: DataFrame) -> DataFrame:
    """The ids of ``large`` (tree, key, id) whose region holds several of the ``classes`` (id, class)."""
    rows = large.join(classes.hint("merge"), "id")
    several = rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high")
    return join_counted(large, several.select("tree", "key", "n"), ["tree", "key"], large.count()).select("id").distinct()


def crowded_pairs(bodies: DataFrame, width: int, percent: int, keep: Callable = staged) -> DataFrame:
    """Distinct pairs (a, b) of ``bodies`` (id, text, class), of different classes, that may meet ``percent``: none that does is missing."""
    return setjoin.set_pairs(bodies, lambda column: shingle_sets(column, width), percent, keep, CROWD)


_SET = ["n_shingles", "k1", "k2"]


def _classified(docs: DataFrame, width: int, percent: int, keep: Scratch) -> DataFrame:
    """doc_id, th and n_shingles of every row, ``class`` (a number of its class; null for the empty set) and component_id."""
    rows = keep(sketches(docs, width), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("least")
    sets = rows.filter("n_shingles > 0").groupBy(*_SET).agg(least, F.first("sig").alias("sig"))
    sets = keep(sets.select(*_SET, F.monotonically_increasing_id().alias("id"), "least.doc_id", "least.th", "sig"), "sets")
    signed = sets.select("id", "sig", F.col("id").alias("class"), F.col("n_shingles").alias("size"))

    def bodies(ids: DataFrame, how: str = "left_semi", *more: str) -> DataFrame:
        """id and text of sets, each by its first row, and ``more`` columns of ``ids``."""
        wanted = sets.select("id", "doc_id", "th").join(ids.hint("merge"), "id", how).withColumnRenamed("doc_id", "own").withColumnRenamed("th", "own_th")
        found = texts(docs).select("doc_id", text_key(), "text").join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th")))
        return keep(found.select("id", "text", *more).dropDuplicates(["id"]), "bodies")

    def ends(pairs: DataFrame) -> DataFrame:
        """The ids of pairs, repeated: for semi and anti joins."""
        return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))

    pairs = keep(_likely(candidates(signed, False, percent, keep)[0], signed, percent / 100), "likely")
    known = bodies(ends(pairs))
    links = keep(confirmed(pairs, known, width, percent), "confirmed")

    joined = components(links, keep)
    again = keep(signed.drop("class").join(joined, "id", "left").select("id", "sig", F.coalesce("component", "id").alias("class"), "size"), "classed")
    found, large = candidates(again, True, percent, keep)
    rest = keep(_likely(found, signed, percent / 100), "rest")
    known = known.union(bodies(ends(rest).join(ends(pairs), "id", "left_anti")))
    links = links.union(keep(confirmed(rest, known, width, percent), "more-links"))  # of other classes than before, so none twice
    final = components(links, keep)

    classes = keep(signed.select("id").join(final, "id", "left").select("id", F.coalesce("component", "id").alias("class")), "classes")
    crowd = keep(crowded(keep(large, "large"), classes), "crowded")
    if not crowd.isEmpty():
        own = bodies(crowd.join(classes, "id"), "inner", "class")
        last = keep(crowded_pairs(own, width, percent, keep), "crowded-pairs")
        more = keep(confirmed(last, own.select("id", "text"), width, percent), "crowd-links")
        if not more.isEmpty():
            final = components(links.union(more), keep)
            classes = signed.select("id").join(final, "id", "left").select("id", F.coalesce("component", "id").alias("class"))

    members = keep(sets.select(*_SET, "id", "doc_id").join(classes, "id"), "members")
    named = members.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    classed = members.select(*_SET, "class").join(named, "class")
    out = rows.select("doc_id", "th", *_SET).join(classed, _SET, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", "n_shingles", "class", component.alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    with Scratch(docs.sparkSession, "near") as keep:
        out = _classified(docs, width, percent, keep).select("doc_id", "n_shingles", "component_id")
        return staged(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-classes")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of ``docs``, that of the smallest ``doc_id``, with its columns."""
    number = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    with Scratch(docs.sparkSession, "near") as keep:
        rows = keep(_classified(docs, width, percent, keep), "rows")
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
        firsts = rows.filter("class is not null").groupBy("class").agg(F.min(order).alias("first")).select("first.doc_id", "first.th")
        kept = staged(firsts.union(rows.filter("class is null").select("doc_id", "th").distinct()).select(number.alias("k"), "th"), "near-kept")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("k")
    packed = docs.select(key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), F.struct("*").alias("row"))
    return packed.groupBy("k", "th").agg(F.first("row").alias("row")).join(kept.hint("merge"), ["k", "th"], "left_semi").select("row.*")


# For four words and 80 per cent. Pairs are counted shingle by shingle, which suits small tables.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS t FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS c FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
