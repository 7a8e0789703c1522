"""Removal of byte strings that occur more than once, by interval expansion on a Burrows-Wheeler column.

Several lengths may be asked for at once. Every string of the smallest length holds an anchor, a gram that is the least by hash
among those of the string, and equal strings hold equal anchors at equal places. So suffixes need to be compared only
around anchors that occur again: a context is what a string of the greatest length over the anchor can reach.

* Where all contexts of an anchor, or several of them, are identical, all their bytes are repeated.
* The other contexts of an anchor are sorted by what follows it, as suffixes in a suffix array. The
  bytes before the suffixes make the Burrows-Wheeler column; extending all intervals of suffixes
  backward by one byte at a time, breadth first, splits them by that column. A suffix's common prefix
  with its neighbours grows by one with each step, and where it comes to a length that is asked for the string is
  repeated. An interval of one suffix is left; no step goes beyond the greatest length.
* An anchor with more contexts than a task should hold is divided by the steps that its strings go back. The
  strings of one range of steps agree in the bytes that all of them hold, so that contexts need to be compared only where these
  are equal, and only as far as the range goes; contexts that are identical so far count once. Ranges
  are divided again while one holds too many, down to single steps, where one context is left.

Equal contexts are told by 128 bits of BLAKE2b, all other equality by the bytes.

Defined results: null and empty texts have no bytes; a repeated row is a document with the same text,
so all strings of both are repeated; a null ``doc_id`` stays null; an empty table gives no rows;
columns besides ``doc_id`` and ``text`` don't matter, whatever their names. ``strip_repeats`` keeps every row, a
null text stays null, and a text that is all repeated becomes empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Scratch, blocks, byte_values, join_counted, ring_sums, ring_windows, staged, text_buffers, texts

#: Bytes of a repeated string, and of a shorter one that the report counts beside it: 50 words of four letters and a space.
LEAST, PASSAGE = 400, 250
BLOCK = 1_000_000
#: Contexts of one anchor that are compared at once, contexts of many anchors that make a group, and parts into which a range of steps is divided.
GROUP_CONTEXTS, GROUP, PARTS = 20_000, 4_000, 8

_KEY = ["dk", "rid"]
_ANCHORS = "dk long, rid long, pos int, before int, after int, fp long, c1 long, c2 long"
_CONTEXT = "dk long, rid long, pos int, before int, after int, fp long, bytes binary"
_CELLS = "dk long, rid long, pos int, before int, after int, fp long, bytes binary, lo int, hi int, c1 long, c2 long"
_SPANS = "dk long, rid long, s int, e int, least int"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _digest(raw, before: int) -> bytes:
    """128 bits that tell contexts apart, with the place of the anchor."""
    return hashlib.blake2b(raw, digest_size=16, salt=before.to_bytes(8, "little")).digest()


def gram_bytes(least: int) -> int:
    return max(1, least // 4)


def _row_keys(text: Column, doc_id: Column) -> list[Column]:
    """dk and rid tell rows apart, but for repeated ones."""
    doc_id = doc_id.cast("long")
    return [F.coalesce(doc_id, F.lit(-(2**63)).cast("long")).alias("dk"), F.xxhash64(F.coalesce(text, F.lit("")), doc_id).alias("rid")]


def _identified(docs: DataFrame) -> DataFrame:
    """dk, rid, text and doc_id."""
    return texts(docs).select(*_row_keys(F.col("text"), F.col("doc_id")), "text", "doc_id")


def anchors_of(data: np.ndarray, offsets: np.ndarray, least: int, reach: int) -> tuple[np.ndarray, ...]:
    """Anchors of a block of texts: text, place in it, bytes of the context before and after, gram hash, and two numbers of the context's digest."""
    k = gram_bytes(least)
    span = least - k + 1
    lengths = np.diff(offsets)
    if len(data) < least or lengths.max() < least:
        return (np.zeros(0, np.int64),) * 7
    sums = ring_sums(byte_values(data))
    at = np.arange(len(data) - k + 1)
    grams = ring_windows(sums, at, at + k)
    bits = U64(max(20, len(grams).bit_length()))
    low = (grams >> bits << bits) | at.astype(U64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    begins = np.zeros(len(data) + 1, dtype=np.int64)
    long = lengths >= least
    begins[offsets[:-1][long]] += 1
    np.add.at(begins, offsets[:-1][long] + lengths[long] - least + 1, -1)
    starts = np.flatnonzero(np.cumsum(begins)[: len(low)])
    chosen = np.unique(low[starts] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    text = np.searchsorted(offsets, chosen, "right") - 1
    place = chosen - offsets[text]
    before, after = np.minimum(place, reach - k), np.minimum(lengths[text] - place, reach)
    raw = data.tobytes()
    found = b"".join([_digest(raw[c - x : c + y], x) for c, x, y in zip(chosen.tolist(), before.tolist(), after.tolist())])
    context = np.frombuffer(found, dtype="<i8").reshape(-1, 2)
    return text, place, before, after, grams[chosen].view(np.int64), context[:, 0].copy(), context[:, 1].copy()


def anchors(rows: DataFrame, least: int, reach: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            dk, rid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = text_buffers(batch.column(2))
            for first, last in blocks(offsets, BLOCK):
                part = data[offsets[first] : offsets[last]]
                text, place, before, after, *numbers = anchors_of(part, offsets[first : last + 1] - offsets[first], least, reach)
                small = [pa.array(x.astype(np.int32)) for x in (place, before, after)]
                yield pa.RecordBatch.from_arrays([pa.array(dk[first + text]), pa.array(rid[first + text]), *small, *map(pa.array, numbers)], _names(_ANCHORS))

    return rows.select(*_KEY, "text").mapInArrow(run, _ANCHORS)


class _RangeMinimum:
    """Least of a range of a fixed array, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of values[low : high] for each pair, low < high."""
        out = np.zeros(len(low), dtype=self.levels[0].dtype)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.levels[k][low[own]], self.levels[k][high[own] - (1 << k)])
        return out


def expand(group: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray, lengths: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the ``lengths``, and each context, the least and the greatest step back at which a string of that length is repeated, or -1.

    ``left`` holds the bytes before the anchors, nearest first, and ``right`` those from the anchors on, both filled
    up with zeros; ``before`` and ``after`` say how many are real. Contexts of different ``group`` aren't compared.
    """
    n = len(group)
    out = [(np.full(n, -1), np.full(n, -1)) for _ in lengths]
    if n < 2:
        return out
    keys = np.concatenate([group.astype(">u4").view(np.uint8).reshape(n, 4), right, after.astype(">u2").view(np.uint8).reshape(n, 2), np.ones((n, 1), np.uint8)], axis=1)
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")
    group, left, right, before, after = group[order], left[order], right[order], before[order], after[order]
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
    common = np.where(group[1:] == group[:-1], np.minimum(common, np.minimum(after[1:], after[:-1])), 0)
    shared = _RangeMinimum(np.append(common, 0).astype(np.int32))
    suffix = np.arange(n)  # in suffix order, interval by interval
    interval = group.copy()
    for step in range(left.shape[1] + 1):
        together = interval[1:] == interval[:-1]
        prefix = np.zeros(len(suffix) + 1, dtype=np.int64)
        at = np.flatnonzero(together)
        prefix[at + 1] = shared(suffix[at], suffix[at + 1]) + step
        longest = np.maximum(prefix[:-1], prefix[1:])
        for (lowest, highest), length in zip(out, lengths):
            found = suffix[longest >= length] if step <= length - right.shape[1] + left.shape[1] else suffix[:0]  # the string holds the anchor
            lowest[found] = np.where(lowest[found] < 0, step, lowest[found])
            highest[found] = step
        if step == left.shape[1]:
            break
        several = np.append(together, False) | np.append(False, together)
        keep = several & (before[suffix] > step)
        suffix, interval = suffix[keep], interval[keep]
        if len(suffix) < 2:
            break
        split = (interval.astype(np.int64) << 8) | left[suffix, step]
        extended = np.argsort(split, kind="stable")
        suffix, split = suffix[extended], split[extended]
        interval = np.cumsum(np.append(False, split[1:] != split[:-1]))
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    return [(lowest[back], highest[back]) for lowest, highest in out]


def _compared(lengths: list[int]):
    k, reach = gram_bytes(min(lengths)), max(lengths)

    def run(table: pa.Table) -> pa.Table:
        n = len(table)
        before, after = table["before"].to_numpy(), table["after"].to_numpy()
        left, right = np.zeros((n, reach - k), np.uint8), np.zeros((n, reach), np.uint8)
        for i, x in enumerate(table["bytes"]):
            own = np.frombuffer(x.as_buffer(), dtype=np.uint8)
            left[i, : before[i]] = own[: before[i]][::-1]
            right[i, : after[i]] = own[before[i] :]
        group = np.unique(table["fp"].to_numpy(), return_inverse=True)[1]
        pos, out = table["pos"].to_numpy(), []
        for length, (lowest, highest) in zip(lengths, expand(group, left, right, before, after, lengths)):
            hit = lowest >= 0
            start, end = (pos - highest)[hit], (pos - lowest + length)[hit]
            keys = [table[c].filter(pa.array(hit)) for c in _KEY]
            out.append(pa.table([*keys, *[pa.array(x.astype(np.int32)) for x in (start, end, np.full(len(start), length))]], _names(_SPANS)))
        return pa.concat_tables(out)

    return run


def _contexts(bodies: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (keys, pos, before, after, fp) with the ``bytes`` of each context."""
    places = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("pos", "before", "after", "fp")).alias("at"))  # of one document

    def run(batches):
        for batch in batches:
            for dk, rid, text, at in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = text.encode()
                rows = [(dk, rid, x["pos"], x["before"], x["after"], x["fp"], raw[x["pos"] - x["before"] : x["pos"] + x["after"]]) for x in at]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _names(_CONTEXT))

    return bodies.dropDuplicates(_KEY).join(places.hint("merge"), _KEY).select(*_KEY, "text", "at").mapInArrow(run, _CONTEXT)


def _cells(level: DataFrame, least: int) -> DataFrame:
    """Contexts with a range of steps (lo, hi), divided: as far as each part of the range goes, and by the bytes that all its strings hold."""

    def divided(dk, rid, pos, before, after, fp, raw, lo, hi):
        width = -(-(hi - lo + 1) // PARTS)
        for low in range(lo, hi + 1, width):
            high = min(low + width - 1, hi)
            b, a = min(before, high), min(after, least - low)
            if b < low or b + a < least:  # no string of this context goes back so far
                continue
            held = raw[before - low : before + least - high]
            own = raw[before - b : before + a]
            group = hashlib.blake2b(held, digest_size=8, salt=low.to_bytes(8, "little"), person=fp.to_bytes(8, "little", signed=True)).digest()
            one = _digest(own, b)
            yield dk, rid, pos, b, a, int.from_bytes(group, "little", signed=True), own, low, high, int.from_bytes(one[:8], "little", signed=True), int.from_bytes(one[8:], "little", signed=True)

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = [cell for row in zip(*(c.to_pylist() for c in batch.columns)) for cell in divided(*row)]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _names(_CELLS))

    return level.select(*_names(_CELLS)[:-2]).mapInArrow(run, _CELLS)


def _whole(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """The whole contexts of ``rows`` (key, pos, before, after) as spans, for each length that they have."""
    size = F.col("before") + F.col("after")
    fitting = F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda x: x <= size)).alias("least")
    return rows.select(*_KEY, (F.col("pos") - F.col("before")).alias("s"), (F.col("pos") + F.col("after")).alias("e"), fitting)


def _settled(rows: DataFrame, kinds: DataFrame, total: int, lengths: list[int]) -> DataFrame:
    """The spans of ``rows`` (key, pos, before, after, fp, c1, c2) whose whole context stands elsewhere, at ``kinds`` with n > 1."""
    several = kinds.filter("n > 1").select("fp", "c1", "c2", "n")
    found = join_counted(rows.filter(F.col("before") + F.col("after") >= min(lengths)), several, ["fp", "c1", "c2"], total)
    return _whole(found, lengths)


def _sized(kinds: DataFrame, total: int) -> DataFrame:
    """``kinds`` of the groups (fp) with several of them, and their number as ``size``."""
    sizes = kinds.groupBy("fp").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("n", F.col("size"))
    return join_counted(kinds.drop("n"), sizes, ["fp"], total)


def repeated_spans(docs: DataFrame, lengths: list[int], keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """Spans (dk, rid, s, e, least) of repeated bytes for each of the ``lengths``, which may overlap, and the rows with repeated anchors (dk, rid, text)."""
    rows, reach = _identified(docs), max(lengths)
    found = keep.once(anchors(rows, min(lengths), reach), "anchors")
    total = found.count()
    one = F.struct("c1", "c2")
    counted = found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one"), F.max(one).alias("other")).filter("n > 1")
    counted = keep(counted.select("fp", "n", (F.col("one") == F.col("other")).alias("alike")), "counted")
    again = keep(join_counted(found, counted, ["fp"], total), "repeated")
    keep.drop("anchors")
    keys = again.select(*_KEY).distinct()
    bodies = keep(rows.select(*_KEY, "text").join(keys.hint("merge"), _KEY, "left_semi"), "bodies")

    spans = _whole(again.filter("alike"), lengths)
    unlike = again.filter(~F.col("alike")).drop("alike")
    kinds = unlike.groupBy("fp", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_KEY, "pos", "before", "after")).alias("first"))
    kinds = keep(kinds, "kinds")
    spans = spans.union(_settled(unlike, kinds, total, lengths))

    sized = _sized(kinds, total).select("first.*", "fp", "size")
    contexts = keep(_contexts(bodies, sized.drop("size")).join(sized.select(*_KEY, "pos", "size"), [*_KEY, "pos"]), "contexts")
    usual = contexts.filter(F.col("size") <= GROUP_CONTEXTS).drop("size")
    crowded = contexts.filter(F.col("size") > GROUP_CONTEXTS)
    for length in lengths if not crowded.isEmpty() else []:
        level = crowded.withColumns({"lo": F.lit(0), "hi": F.lit(length - gram_bytes(min(lengths)))})
        while not level.isEmpty():
            cells = keep(_cells(level, length), "cells")
            total = cells.count()
            kinds = cells.groupBy("fp", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*_names(_CONTEXT)[:5], "bytes", "lo", "hi")).alias("first"))
            kinds = keep(kinds, "kinds")
            spans = spans.union(_settled(cells, kinds, total, [x for x in lengths if x <= length]))
            sized = keep(_sized(kinds, total).select("first.*", "fp", "size"), "contexts")
            usual = usual.unionByName(sized.filter(F.col("size") <= GROUP_CONTEXTS).drop("size", "lo", "hi"))
            level = sized.filter(F.col("size") > GROUP_CONTEXTS)
    groups = max(1, math.ceil(usual.count() / GROUP))
    compared = usual.withColumn("part", F.pmod("fp", F.lit(groups))).groupBy("part").applyInArrow(_compared(lengths), _SPANS)
    return spans.union(compared), bodies


def merged(spans: list) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The spans without the characters that they hold in part."""
    for s, e in spans:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            yield s, e


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in spans:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


def _per_document(spans: DataFrame, *lengths: int) -> DataFrame:
    """dk, rid and ``spans`` of the first length, ``also`` of a second one."""
    of = lambda n: F.collect_set(F.when(F.col("least") == n, F.struct("s", "e")))  # noqa: E731  of one document
    return spans.groupBy(*_KEY).agg(*[of(n).alias(name) for n, name in zip(lengths, ("spans", "also"))])


def report(docs: DataFrame, least: int = LEAST, passage: int = PASSAGE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; and n_passage_bytes, how many a removal of strings of ``passage`` bytes would take."""

    def run(batches):
        for batch in batches:
            removed, n, sha, more = [], [], [], []
            for text, own, also in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                raw, own = text.encode(), merged(own)
                removed.append(sum(e - s for s, e in own))
                n.append(len(own))
                sha.append(hashlib.sha256(without(raw, own)).hexdigest())
                more.append(sum(e - s for s, e in merged(also)))
            numbers = [pa.array(x, pa.int64()) for x in (removed, n, more)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, pa.array(sha, pa.string())], [*_KEY, "n_removed", "n_spans", "n_passage_bytes", "cut_sha"])

    with Scratch(docs.sparkSession, "repeats", "zstd") as keep:
        spans, bodies = repeated_spans(docs, sorted({least, passage}), keep)
        found = bodies.dropDuplicates(_KEY).join(_per_document(spans, least, passage).hint("merge"), _KEY).select(*_KEY, "text", "spans", "also")
        cut = staged(found.mapInArrow(run, "dk long, rid long, n_removed long, n_spans long, n_passage_bytes long, cut_sha string"), "repeats")
    rows = _identified(docs).select("doc_id", *_KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans", "n_passage_bytes")]
    return rows.join(cut.hint("merge"), _KEY, "left").select("doc_id", "n_bytes", *numbers[:2], F.coalesce("cut_sha", "sha").alias("kept_sha256"), numbers[2])


def strip_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the repeated strings cut from ``text``, whole characters only; ``n_chars``, if there, follows."""
    with Scratch(docs.sparkSession, "repeats") as keep:
        per_doc = staged(_per_document(repeated_spans(docs, [least], keep)[0], least), "repeats")

    def run(batches):
        for batch in batches:
            column = batch.column(0).to_pylist()
            for i, own in enumerate(batch.column(1).to_pylist()):
                if own:
                    raw = column[i].encode()
                    column[i] = without(raw, list(whole_characters(raw, merged(own)))).decode()
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.string()), batch.column(2)], ["cut", "row"])

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    joined = docs.select(*_row_keys(F.col("text"), F.col("doc_id")), "text", rest).join(per_doc.hint("merge"), _KEY, "left").select("text", "spans", "row")
    out = joined.mapInArrow(run, T.StructType([T.StructField("cut", T.StringType()), T.StructField("row", joined.schema["row"].dataType)]))
    columns = [F.col("cut").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        columns[docs.columns.index("n_chars")] = F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.char_length("cut")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*columns)


def _spans_sql(k: int) -> str:
    """Relation s{k}: the maximal runs [s, e) of bytes that repeated strings of ``k`` bytes cover."""
    return f"""
b{k} AS (SELECT doc_id, h, unnest(range(0, n - {k - 1})) AS i FROM x),
c{k} AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, {2 * k})) AS g FROM b{k}),
g{k} AS (SELECT doc_id, i FROM c{k} WHERE g IN (SELECT g FROM c{k} GROUP BY 1 HAVING count(*) > 1)),
o{k} AS (SELECT doc_id, i, sum(CASE WHEN i > p + {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM (SELECT *, lag(i, 1, i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g{k})),
s{k} AS (SELECT doc_id, z, min(i) AS s, max(i) + {k} AS e FROM o{k} GROUP BY ALL)"""


# Over the hexadecimal bytes; every string is counted, which suits small tables.
ORACLE_SQL = f"""
WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),{_spans_sql(LEAST)},{_spans_sql(PASSAGE)},
k AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS f, e FROM s{LEAST}),
v AS (SELECT doc_id, sum(e - s)::BIGINT AS r, count(*) AS c, string_agg(substring(h, 2 * f + 1, 2 * (s - f)), '' ORDER BY s) || substring(any_value(h), 2 * max(e) + 1) AS t FROM k JOIN x USING (doc_id) GROUP BY 1),
q AS (SELECT doc_id, sum(e - s)::BIGINT AS r FROM s{PASSAGE} GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(v.r, 0) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256, coalesce(q.r, 0) AS n_passage_bytes FROM x LEFT JOIN v USING (doc_id) LEFT JOIN q USING (doc_id)
"""
