"""Best-fit packing of documents into sequences, improved by swap-based local search.

Pieces are dealt at random to groups of bounded size. A group is packed best-fit, longest first;
then a local search over its underfull bins moves documents, exchanges one for one and two for
one, each step raising the sum of squared fills, until bins run empty. The emptiest bins of
several groups are opened again and packed together, level by level, until one group is left.
So no task holds more than a bounded number of pieces, whatever the input.

Defined results: a null or empty text is a document of its end id alone; repeated rows are packed
each; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged, texts, with_fields
from .pretoken import library_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces in a group, underfull bins that a group passes on, and groups that meet at the next level.
GROUP_PIECES, PASSED_ON, MEET = 16_384, 48, 16


def pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int) -> DataFrame:
    """Documents as pieces of at most ``most`` ids; only longer ones are cut, and only the first piece may be shorter."""

    def run(batches):
        encoder = library_encoder(tokenizer)
        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for n, ids, lengths in encoder.batches(batch.column(1).to_pylist()):
                rows = []
                ids = np.insert(ids, np.cumsum(lengths), end_id).astype("<u4")
                data, first = memoryview(ids.tobytes()), 0
                for k, size in enumerate((lengths + 1).tolist()):
                    start = 0
                    stop = (size - 1) % most + 1
                    piece = 0
                    while start < size:
                        crc = zlib.crc32(data[4 * (first + start) : 4 * (first + stop)])
                        rows.append((doc_ids[at + k], piece, start, stop - start, crc))
                        start, stop, piece = stop, stop + most, piece + 1
                    first += size
                at += n
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, PIECES)


def _lowest_bit(x: int) -> int:
    return (x & -x).bit_length() - 1


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes; each piece goes to the bin that it leaves with the least room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i, size in sorted(enumerate(lengths), key=lambda x: (-x[1], x[0])):
        fit = rooms >> size
        if fit:
            room = size + _lowest_bit(fit)
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room - size:
            with_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


class _Holders:
    """Bins by what they can give: a piece of a length, or two pieces of a sum of lengths."""

    def __init__(self, measure):
        self.measure, self.bins, self.there = measure, {}, 0  # bit x of ``there``: some bin can give x

    def enter(self, k: int, sizes: Counter) -> None:
        for x in self.measure(sizes):
            self.bins.setdefault(x, set()).add(k)
            self.there |= 1 << x

    def leave(self, k: int, sizes: Counter) -> None:
        for x in self.measure(sizes):
            self.bins[x].discard(k)
            if not self.bins[x]:
                del self.bins[x]
                self.there &= ~(1 << x)

    def greatest(self, above: int, most: int) -> int:
        """The greatest x with above < x <= most that a bin can give, or 0."""
        found = (self.there & ((1 << most + 1) - 1)) >> (above + 1)
        return above + found.bit_length() if found else 0


def _pair_sums(sizes: Counter) -> set[int]:
    kinds = list(sizes)  # their sum is at most the capacity, so that they are few
    return {a + b for i, a in enumerate(kinds) for b in kinds[i + 1 :]} | {2 * a for a in kinds if sizes[a] > 1}


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Shifts pieces from emptier to fuller underfull bins while some step raises the sum of squared fills.

    A step moves a piece, or exchanges one for a longer one or for two; of all steps that fit, a bin takes the one that fills it most.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    sizes = [Counter(lengths[i] for i in b) for b in bins]
    changed = True
    while changed:
        changed = False
        order = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: (-fill[k], k))
        ones, twos = _Holders(set), _Holders(_pair_sums)  # of the bins that come later
        for k in order:
            ones.enter(k, sizes[k])
            twos.enter(k, sizes[k])

        def shift(source: int, target: int, size: int) -> None:
            i = next(i for i in bins[source] if lengths[i] == size)
            bins[source].remove(i)
            bins[target].append(i)
            sizes[source] -= Counter([size])
            sizes[target][size] += 1
            fill[source] -= size
            fill[target] += size

        for k in order:
            ones.leave(k, sizes[k])
            twos.leave(k, sizes[k])
            while 0 < fill[k] < capacity:
                gap = capacity - fill[k]
                gain, step = 0, None
                for out in [0, *sorted(sizes[k])]:
                    for given, kind in ((ones.greatest(out, out + gap), ones), (twos.greatest(out, out + gap) if out else 0, twos)):
                        if given - out > gain:
                            gain, step = given - out, (out, given, kind)
                if step is None:
                    break
                out, given, kind = step
                source = min(kind.bins[given])
                ones.leave(source, sizes[source])
                twos.leave(source, sizes[source])
                if kind is ones:
                    into = [given]
                else:
                    one = min(a for a in sizes[source] if sizes[source][given - a] > (2 * a == given))
                    into = [one, given - one]
                for size in into:
                    shift(source, k, size)
                if out:
                    shift(k, source, out)
                ones.enter(source, sizes[source])
                twos.enter(source, sizes[source])
                changed = True
    return [b for b in bins if b]


def pack_group(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into ``lengths``, the fullest first."""
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    return sorted(bins, key=lambda b: (-sum(lengths[i] for i in b), min(b)))


def _packer(names: list[str], capacity: int, level: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start") if c in part.column_names])
        group, sizes = key[0].as_py(), part["length"].to_pylist()
        packed = pack_group(sizes, capacity)
        sequence, offset, again = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for k, b in enumerate(packed):
            at = 0
            for i in b:
                sequence[i], offset[i] = level << 56 | group << 24 | k, at
                at += sizes[i]
            if not last and at < capacity and k >= len(packed) - PASSED_ON:
                again[b] = True
        added = {"sequence_id": sequence, "offset": offset, "_group": np.full(len(sizes), group), "_open": again}
        return pa.table([part[c] if c in part.column_names and c != "_group" else pa.array(added[c]) for c in names], names)

    return run


def pack(rows: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stored table with ``length`` (1 to ``capacity``).

    Columns ``sequence_id``, ``offset``, ``_group`` and ``_open`` of the input are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("sequence_id", "offset", "_group", "_open")
    schema = with_fields(rows.schema, "sequence_id long, offset long, _group long, _open boolean")
    groups = max(1, math.ceil(rows.count() / group_pieces))
    todo = rows.withColumn("_group", F.least(F.floor(F.rand(17) * groups), F.lit(groups - 1)).cast("long"))
    done, level = [], 0
    while True:
        dealt = todo.repartition(min(groups, partitions(spark)), "_group") if groups > 1 else todo
        out = staged(dealt.groupBy("_group").applyInArrow(_packer(schema.names, capacity, level, groups == 1), schema), "packed")
        if groups == 1:
            done.append(out)
            break
        done.append(out.filter(~F.col("_open")))
        groups = math.ceil(groups / MEET)
        todo = out.filter("_open").drop("sequence_id", "offset", "_open").withColumn("_group", F.floor(F.col("_group") / MEET).cast("long"))
        level += 1
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.drop("_group", "_open")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, most: int = 2048) -> DataFrame:
    """All documents as pieces in sequences of at most ``most`` ids."""
    return pack(staged(pieces(docs, tokenizer, end_id, most), "pieces"), most)
