"""SpotSigs fingerprints of documents.

A spot is a common word (an antecedent); its signature is the antecedent with the chain of content
words that follow it. A fingerprint is the set of a text's signatures, written as their number, a
colon and the sorted signatures in hexadecimal. Sets are compared by Jaccard likeness. All similar documents are found by
``similar_classes``: sets are partitioned by length, and those of neighbouring partitions that share a rare signature are compared, pruned by
what their lengths, the place of the shared signature and parity maps still allow.

Defined results: a text with fewer than ``LEAST_SPOTS`` spots takes every word for an antecedent, one with
fewer words than a chain its words as one signature, and one without words its bytes; null and empty
texts have the empty set, which is like itself only. Repeated rows follow each other in the order of
their texts. A null ``doc_id`` comes first. The one row of a table is its own next document; an empty table
gives no rows; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .bytewords import ASCII_LOWER, word_ranges
from .common import U64, Scratch, blocks, mixed, partitions, range_hashes, staged, text_buffers, texts, with_nulls_first
from .components import components

# Common words of English, German, French and Spanish that serve as antecedents.
ANTECEDENTS = """
the a an of to in and is was for on that with as at by from this are be or it not have has had but
der die das und ist den dem ein eine zu von mit nicht auf im es sich des als auch war für
le la les de des du un une et est en que qui dans pour par au sur pas ne plus ce il
el los las y que del se por con una su para como al lo no más este
""".split()
CHAIN, LEAST_SPOTS = 2, 4
#: Bytes of a signature in the fingerprint, and of a block of texts.
WIDTH, BLOCK = 5, 1_000_000
#: Rows of a signature that one block of the search takes from each side.
CROWD = 1_000


def _hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        raw = np.frombuffer(w.encode(), dtype=np.uint8)
        out.append(range_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
    return np.unique(np.array(out, dtype=U64))


_ANTECEDENTS = _hashes(ANTECEDENTS)


def _joined(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=U64)
    with np.errstate(over="ignore"):
        for c in columns:
            out = mixed(out * U64(0x9E3779B97F4A7C15) + c)
    return out


def signature_sets(column) -> Iterator[np.ndarray]:
    """The sorted distinct signatures (of 8 * WIDTH bits) of each text of an Arrow column without nulls."""
    data, offsets = text_buffers(column)
    for first, last in blocks(offsets, BLOCK):
        part = ASCII_LOWER[data[offsets[first] : offsets[last]]]
        at = offsets[first : last + 1] - offsets[first]
        if not len(part):
            yield from (np.zeros(0, U64) for _ in range(last - first))
            continue
        start, end, firsts = word_ranges(part, at)
        words = range_hashes(part, start, end)
        content = ~np.isin(words, _ANTECEDENTS)
        places = np.flatnonzero(content)
        spots = np.flatnonzero(~content)
        following = np.searchsorted(places, spots)
        limit = np.searchsorted(places, firsts)  # content words before each text
        text = np.searchsorted(firsts, spots, "right") - 1
        whole = following + CHAIN <= limit[text + 1]
        spots, following, text = spots[whole], following[whole], text[whole]
        chains = _joined(words[spots], *[words[places[following + k]] for k in range(CHAIN)])
        bounds = np.searchsorted(text, np.arange(last - first + 1))
        for k in range(last - first):
            own = chains[bounds[k] : bounds[k + 1]]
            if len(own) < LEAST_SPOTS:
                own = words[firsts[k] : firsts[k + 1]]
                if len(own) > CHAIN:
                    own = _joined(*[own[i : len(own) - CHAIN + i] for i in range(CHAIN + 1)])
                elif len(own):
                    own = _joined(*[own[i : i + 1] for i in range(len(own))])
                elif at[k + 1] > at[k]:
                    own = range_hashes(part[at[k] : at[k + 1]], np.array([0]), at[k + 1 : k + 2] - at[k])
            yield np.unique(own >> U64(64 - 8 * WIDTH))


def fingerprint(signatures: np.ndarray) -> str:
    raw = signatures.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :]
    return f"{len(signatures)}:{np.ascontiguousarray(raw).tobytes().hex()}"


def parsed(text: str) -> np.ndarray:
    """The signatures of a fingerprint."""
    raw = np.frombuffer(bytes.fromhex(text.partition(":")[2]), dtype=np.uint8).reshape(-1, WIDTH)
    return np.concatenate([np.zeros((len(raw), 8 - WIDTH), np.uint8), raw], axis=1).view(">u8").ravel().astype(U64)


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard likeness of two sets, two empty ones being alike; 0 where lengths alone rule ``threshold`` out."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(fingerprint, signature_sets(batch.column(1))), pa.string())], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


_SET = ["n", "k1", "k2"]


def similar_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_signatures, class_id (smallest doc_id reachable over pairs whose sets meet ``percent``) of every row.

    Rows with the same set count once. Sets that share a small signature are chained by length, compared and joined first; then all pairs
    of different classes are searched by the partitions of their length and their rarest signatures, and compared. Nothing is
    left out. Rows without signatures are alone; a class without any ``doc_id`` has a null one.
    """

    def measured(batches):
        for batch in batches:
            sets = list(signature_sets(batch.column(2)))
            with np.errstate(over="ignore"):
                keys = [np.array([int(f(s)) for s in sets], dtype=U64).view(np.int64) for f in (np.bitwise_xor.reduce, lambda s: mixed(s + U64(77)).sum(dtype=U64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, keys)], ["doc_id", "th", *_SET])

    with Scratch(docs.sparkSession, "spots") as keep:
        whole = texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
        rows = keep(whole.mapInArrow(measured, "doc_id long, th long, n long, k1 long, k2 long"), "rows")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("least")
        sets = rows.filter("n > 0").groupBy(*_SET).agg(least)
        sets = keep(sets.select(*_SET, F.monotonically_increasing_id().alias("id"), "least.doc_id", F.col("least.th").alias("own_th")), "sets")
        first = sets.select("id", F.col("doc_id").alias("own"), "own_th")
        bodies = whole.join(first.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th"))).select("id", "text").dropDuplicates(["id"])
        bodies = keep(bodies, "bodies")
        links = keep(setjoin.verified(setjoin.chained_pairs(bodies, signature_sets, percent), bodies, signature_sets, percent), "links")
        classes = sets.select("id").join(components(links, keep), "id", "left").select("id", F.coalesce("component", "id").alias("class"))
        pairs = keep(setjoin.set_pairs(keep(bodies.join(classes, "id"), "classed"), signature_sets, percent, keep, CROWD, by_length=True), "pairs")
        links = keep(links.union(setjoin.verified(pairs, bodies, signature_sets, percent)).distinct(), "links")
        members = keep(sets.select(*_SET, "id", "doc_id").join(components(links, keep), "id", "left").withColumn("class", F.coalesce("component", "id")), "members")
        named = members.groupBy("class").agg(F.min("doc_id").alias("class_id"))
        found = rows.select("doc_id", *_SET).join(members.select(*_SET, "class").join(named, "class"), _SET, "left")
        return staged(found.select("doc_id", F.col("n").alias("n_signatures"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")), "spot-classes")


def _with_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text and ``bucket``: ranges of doc_id of about the same number of rows."""
    rows = texts(docs).withColumn("_at", F.col("doc_id").cast("double"))
    cuts = sorted(set(rows.select("_at").approxQuantile("_at", [k / buckets for k in range(1, buckets)], 0.25 / buckets))) if buckets > 1 else []
    place = Bucketizer(splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol="_at", outputCol="_bucket", handleInvalid="keep")
    found = place.transform(rows.withColumn("_at", F.coalesce("_at", F.lit(-math.inf))))
    return found.select("doc_id", "text", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_bucket")).cast("int").alias("bucket"))


def in_sequence(docs: DataFrame) -> DataFrame:
    """Rows (bucket, head, doc_id, text) such that, sorted within each bucket, every document but those marked ``head``
    is followed by its next one: the first of the next bucket stands at a bucket's end once more."""
    spark = docs.sparkSession
    rows = _with_buckets(docs, 4 * partitions(spark)).withColumn("head", F.lit(False))
    firsts = {r.bucket: r.first for r in rows.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect()}  # a row for each bucket
    order = sorted(firsts)
    before = spark.createDataFrame([(b, firsts[b], order[k - 1]) for k, b in enumerate(order)], "bucket int, first long, previous int")
    heads = rows.join(F.broadcast(before), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("first")))
    heads = heads.groupBy("previous").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    return rows.select("bucket", "head", "doc_id", "text").union(heads.select("previous", F.lit(True), "doc_id", "text"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and its likeness to that and to the next document.

    Edited: the last floor(n_chars / 2) code points give way to as many first ones of the next document.
    """
    spark = docs.sparkSession
    dealt = in_sequence(docs).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "head", with_nulls_first("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def finished(rows: list[tuple]) -> pa.RecordBatch:
        """Results of all rows but the last."""
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]
        text, following = [a[3] for a, _ in pairs], [b[3] for _, b in pairs]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(text, following)]
        own, new, nxt = (list(signature_sets(pa.array(x, pa.large_string()))) for x in (text, edited, following))
        columns = [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array(map(len, text), pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(map(fingerprint, own), pa.string()),
            pa.array(map(fingerprint, new), pa.string()),
            pa.array(map(likeness, own, new), pa.float64()),
            pa.array(map(likeness, own, nxt), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held.append(row)
                size += len(row[3])
                if size > BLOCK and len(held) > 1:
                    yield finished(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield finished(held)

    return dealt.mapInArrow(run, schema)
