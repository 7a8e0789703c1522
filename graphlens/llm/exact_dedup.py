"""Exact deduplication through an extendible-hash index on shared files.

The texts' hashes are counted, and from the counts by prefix a
directory of buckets is doubled until no bucket is overfull. Every row is routed through the directory to the
owner task of its range of (bucket, hash). The owner sorts what has one hash by its text, which compares collisions byte for
byte, chains the texts that differ, settles which row of each stays, and writes its range of the index.
The rows of hot hashes, those with more than a fixed share of all rows, are first summed up by text in the tasks that read them, so that an
owner takes one entry from each. All of it is DataFrame operations.

Defined results: a null text counts as empty; of equal texts the largest ``doc_id`` stays (null
only where all are null); repeated rows, of the same ``doc_id`` and text, are one document for the
report, which gives each of them the same result, and ``drop_copies`` keeps one of them; an empty
table gives no rows; further columns don't matter, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import HOT_KEYS, Scratch, partitions, staged, texts

#: Entries that a bucket holds before it is split (more where 2 ** MAX_DEPTH slots would be too few), and the directory's greatest depth.
BUCKET_ENTRIES, MAX_DEPTH = 4096, 16


def text_hash(text: Column, bits: int) -> Column:
    """The hash whose leading bits find the bucket; tests take fewer ``bits`` to make collisions."""
    return F.xxhash64(text).bitwiseAND(F.lit(-1 << (64 - bits)).cast("long"))


def directory(counts: dict[int, int], capacity: int, most: int = MAX_DEPTH) -> list[tuple[int, int, int, int]]:
    """(slot, global depth, bucket, local depth) from the entries of each prefix of ``most`` bits.

    Starts with one bucket; while an overfull bucket can be split, the directory doubles and that bucket's
    slots part by their next bit.
    """
    local = {(0, 0): sum(counts.values())}
    depth = 0
    while depth < most and any(n > capacity for (d, _), n in local.items() if d == depth):
        depth += 1
        for (d, prefix), n in list(local.items()):
            if d == depth - 1 and n > capacity:
                del local[d, prefix]
                local[depth, 2 * prefix] = local[depth, 2 * prefix + 1] = 0
        for prefix, n in counts.items():
            at = (depth, prefix >> (most - depth))
            if at in local:
                local[at] += n
    slots = []
    for bucket, (d, prefix) in enumerate(sorted(local, key=lambda x: x[1] << (most - x[0]))):
        first = prefix << (depth - d)
        slots += [(slot, depth, bucket, d) for slot in range(first, first + (1 << (depth - d)))]
    return slots


def _slot(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth).cast("int") if depth else F.lit(0)


def build_index(docs: DataFrame, keep: Scratch, bits: int = 64, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """The index, written to shared files: bucket, depth, h, chain (place among the texts of one hash), place (among the rows of
    one text; 1 stays), sha, doc_id, keep_id, group_size, hot, and ``has`` and ``rest``, what else the row held.

    An entry is a row; of a hot hash, all rows of one text, with the one that stays.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(text_hash(text, bits).alias("h"), text.alias("t"), F.col("doc_id").cast("long").alias("id"), F.col("text").isNotNull().alias("has"), rest.alias("rest"))
    hashes = keep(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "hashes")
    counts = hashes.groupBy(_slot(F.col("h"), MAX_DEPTH).alias("p")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).collect()  # 2 ** MAX_DEPTH rows at most
    kinds, total = sum(r.kinds for r in counts), sum(r.n for r in counts)
    slots = directory({r.p: r.kinds for r in counts}, max(capacity, math.ceil(4 * kinds / 2**MAX_DEPTH)))
    table = keep(spark.createDataFrame(slots, "slot int, global_depth int, bucket int, depth int").coalesce(1), "directory")

    hot = F.broadcast(hashes.filter(F.col("n") > max(total // HOT_KEYS, 1)).select("h"))  # HOT_KEYS rows at most
    cold = rows.join(hot, "h", "left_anti").withColumns({"n": F.lit(1).cast("long"), "hot": F.lit(False)})
    order = F.struct(F.col("id").isNotNull(), "id", "has")
    summed = rows.join(hot, "h").groupBy("h", "t").agg(F.max_by(F.struct("id", "has", "rest"), order).alias("best"), F.count(F.lit(1)).alias("n"))
    summed = summed.select("h", "t", "best.id", "best.has", "best.rest", "n", F.lit(True).alias("hot"))
    routed = cold.unionByName(summed).withColumn("slot", _slot(F.col("h"), slots[0][1])).join(F.broadcast(table.select("slot", "bucket", "depth")), "slot")  # 2 ** MAX_DEPTH rows at most
    one_text = W.partitionBy("bucket", "h", "t")
    owned = (
        routed.repartitionByRange(partitions(spark), "bucket", "h")
        .withColumn("chain", F.dense_rank().over(W.partitionBy("bucket", "h").orderBy("t")))
        .withColumn("place", F.row_number().over(one_text.orderBy(F.desc_nulls_last("id"), F.desc("has"))))
        .withColumns({"keep_id": F.max("id").over(one_text), "group_size": F.sum("n").over(one_text)})
    )
    return owned.select("bucket", "depth", "h", "chain", "place", F.col("id").alias("doc_id"), "keep_id", "group_size", "hot", "t", "has", "rest")


def report(docs: DataFrame, bits: int = 64, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    with Scratch(docs.sparkSession, "exact") as keep:
        owned = build_index(docs.select("doc_id", "text"), keep, bits, capacity).withColumn("sha", F.sha2("t", 256)).drop("t", "has", "rest")
        index = staged(owned, "exact-index")
    hot = F.broadcast(index.filter("hot").select("h", "sha", "keep_id", "group_size"))  # the texts of HOT_KEYS hashes at most
    copies = texts(docs).select("doc_id", text_hash(F.col("text"), bits).alias("h"), "text").join(F.broadcast(index.filter("hot").select("h").distinct()), "h", "left_semi")
    copies = copies.select("doc_id", "h", F.sha2("text", 256).alias("sha")).join(hot, ["h", "sha"])
    found = index.filter("not hot").select("doc_id", "keep_id", "group_size", "sha").unionByName(copies.drop("h"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, bits: int = 64, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One whole row of each distinct text, with the columns of ``docs``."""
    with Scratch(docs.sparkSession, "exact") as keep:
        index = staged(build_index(docs, keep, bits, capacity).filter("place = 1"), "exact-index")
    return index.select(*[F.when(F.col("has"), F.col("t")).alias(c) if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
