"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank of frequency over the whole corpus, so that common ones take one
byte. The byte counts (1 to 4) of four values make a control byte; control bytes and data bytes
lie apart. A block is decoded with numpy table lookups. A store is a folder of three tables:

* ``dictionary``: rank, id, n. At most as many rows as the vocabulary.
* ``blocks``: part, block, payload. Parts are ranges of ``doc_id``, ascending; the payload is
  ``FVB1``, the number of documents, the number of ids before the block in its part (both unsigned
  64-bit, little-endian), the doc_ids (signed 64-bit; the lowest number stands for null), the ids
  per document (unsigned 32-bit), the control bytes and the data bytes.
* ``parts``: part, start. At most as many rows as partitions.

Defined results: a null or empty text is a document of its end id alone; documents with the same
``doc_id`` follow in the order of a hash of their ids; an empty table makes an empty store; columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import id_batches
from .common import Scratch, partitions, shared_dir, texts, with_nulls_first
from .pretoken import library_encoder

_MAGIC, _NULL = b"FVB1", np.iinfo(np.int64).min
BLOCK_IDS = 500_000
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    padded[: len(values)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    table = values.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), table[np.arange(4) < size[:, None]].tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of control bytes and data bytes."""
    size = _LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(size) - size
    padded = np.append(data, np.zeros(4, np.uint8))
    out = padded[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= padded[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(doc_ids: list, counts: list[int], ranks: np.ndarray, before: int) -> bytes:
    control, data = encode_values(ranks)
    numbers = np.array([_NULL if x is None else x for x in doc_ids], dtype="<i8")
    return b"".join((_MAGIC, np.array([len(doc_ids), before], dtype="<u8").tobytes(), numbers.tobytes(), np.array(counts, dtype="<u4").tobytes(), control, data))


def unpack_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, ids per document, ranks, ids before the block."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a token block")
    n, before = np.frombuffer(payload, "<u8", 2, 4).tolist()
    doc_ids = np.frombuffer(payload, "<i8", n, 20)
    counts = np.frombuffer(payload, "<u4", n, 20 + 8 * n).astype(np.int64)
    total = int(counts.sum())
    at, controls = 20 + 12 * n, -(-total // 4)
    control = np.frombuffer(payload, np.uint8, controls, at)
    return doc_ids, counts, decode_values(control, np.frombuffer(payload, np.uint8, -1, at + controls), total), before


def _counted(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for x in batch.column(0):
            own = np.bincount(np.frombuffer(x.as_buffer(), dtype=width))
            if len(own) > len(total):
                total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
            total[: len(own)] += own
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: str = "<u4") -> None:
    """Encodes every text with the tokenizers library's file and writes the store in ascending ``doc_id`` order.

    ``width`` is the numpy type that holds an id between the two passes. The table of ids is removed at the end.
    """
    with Scratch(docs.sparkSession, "ids") as scratch:
        _write_store(docs, path, tokenizer, end_id, width, scratch)


def _write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: str, scratch: Scratch) -> None:
    spark = docs.sparkSession

    def tokenise(batches):
        yield from id_batches(batches, library_encoder(tokenizer), end_id, width)

    tokens = scratch(texts(docs).mapInArrow(tokenise, "doc_id long, n_tokens long, ids binary"), "tokens").select("doc_id", "ids")
    counts = tokens.select("ids").mapInArrow(lambda b: _counted(b, width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(((r.n, r.id) for r in counts.collect()), key=lambda x: (-x[0], x[1]))  # at most a vocabulary
    spark.createDataFrame([(k, i, n) for k, (n, i) in enumerate(ranked)], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/dictionary")
    table = np.zeros(max([i for _, i in ranked], default=0) + 1, dtype=np.uint32)
    table[[i for _, i in ranked]] = np.arange(len(ranked), dtype=np.uint32)
    rank_of = spark.sparkContext.broadcast(table)

    def encode(batches):
        part = TaskContext.get().partitionId()
        doc_ids, counts, held, size, before, block = [], [], [], 0, 0, 0

        def flush():
            ranks = rank_of.value[np.concatenate(held)]
            payload = pack_block(doc_ids, counts, ranks, before)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], ["part", "block", "n_ids", "payload"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(ids.as_buffer(), dtype=width)
                doc_ids.append(doc_id)
                counts.append(len(own))
                held.append(own)
                size += len(own)
                if size >= BLOCK_IDS:
                    yield flush()
                    before, block = before + size, block + 1
                    doc_ids, counts, held, size = [], [], [], 0
        if doc_ids:
            yield flush()

    ordered = tokens.repartitionByRange(partitions(spark), with_nulls_first("doc_id"), F.xxhash64("ids")).sortWithinPartitions(with_nulls_first("doc_id"), F.xxhash64("ids"))
    ordered.mapInArrow(encode, "part int, block int, n_ids long, payload binary").write.parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # a row for each partition
    starts, at = [], 0
    for r in sorted(sizes, key=lambda r: r.part):
        starts.append((r.part, at))
        at += r.n
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{path}/parts")
    rank_of.unpersist()


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit)."""
    dictionary = spark.read.parquet(f"{path}/dictionary").select("rank", "id").collect()
    table = np.zeros(len(dictionary), dtype="<u4")
    for r in dictionary:
        table[r.rank] = r.id
    ids_of = spark.sparkContext.broadcast(table)

    def decode(batches):
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids, counts, ranks, before = unpack_block(payload)
                ids = ids_of.value[ranks]
                ends = np.cumsum(counts)
                offsets = np.append(0, 4 * ends).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
                columns = [pa.array([part] * len(counts), pa.int32()), pa.array(doc_ids, pa.int64(), mask=doc_ids == _NULL), pa.array(before + ends - counts, pa.int64()), pa.array(counts, pa.int64()), data]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "before", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks").select("part", "payload")
    rows = blocks.mapInArrow(decode, "part int, doc_id long, before long, n_tokens long, ids binary")
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))  # a row for each partition
    return rows.join(parts, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, width: str = "<u4") -> DataFrame:
    """Writes a store to the shared folder and returns what is read back from its files."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer, end_id, width)
    return read_store(spark, path)
