"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session (tests, one machine) may leave it unset; a temporary folder is made and set then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return str(sc.getCheckpointDir()).rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a scan of what was written.

    This cuts the lineage: a lost executor costs a reread, not a recomputation. The table stays; see ``Scratch``.
    """
    return _stored(df, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


def _stored(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """A folder for the tables between an operator's steps, removed when its block ends.

    What the operator returns is written before that with ``staged``, so that nothing reads the folder later.
    """

    def __init__(self, spark: SparkSession, label: str, compression: str = "snappy"):
        self.spark, self.path, self.compression = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", compression

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        return _stored(df, f"{self.path}/{label}-{uuid.uuid4().hex}", self.compression)

    def once(self, df: DataFrame, label: str) -> DataFrame:
        """As a call, for a table that ``drop`` removes before the block ends; one of each label."""
        return _stored(df, f"{self.path}/{label}", self.compression)

    def drop(self, label: str) -> None:
        """Removes the table that ``once`` wrote: no step reads it any more."""
        _remove(self.spark, f"{self.path}/{label}")

    def __exit__(self, *_) -> None:
        _remove(self.spark, self.path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Keys of a join that are hot at most: those with more than this part of all rows each.
HOT_KEYS = 2_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``counted`` (one row a key, its number of rows in ``n``, which is left out); ``total`` rows in all.

    The keys with more than total / HOT_KEYS rows are HOT_KEYS at most and are broadcast; the others meet in a
    sort-merge join. So no task takes all rows of a hot key.
    """
    limit = max(total // HOT_KEYS, 1)
    hot = counted.filter(F.col("n") > limit)
    few = rows.join(F.broadcast(hot.drop("n")), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counted.filter(F.col("n") <= limit).drop("n").hint("merge"), keys)
    return few.unionByName(rest)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null: empty) and the named further columns; all else is dropped."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *[F.col(x) for x in more],
    )


def with_fields(schema: T.StructType, more: str) -> T.StructType:
    """``schema`` and the fields of a DDL string after it."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])


def with_nulls_first(column: str) -> Column:
    """Ascending, nulls first: the order of documents throughout."""
    return F.col(column).asc_nulls_first()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``step ** i`` and its inverse modulo 2**64 for i up to n at least."""
    size = max(1 << 16, 1 << int(n).bit_length())
    if size not in _POWERS:
        both = []
        for base in (_STEP, _STEP_INVERSE):
            line = np.full(size + 1, base, dtype=U64)
            line[0] = 1
            with np.errstate(over="ignore"):
                both.append(np.multiply.accumulate(line))
        _POWERS.clear()
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def ring_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * step ** i`` modulo 2**64; see ``ring_windows``."""
    out = np.zeros(len(values) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def ring_windows(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fast 64-bit hashes of the windows [start, end), for use where contents are compared after a match only.

    Strings can be made that have the same hash: no identity may rest on it.
    """
    inverse = powers(len(sums))[1]
    with np.errstate(over="ignore"):
        raw = (sums[ends] - sums[starts]) * inverse[starts]
        return mixed(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Bytes of a range above which it is hashed by itself.
_LONG = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), taken eight bytes at a time through the finaliser.

    Ranges of at most eight bytes and the same length differ in hash if they differ; longer ones by chance of 64 bits.
    """
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = (ends - starts).astype(np.int64)
    with np.errstate(over="ignore"):
        out = size.astype(U64) * U64(0xD6E8FEB86659FD93)
        left, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
        while len(left):
            rest = size[left] - at
            own = eight[starts[left] + at] & _MASKS[np.minimum(rest, 8)]
            out[left] = mixed(out[left] * U64(0x9E3779B97F4A7C15) ^ own)
            left, at = left[rest > 8], at + 8
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))


def byte_values(data: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit number for each byte."""
    return _BYTE_VALUES[data]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array without nulls, and its n + 1 offsets."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at * 0
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int):
    """Ranges (first, last) of rows whose bytes add up to about ``limit``; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last
