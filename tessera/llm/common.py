"""Shared helpers: checkpoint folder, Arrow text columns as flat byte arrays, byte-level words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once in a Python worker; bounds its memory whatever the Arrow batch holds.
CHUNK_BYTES = 1_000_000
INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and all runs on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = path or tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(path)
    return path or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each execution started inside go as soon as it ends: what it made is written, so nothing reads them again. Else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, held)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: smaller than a checkpoint of rows, and its shuffle files go at once."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Scratch:
    """Written tables that are deleted when the scope ends; `drop` deletes those so far, when what they served is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def written(self, df: DataFrame) -> DataFrame:
        table, path = _written(df)
        self.paths.append(path)
        return table

    def drop(self) -> None:
        sc, paths, self.paths = self.spark.sparkContext, self.paths, []
        for path in paths:
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(held)) if int(held) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def hot_join(rows: DataFrame, other: DataFrame, key: str, weight: str, most: int = 2_000) -> DataFrame:
    """rows joined with other on a key that other has once. Keys whose weight (rows in `rows`) is over the share
    1/most of all weight, so fewer than `most`, are broadcast; the rest is joined as Spark sees fit. other is read twice."""
    total = other.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * most > total
    hot, cold = (other.where(c).drop(weight) for c in (heavy, ~heavy))
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    both = rows.join(mark, key, "left")
    more = [c for c in hot.columns if c != key]
    rest = both.where("_hot is null").select(*rows.columns).join(cold, key)
    return both.where("_hot").select(*rows.columns, *more).unionByName(rest.select(*rows.columns, *more))


def release() -> None:
    """Give freed memory back to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def extend(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """All columns of df and those that run makes of its batches. Columns travel by place, so any names may stand beside each other; those named like a new one are dropped."""
    df = df.drop(*[name for name, _ in fields])
    names, n = df.columns, len(df.columns)
    kinds = [*[f.dataType for f in df.schema.fields], *[kind for _, kind in fields]]
    places = [f"_{k}" for k in range(len(kinds))]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, new in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=places)
        release()

    schema = T.StructType([T.StructField(p, kind) for p, kind in zip(places, kinds, strict=True)])
    return df.toDF(*places[:n]).mapInArrow(mapped, schema).toDF(*names, *[name for name, _ in fields])


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `most` bytes of text each, or one row if that alone is longer."""
    n, k = batch.num_rows, 0
    if not n:
        return
    _, offs = flat(batch.column(text))
    while k < n:
        end = max(k + 1, int(np.searchsorted(offs, offs[k] + most, "right")) - 1)
        yield batch.slice(k, end - k)
        k = end


#: ASCII lower-casing, and the bytes of words (digits, a-z, everything beyond ASCII) after it.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True bytes that do not cross a row's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    at = offs[:-1]
    prev[at[at < n]] = False
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = inside[1:]
    at = offs[1:]
    nxt[at[at > 0] - 1] = False
    return np.flatnonzero(inside & ~prev), np.flatnonzero(inside & ~nxt) + 1


_ODD = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    if len(_tables.get("p", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, base in (("p", _ODD), ("q", inverse)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["p"], _tables["q"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal spans wherever they stand."""
    p, q = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * q[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; an empty stretch sums to 0."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
