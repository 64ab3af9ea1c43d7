"""Structured Streaming over the tables: last write wins by key, event-time windows, sessions and resumable parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.materialise import cut


def files(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder (or of one file), with the schema of those there now."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(str(p.getParent().toString()))


class LastWrite(StatefulProcessor):
    """Keeps the newest record of each key: newer or equal wins, of equal times the later arrival."""

    def __init__(self, columns: list[str], updated: str, arrival: str) -> None:
        self.columns, self.updated, self.arrival = columns, updated, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "updated long, arrival long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have = self.best.get() if self.best.exists() else None
        out = None
        for pdf in rows:
            top = pdf.sort_values([self.updated, self.arrival]).iloc[[-1]]
            now = int(top[self.updated].iloc[0]), int(top[self.arrival].iloc[0])
            if have is None or now >= tuple(have):
                have, out = now, top
        if out is not None:
            self.best.update(have)
            yield out[self.columns]

    def close(self) -> None:
        pass


def last_writes(stream: DataFrame, keys: list[str], updated: str, arrival: str) -> DataFrame:
    """A changelog of newest records by key; the last row of a key is its record."""
    return stream.groupBy(*keys).transformWithStateInPandas(LastWrite(stream.columns, updated, arrival), outputStructType=stream.schema, outputMode="Update", timeMode="None")


class BestSoFar(StatefulProcessor):
    """Keeps the best value of each item of a key, for the `most` items used last: an item that is not among them is forgotten with its best."""

    def __init__(self, key: str, item: str, value: str, used: str, most: int) -> None:
        self.names, self.most = (key, item, value, used), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getValueState("items", "held array<struct<item:string,best:double,used:long>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, item, value, used = self.names
        held = {r[0]: (r[1], r[2]) for r in (self.items.get()[0] if self.items.exists() else [])}
        for pdf in rows:
            for i, v, u in pdf.sort_values(used)[[item, value, used]].itertuples(index=False):
                best, last = held.get(i, (v, u))
                held[i] = max(best, v), max(last, u)
        kept = sorted(((i, b, u) for i, (b, u) in held.items()), key=lambda x: (-x[2], x[0]))[: self.most]
        self.items.update(([(str(i), float(b), int(u)) for i, b, u in kept],))
        yield pd.DataFrame([(key[0], i, b, u) for i, b, u in kept], columns=list(self.names))

    def close(self) -> None:
        pass


def best_so_far(stream: DataFrame, key: str, item: str, value: str, used: str, most: int) -> DataFrame:
    """After each batch, the items held of the keys that it touched: key, item, best value, last use."""
    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).transformWithStateInPandas(BestSoFar(key, item, value, used, most), outputStructType=f"{key} {kind}, {item} string, {value} double, {used} long", outputMode="Update", timeMode="None")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed operators need, for the streams that are started inside."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    held = spark.conf.get(name)
    spark.conf.set(name, own)
    try:
        yield
    finally:
        spark.conf.set(name, held)


#: Parts of a merged table, by a hash of its keys.
PARTS = 32


def merged_into(spark: SparkSession, path: str, keys: list[str], updated: str, arrival: str, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps a table of newest records, in parts by a hash of the keys. A batch rewrites the parts that it touches, under its number; a batch that is run again
    writes the same again, so the sink is idempotent. What a later batch than the last has replaced is deleted, so the table does not grow with the number of batches."""

    def sink(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        hit = [r[0] for r in own.select("_part").distinct().collect()]  # at most `parts`
        have = _parts(spark, path, number)
        stored = [f"{path}/v={v}/_part={p}" for p, v in have.items() if p in hit]
        both = own
        if stored:
            old = spark.read.schema(batch.schema).parquet(*stored)
            both = old.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).select(own.columns).unionByName(own)
        best = F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), F.struct(updated, arrival))
        both.groupBy("_part", *keys).agg(best.alias("b")).select("_part", *keys, "b.*").select("_part", *batch.columns).write.mode("overwrite").partitionBy("_part").parquet(f"{path}/v={number}")
        own.unpersist()
        fs, at = _fs(spark, path)
        for v, found in _versions(spark, path).items():
            for p in found:
                if v < number - 1 and p in hit and have.get(p) != v:
                    fs.delete(at(f"{path}/v={v}/_part={p}"), True)

    return sink


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at(path))


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The parts of each finished version of a merged table."""
    fs, at = _fs(spark, path)
    out = {}
    for s in fs.listStatus(at(path)) if fs.exists(at(path)) else []:
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(at(f"{path}/{name}/_SUCCESS")):
            out[int(name[2:])] = [int(p.getPath().getName()[6:]) for p in fs.listStatus(s.getPath()) if p.getPath().getName().startswith("_part=")]
    return out


def _parts(spark: SparkSession, path: str, before: int) -> dict[int, int]:
    """The newest version of each part, of those before a batch."""
    return {p: v for v, found in sorted(_versions(spark, path).items()) if v < before for p in found}


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The table that merged_into() keeps: the newest version of each part."""
    newest = _parts(spark, path, 1 << 62)
    return spark.read.parquet(*[f"{path}/v={v}/_part={p}" for p, v in sorted(newest.items())])


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The last version that a sink of whole versions has finished."""
    fs, at = _fs(spark, path)
    done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(at(path)) if s.getPath().getName()[1:].isdigit() and fs.exists(at(f"{path}/{s.getPath().getName()}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/v{max(done)}")


def windowed(stream: DataFrame, at: str, by: str, value: str, size: str, late: str) -> DataFrame:
    """Counts and sums in tumbling windows; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, at: str, by: str, gap: str, late: str) -> DataFrame:
    """Counts in sessions that a gap ends."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def drained(stream: DataFrame, path: str, mode: str, sink: Callable | None = None) -> None:
    """Run a stream until its input is used up, with its progress kept beside the output: a stopped run goes on where it ended."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/progress").outputMode(mode)
    q = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", f"{path}/out").start()
    q.awaitTermination()


def prioritised(parts: list[int], wanted: list[int]) -> list[int]:
    """The wanted parts first, the others in their order: what is read first never changes what is read."""
    return [*dict.fromkeys(p for p in wanted if p in set(parts)), *[p for p in parts if p not in set(wanted)]]


def by_parts(df: DataFrame, part: str, order: list[int], derive: Callable[[DataFrame], DataFrame]) -> Iterator[tuple[int, DataFrame]]:
    """Finished parts one by one, in a stated order."""
    for p in order:
        yield p, cut(derive(df.where(F.col(part) == p)))
