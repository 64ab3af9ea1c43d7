"""Size-tiered compaction of immutable shards with a versioned manifest, in DataFrame operations only.

A store is a folder: `shards/` holds Parquet files that are never changed, `manifest/` holds one
JSON file for each version, which lists the live files with their bytes and rows. A table is written once, split
into arrivals by a hash of its key; each arrival is a set of small files, one or more for each task, so nothing is shuffled,
and gets a version of its own. After each, while a tier is due, it is compacted: live files fall into tiers by
size (each `fanout` times the one before), and the smallest tier with at least `fanout` files is
merged by a scan that packs whole files into tasks of about the target size: each task writes one file, so merging needs no
shuffle either. In the end, what is below half of the target is merged once more, whatever its tier.

A version is committed by writing its manifest under a temporary name and giving it the name of the
next version in one step that fails if that exists: a hard link on a local file system, elsewhere FileContext's rename without
overwriting (atomic on HDFS). Readers open the files of one version, so a job that dies leaves only files that no manifest
lists. vacuum() deletes the files of superseded versions, and of those that no manifest lists what is older than a grace period.

Edge cases: an empty table commits a version without rows; a null or very long text, repeated rows and
any further columns, whatever their names, are kept as they are; rows without a key are in one arrival; a file of half of the target size or more is not rewritten.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterable, Iterator

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir

#: Bytes of a full shard, files of a tier that make it merge (and ratio of tiers), rows of an arriving file.
TARGET, FANOUT, ARRIVAL_ROWS = 64 << 20, 4, 20_000
#: Seconds for which files that no manifest lists are left to a writer that may still commit them.
GRACE = 7 * 86_400


class Store:
    """A folder of shards on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifest")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return sorted(int(s.getPath().getName()[1:-5]) for s in found if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """The named version, or the latest; version 0 is empty."""
        have = self.versions()
        version = (have[-1] if have else 0) if version is None else version
        if version == 0:
            return {"version": 0, "files": [], "schema": None}
        row = self.spark.read.text(f"{self.path}/manifest/v{version:08d}.json", wholetext=True).first()
        return json.loads(row.value)

    def commit(self, base: dict, files: list[dict], schema: str | None) -> dict:
        """Make the next version after base; fails if another writer has made it."""
        new = {"version": base["version"] + 1, "files": sorted(files, key=lambda f: f["name"]), "schema": schema or base["schema"]}
        temp, final = (self._path(f"{self.path}/manifest/{n}") for n in (f".{uuid.uuid4().hex}", f"v{new['version']:08d}.json"))
        stream = self._fs.create(temp, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        try:
            if self._fs.getUri().getScheme() == "file":
                java = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), self._strings()) for p in (final, temp)]
                jvm.java.nio.file.Files.createLink(*java)
                self._fs.delete(temp, False)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                rename = jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(rename, 1)
                options[0] = rename.NONE
                context.rename(*(context.makeQualified(p) for p in (temp, final)), options)
        except Py4JJavaError as e:
            self._fs.delete(temp, False)
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise RuntimeError(f"version {new['version']} was committed by another writer") from e
        return new

    def _strings(self) -> JavaObject:
        return self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.java.lang.String, 0)

    def _listed(self, folders: list[str]) -> list[dict]:
        """The Parquet files of folders with their bytes and rows; rows come from a scan that reads no column."""
        found = {f"{folder}/{s.getPath().getName()}": int(s.getLen()) for folder in folders for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if s.getPath().getName().endswith(".parquet")}
        if not found:
            return []
        rows = self.spark.read.parquet(*[f"{self.path}/{f}" for f in found]).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
        count = {r.f: r["count"] for r in rows}
        return [{"name": f, "bytes": size, "rows": count.get(f.rpartition("/")[2], 0)} for f, size in found.items()]

    def _write(self, df: DataFrame, rows: int | None) -> list[dict]:
        """Write one file or more for each task and list them."""
        folder = f"shards/{uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", rows) if rows else df.write
        writer.parquet(f"{self.path}/{folder}")
        return self._listed([folder])

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> dict:
        """An arrival as small files, in a version of its own."""
        base = self.manifest()
        return self.commit(base, base["files"] + self._write(df, rows), df.schema.json())

    def arrive(self, df: DataFrame, arrivals: int, key: str, rows: int = ARRIVAL_ROWS) -> Iterator[dict]:
        """One write of a table, split by a hash of its key; each part is committed as a version when it is asked for."""
        folder, part = f"shards/{uuid.uuid4().hex}", f"part_{uuid.uuid4().hex}"
        df.withColumn(part, F.pmod(F.xxhash64(f"`{key}`"), F.lit(arrivals))).write.partitionBy(part).option("maxRecordsPerFile", rows).parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if s.isDirectory()]
        files = self._listed([f"{folder}/{n}" for n in names])
        for n in sorted(names) or [""]:
            base = self.manifest()
            yield self.commit(base, base["files"] + [f for f in files if n and f["name"].startswith(f"{folder}/{n}/")], df.schema.json())

    def read(self, version: int | None = None, files: Iterable[dict] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError("the store has no version yet")
        schema = StructType.fromJson(json.loads(m["schema"]))
        names = [f"{self.path}/{f['name']}" for f in (m["files"] if files is None else files)]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def tier(self, size: int) -> int:
        """How often the size can be divided by the fanout; a file of half of the target size or more has none (-1): it is full, and not written again."""
        if size * 2 >= self.target:
            return -1
        return int(math.log(max(size, 1), self.fanout))

    def due(self, files: list[dict]) -> list[dict]:
        """Files of the smallest tier that has `fanout` or more."""
        tiers: dict[int, list[dict]] = {}
        for f in files:
            tiers.setdefault(self.tier(f["bytes"]), []).append(f)
        tiers.pop(-1, None)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self, last: bool = False) -> dict:
        """Merge tier by tier until none is due; each merge is one version. last: then merge what is below half of the target."""
        while chosen := self.due(self.manifest()["files"]):
            if not self._replace(chosen):
                break
        small = [f for f in self.manifest()["files"] if f["bytes"] * 2 < self.target]
        if last and len(small) > 1:
            self._replace(small)
        return self.manifest()

    def _replace(self, chosen: list[dict]) -> bool:
        """Merge files, each below half of the target, and commit; whether there are fewer now."""
        base, names = self.manifest(), {f["name"] for f in chosen}
        merged = self._merge(chosen)
        self.commit(base, [f for f in base["files"] if f["name"] not in names] + merged, None)
        return len(merged) < len(chosen)

    def _merge(self, chosen: list[dict]) -> list[dict]:
        """One job over all groups: the scan packs files into tasks of the target size."""
        conf, held = self.spark.conf, {}
        for key, value in (("spark.sql.files.maxPartitionBytes", str(self.target)), ("spark.sql.files.openCostInBytes", "0"), ("spark.sql.files.minPartitionNum", "1")):
            held[key] = conf.get(key, None)
            conf.set(key, value)
        try:
            return self._write(self.read(files=chosen), None)
        finally:
            for key, value in held.items():
                conf.unset(key) if value is None else conf.set(key, value)

    def vacuum(self, grace_seconds: float = GRACE) -> int:
        """Delete the manifests before the latest and the files that only they list, and files older than the grace period that no manifest lists; returns how many files went."""
        live, gone = {f["name"] for f in self.manifest()["files"]}, 0
        versions = self.versions()
        for v in versions[:-1]:
            for f in self.manifest(v)["files"]:
                if f["name"] not in live:
                    gone += bool(self._fs.delete(self._path(f"{self.path}/{f['name']}"), False))
        for v in versions[:-1]:
            self._fs.delete(self._path(f"{self.path}/manifest/v{v:08d}.json"), False)
        root = self._path(f"{self.path}/shards")
        prefix = len(self._fs.makeQualified(self._path(self.path)).toString()) + 1
        before, files = time.time() - grace_seconds, self._fs.listFiles(root, True) if self._fs.exists(root) else None
        while files is not None and files.hasNext():
            s = files.next()
            if s.getPath().toString()[prefix:] not in live and s.getPath().getName().endswith(".parquet") and s.getModificationTime() / 1000 < before:
                gone += bool(self._fs.delete(s.getPath(), False))
        return gone


def sharded(docs: DataFrame, path: str | None = None, arrivals: int = 3, key: str = "doc_id", target: int = TARGET, fanout: int = FANOUT) -> Store:
    """A table in arrivals dealt by a hash of the key, compacted after each arrival while a tier is due, and in the end."""
    spark = docs.sparkSession
    store = Store(spark, path or f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", target, fanout)
    for _ in store.arrive(docs, arrivals, key):
        store.compact()
    store.compact(last=True)
    return store


def listing(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row a document out of the compacted store, read back from the latest version: doc_id, n_bytes, text_sha256, listed_rows (those that the manifest lists
    in all) and compacted (whether no more than one live file is below half of the target)."""
    store = sharded(docs, key=doc_id, **kw)
    files = store.manifest()["files"]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return store.read().select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        F.sha2(whole, 256).alias("text_sha256"),
        F.lit(sum(f["rows"] for f in files)).cast("long").alias("listed_rows"),
        F.lit(sum(f["bytes"] * 2 < store.target for f in files) <= 1).alias("compacted"),
    )
