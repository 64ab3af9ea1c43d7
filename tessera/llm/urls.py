"""URL filters on a sorted digest array.

Rules are (host, path) prefixes with a verdict. Their strings `host + path` are kept in the order of
their 64-bit xxhash digests beside the array of digests; both are memory-mapped. A URL is probed with
every suffix of its host that starts at a label and every prefix of its path that is as long as some
rule's path. All probes of a batch are found by one vectorised binary search, and each hit is
confirmed against the stored full string, so that a collision of digests changes nothing. The longest
rule wins; of equally long ones that with the longer host. What no rule fits has the default verdict.
Of rules with one string, `block` wins.

One array is broadcast, and mapped from an unlinked scratch file by each worker (the map is a worker's own and is made again where
it runs again), while its checked size is at most `most_broadcast` bytes. Beyond that the same array is made in ranges of digests: each task gets the
rules of a range, makes their sorted array, maps it and searches the distinct probes of that range; what it
finds is joined to the URLs. The rules are the same, so are the results.

Edge cases: a null URL, or one without `://`, has an empty host and path and fits no rule; an empty
rule list gives the default to every URL; very long hosts and paths are probed no further than the longest
rule; repeated rows and repeated rules count as they stand; input columns named like a result are replaced, others stay, whatever their names.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extend, hot_join, partitions, written

#: The rules of the registered query, as (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DEFAULT, MOST_BROADCAST = "allow", 64 << 20
#: Bytes of rules of one range of digests.
RANGE = 16 << 20


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    stop = min((k for k in map(path.find, "?#") if k >= 0), default=len(path))
    return rest[:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), path[:stop]


class DigestArray:
    """Strings with a verdict each, by digest."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        last: dict[str, str] = {}
        for verdict, host, path in rules:
            last[host + path] = max(last.get(host + path, verdict), verdict)  # block before allow
        keys = {text: xxhash.xxh64_intdigest(text) for text in last}
        order = sorted(last, key=lambda t: (keys[t], t))
        raw = [t.encode() for t in order]
        self.arrays = [np.array([keys[t] for t in order], np.uint64), np.cumsum([0, *map(len, raw)], dtype=np.int64), np.frombuffer(b"".join(raw), np.uint8), np.array([last[t] == "block" for t in order], np.uint8)]
        self.longest_host = max((len(h) for _, h, _ in rules), default=0)
        self.path_lengths = sorted({len(p) for _, _, p in rules})

    @property
    def size(self) -> int:
        return sum(a.nbytes for a in self.arrays)

    def mapped(self) -> DigestArray:
        """The same with its arrays memory-mapped from a scratch file that has no name."""
        file = tempfile.TemporaryFile()
        places = []
        for a in self.arrays:
            file.write(b"\0" * (-file.tell() % 8))
            places.append(file.tell())
            file.write(a.tobytes())
        file.flush()
        other = object.__new__(DigestArray)
        other.longest_host, other.path_lengths = self.longest_host, self.path_lengths
        other.arrays = [np.memmap(file, a.dtype, "r", at, a.shape) if a.size else a for a, at in zip(self.arrays, places, strict=True)]
        return other

    def probe(self, texts: list[str]) -> np.ndarray:
        """The place of each text, or -1: binary search by digest, then the full string."""
        keys, bounds, strings, _ = self.arrays
        h = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        low = np.searchsorted(keys, h)
        out = np.full(len(texts), -1)
        for k in np.flatnonzero(low < np.searchsorted(keys, h, "right")).tolist():
            raw, at = texts[k].encode(), int(low[k])
            while at < len(keys) and keys[at] == h[k]:
                if strings[bounds[at] : bounds[at + 1]].tobytes() == raw:
                    out[k] = at
                    break
                at += 1
        return out

    def probes(self, host: str, path: str) -> list[str]:
        """Every string that a fitting rule may have, the longest host first."""
        found, at = [], 0
        while at <= len(host):
            if len(host) - at <= self.longest_host:
                found += [host[at:] + path[:n] for n in self.path_lengths if n <= len(path)]
                at = host.find(".", at) + 1 or len(host) + 1
            else:
                at = host.find(".", max(at, len(host) - self.longest_host - 1)) + 1 or len(host) + 1
        return found


@lru_cache(4)
def _mapped(raw: bytes) -> DigestArray:
    return pickle.loads(raw).mapped()


def _results() -> list[tuple[str, T.DataType]]:
    return [(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]


def _best(probes: list[str], hit: list[bool]) -> int | None:
    """The place of the longest probe that a rule has; of equally long ones the first, which has the longer host."""
    return max((k for k in range(len(probes)) if hit[k]), key=lambda k: len(probes[k]), default=None)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, url: str = "url", default: str = DEFAULT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """All columns of pages and: host, path, rule (null where none fits), verdict. Rules: a list, or a table (verdict, host, path)."""
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 17)).first()[0] or 0
        if size > most_broadcast:
            return dealt(pages, rules, url, default)
        rules = [tuple(r) for r in rules.select("verdict", "host", "path").collect()]
    array = DigestArray(rules)
    if array.size > most_broadcast:
        return dealt(pages, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), url, default)
    shared = pages.sparkSession.sparkContext.broadcast(pickle.dumps(array))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        own = _mapped(shared.value)
        for batch in batches:
            split = [parts(u) for u in batch.column(url).to_pylist()]
            probes = [own.probes(*x) if x[0] else [] for x in split]
            at = own.probe([p for x in probes for p in x]).tolist()
            rules_of, verdicts, k = [], [], 0
            for x in probes:
                best = _best(x, [i >= 0 for i in at[k : k + len(x)]])
                rules_of.append(None if best is None else x[best])
                verdicts.append(default if best is None else "block" if own.arrays[3][at[k + best]] else "allow")
                k += len(x)
            yield batch, [pa.array(v, pa.string()) for v in ([x[0] for x in split], [x[1] for x in split], rules_of, verdicts)]

    return extend(pages, run, _results())


def dealt(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, range_bytes: int = RANGE) -> DataFrame:
    """The same for rules of any number: sorted arrays of ranges of digests, each distinct probe searched once."""
    spark = pages.sparkSession
    limits = rules.agg(F.max(F.length("host")), F.collect_set(F.length("path")), F.sum(F.octet_length("host") + F.octet_length("path") + 17)).first()
    frame = DigestArray([])
    frame.longest_host, frame.path_lengths = limits[0] or 0, sorted(limits[1] or [])
    ranges = max(1, -(-(limits[2] or 0) // range_bytes))

    def range_of(texts: list[str]) -> pa.Array:
        return pa.array([xxhash.xxh64_intdigest(t) * ranges >> 64 for t in texts], pa.int64())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, place, probes = [], [], []
            for u in batch.column("u").to_pylist():
                x = parts(u)
                own = frame.probes(*x) if x[0] else []
                of += [u] * len(own)
                place += range(len(own))
                probes += own
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(place, pa.int32()), pa.array(probes, pa.string())], names=["u", "place", "probe"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([range_of(batch.column("s").to_pylist()), *batch.columns], names=["r", "s", "verdict", "weight"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, array = None, [], None  # rules of a range come before its probes
        for batch in batches:
            r, kinds = batch.column("r").to_numpy(), batch.column("verdict").is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((r[1:] != r[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(r)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if r[a] != now:
                    now, held, array = r[a], [], None
                if not kinds[a]:
                    held += zip(part.column("verdict").to_pylist(), part.column("s").to_pylist(), [""] * (b - a), strict=True)
                    continue
                if array is None:
                    array, held = DigestArray(held).mapped(), []
                at = array.probe(part.column("s").to_pylist())
                hit = np.flatnonzero(at >= 0)
                verdict = ["block" if x else "allow" for x in array.arrays[3][at[hit]].tolist()]
                yield pa.RecordBatch.from_arrays([part.column("s").take(pa.array(hit)), pa.array(verdict, pa.string()), part.column("weight").take(pa.array(hit))], names=["probe", "verdict", "weight"])

    places = [f"_{k}" for k in range(len(pages.drop("host", "path", "rule", "verdict").columns))]
    kept = pages.drop("host", "path", "rule", "verdict")
    own = f"_{kept.columns.index(url)}"
    rows = kept.toDF(*places)
    urls = rows.where(F.col(own).isNotNull()).select(F.col(own).cast("string").alias("u")).distinct()
    asked = written(urls.mapInArrow(ask, "u string, place int, probe string"))
    strings = rules.select(F.concat("host", "path").alias("s"), "verdict").groupBy("s").agg(F.max("verdict").alias("verdict")).withColumn("weight", F.lit(0).cast("long"))
    probes = asked.groupBy(F.col("probe").alias("s")).agg(F.lit(None).cast("string").alias("verdict"), F.count("*").alias("weight"))
    both = strings.unionByName(probes).mapInArrow(number, "r long, s string, verdict string, weight long")
    found = both.repartition(partitions(spark), "r").sortWithinPartitions("r", F.col("verdict").isNull(), "s").mapInArrow(search, "probe string, verdict string, weight long")
    hits = hot_join(asked, written(found), "probe", "weight")
    best = hits.groupBy("u").agg(F.max_by(F.struct(F.col("probe").alias("rule"), "verdict"), F.struct(F.length("probe"), -F.col("place"))).alias("best"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for batch in batches:
            x = [parts(u) for u in batch.column(own).to_pylist()]
            yield batch, [pa.array([h for h, _ in x], pa.string()), pa.array([p for _, p in x], pa.string())]

    out = extend(rows, split, _results()[:2]).join(best, F.col(own).cast("string") == F.col("u"), "left")
    return out.select(*places, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")).toDF(*kept.columns, "host", "path", "rule", "verdict")


def verdicts(pages: DataFrame, page_id: str = "page_id", url: str = "url", **kw) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict."""
    kept = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    return judge(kept, url="url", **kw).select("page_id", "host", "path", "rule", "verdict")

