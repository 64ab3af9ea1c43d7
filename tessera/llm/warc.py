"""WARC archives: a writer with revisit records, and a splittable reader of compressed archives.

Writing: rows with equal payloads (SHA-1 and length) of `LEAST` bytes or more are one response, that with the largest key, and revisits that refer to
it by its record id; smaller payloads are all responses. Every record is a gzip member of its own. A task writes archives of about `ARCHIVE` bytes under
names of their own in a shared folder and gives their names and sizes; only what a finished attempt has named is listed, so files of a lost
attempt are never read.

Reading: an archive is cut into ranges of `SPLIT` bytes. A task scans its range for the magic of gzip; a candidate is a member if it can be inflated and begins
with the header of a record, else the scan goes on behind it. Records that start inside the range are the range's own, and are read to
their end however far beyond it. Payloads are inflated and digested in pieces, so memory does not follow a record's length.

A payload may hold a whole archive that deflate has stored as it is; a range that begins inside it would take its members for records. So ranges are chained: the first
record of a range has to start where the last one before it ended. Where it does not, the range is read again from there.

Edge cases: null and empty payloads have no bytes; a null key keeps its row, has no key in the archive and is largest only where no other is, which makes all
its equals responses; rows with the largest key of a group are all responses, also where repeated; a null uri is empty; texts of any length are one record;
an empty table gives an empty result. A record that is cut off or whose checksum fails is returned with `broken` set and without digest. Archives need a file system that
pyarrow opens (local or mounted, HDFS, S3, GCS); they stay in the shared folder until its owner removes them.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, partitions, release, written

#: Bytes from which equal payloads are written once, of an archive, of a range that one scan owns, and of ranges that a task reads.
LEAST, ARCHIVE, SPLIT, TASK = 1000, 256 << 20, 2 << 20, 32 << 20
#: Bytes read, inflated or compressed at once; a header is at most so long. Payload bytes of a batch of records.
PIECE, HEADER, BATCH = 1 << 18, 1 << 16, 4 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, bytes long, records long"
READ = (
    "file string, number long, offset long, stop long, kind string, record_id string, uri string, key string, refers_to string, "
    "declared_digest string, payload_bytes long, payload_digest string, broken boolean, payload binary"
)


def opened(folder: str) -> tuple[files.FileSystem, str]:
    """The file system of a folder's URI, and its path there."""
    return files.FileSystem.from_uri(folder)


# ---- writing


def fields(text: str | None) -> str:
    """A header's value: no line ends."""
    return re.sub(r"[\r\n]+", " ", text or "")


def record(kind: str, record_id: str, uri: str | None, digest: str, length: int, key: str | None, refers: str | None) -> tuple[bytes, bytes]:
    """The header of a record, and the head of the HTTP response in it; a revisit has no payload behind that."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {fields(uri)}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers}>"]
    if key is not None:
        lines.append(f"X-Record-Key: {fields(key)}")
    lines.append(f"Content-Length: {len(http) + (length if refers is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def member(header: bytes, http: bytes, payload: memoryview | bytes, level: int = 6) -> Iterator[bytes]:
    """A record as one gzip member, in pieces."""
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    yield press.compress(header + http)
    for at in range(0, len(payload), PIECE):
        yield press.compress(payload[at : at + PIECE])
    yield press.compress(b"\r\n\r\n") + press.flush()


def archived(rows: DataFrame, folder: str, most: int = ARCHIVE, level: int = 6) -> DataFrame:
    """Write rows (kind, record_id, uri, digest, length, key, refers, payload) as archives in a shared folder; a row for each: file, bytes, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = opened(folder)
        out, name, size, count, done = None, "", 0, 0, []
        for batch in batches:
            names = batch.schema.names
            for values in zip(*[batch.column(k) for k in range(batch.num_columns)], strict=True):
                row = dict(zip(names, values, strict=True))
                payload = row.pop("payload")
                payload = memoryview(payload.as_buffer()) if payload.is_valid and payload.as_buffer() is not None else b""
                row = {k: v.as_py() for k, v in row.items()}
                if out is None:
                    disk.create_dir(base, recursive=True)
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = disk.open_output_stream(f"{base}/{name}", compression=None)
                revisit = row["kind"] == "revisit"
                header, http = record(row["kind"], row["record_id"], row["uri"], row["digest"], row["length"], row["key"], row["refers"] if revisit else None)
                for part in member(header, http, b"" if revisit else payload, level):
                    out.write(part)
                    size += len(part)
                count += 1
                if size >= most:
                    out.close()
                    out = done.append((name, size, count))
        if out is not None:
            out.close()
            done.append((name, size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "bytes", "records"])
        release()

    return rows.mapInArrow(run, MANIFEST)


# ---- reading


class Source:
    """Bytes of an archive by offset, a piece at a time."""

    def __init__(self, disk: files.FileSystem, path: str) -> None:
        self.file = disk.open_input_file(path)
        self.at, self.data = 0, b""

    def read(self, offset: int) -> bytes:
        """Some bytes from offset on; none at the end."""
        if not self.at <= offset < self.at + len(self.data):
            self.file.seek(offset)
            self.at, self.data = offset, self.file.read(PIECE)
        return self.data[offset - self.at :]

    def find(self, offset: int, end: int) -> int | None:
        """The first magic at offset or later, before end."""
        while offset < end:
            data = self.read(offset)
            if len(data) < len(MAGIC):
                self.file.seek(offset)
                data = self.file.read(len(MAGIC))
                return offset if data == MAGIC else None if len(data) < len(MAGIC) else self.find(offset + 1, end)
            place = data.find(MAGIC)
            if place >= 0:
                return offset + place if offset + place < end else None
            offset += len(data) - len(MAGIC) + 1
        return None


def inflated(source: Source, offset: int, stop: list[int]) -> Iterator[bytes]:
    """What the gzip member at offset holds, in pieces; its end goes into stop, which stays empty if the member is cut off."""
    expand = zlib.decompressobj(31)
    at, rest = offset, b""
    while not expand.eof:
        data = rest or source.read(at)
        if not data:
            return
        if not rest:
            at += len(data)
        out = expand.decompress(data, PIECE)
        rest = expand.unconsumed_tail
        if out:
            yield out
    stop.append(at - len(expand.unused_data))


@dataclass
class Record:
    offset: int
    stop: int
    named: dict[str, str]
    length: int
    digest: str | None
    broken: bool
    payload: bytes | None = field(default=None, repr=False)


def header(text: bytes) -> dict[str, str] | None:
    """The fields of a record's header, names in lower case; None if it is none."""
    first, *lines = text.decode("utf-8", "replace").split("\r\n")
    named = {k.strip().lower(): v.strip() for k, sign, v in (line.partition(":") for line in lines) if sign}
    good = re.fullmatch(r"WARC/\d+\.\d+", first) and {"warc-type", "warc-record-id", "content-length"} <= named.keys() and named["content-length"].isdecimal()
    return named if good else None


def decoded(source: Source, offset: int, keep: bool) -> Record | None:
    """The record of the member at offset; None if no record begins there."""
    stop: list[int] = []
    parts, held, named = inflated(source, offset, stop), b"", None
    try:
        for part in parts:
            held += part
            end = held.find(b"\r\n\r\n")
            if end >= 0 or len(held) > HEADER:
                named = header(held[:end]) if 0 <= end <= HEADER else None
                held = held[end + 4 :]
                break
    except zlib.error:
        return None
    if named is None:
        return None
    length, http = int(named["content-length"]), named.get("content-type", "").startswith("application/http")
    left, head, size, digest, kept = length, b"", 0, hashlib.sha1(), []
    tail, broken, in_head = b"", False, http
    try:
        while True:
            block, held = held[:left], held[left:]
            left -= len(block)
            tail += held
            if in_head:
                head += block
                end = head.find(b"\r\n\r\n")
                if end >= 0:
                    head, block, in_head = head[: end + 4], head[end + 4 :], False
                else:
                    block = b""
            size += len(block)
            digest.update(block)
            if keep and block:
                kept.append(block)
            held = next(parts, None)
            if held is None:
                break
        broken = not stop or left > 0 or tail != b"\r\n\r\n"
    except zlib.error:
        broken = True
    return Record(offset, stop[0] if stop else offset + 1, named, size, None if broken else digest.hexdigest(), broken, b"".join(kept) if keep and not broken else None)


def owned(source: Source, begin: int, end: int, keep: bool = False) -> Iterator[Record]:
    """The records that start in [begin, end)."""
    at = begin
    while (found := source.find(at, end)) is not None:
        got = decoded(source, found, keep)
        if got is None:
            at = found + 1
            continue
        yield got
        at = got.stop


def ranges(manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """file, number, begin, end: the byte ranges of the archives (file, bytes)."""
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / split)))
    cut = manifest.where("bytes > 0").select("file", "bytes", number.alias("number"))
    return cut.select("file", "number", (F.col("number") * split).alias("begin"), F.least("bytes", (F.col("number") + 1) * split).alias("end"))


def scanned(wanted: DataFrame, folder: str, keep: bool = False) -> DataFrame:
    """The records of byte ranges (file, number, begin, end) of archives in a folder, with their payloads if those are to be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = opened(folder)
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in READ.split(", "))])
        out, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                source = Source(disk, f"{base}/{r['file']}")
                for got in owned(source, r["begin"], r["end"], keep):
                    f = got.named
                    revisit = f["warc-type"] == "revisit"
                    digest = f.get("warc-payload-digest", "").rpartition(":")[2] or None
                    bare = [v[1:-1] if (v := f.get(name)) and v[:1] == "<" else v for name in ("warc-record-id", "warc-refers-to")]
                    out.append((r["file"], r["number"], got.offset, got.stop, f["warc-type"], bare[0], f.get("warc-target-uri"), f.get("x-record-key"), bare[1], digest, None if revisit else got.length, None if revisit else got.digest, got.broken, got.payload))
                    size += 500 + len(got.payload or b"")
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
                source.file.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        release()

    return wanted.mapInArrow(run, READ)


def unchained(records: DataFrame) -> DataFrame:
    """file, number, first, due: ranges whose first record does not start where the last one before it ended."""
    span = records.groupBy("file", "number").agg(F.min("offset").alias("first"), F.max("stop").alias("last"))
    # a row for each range: ARCHIVE / SPLIT of an archive that is written here
    earlier = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return span.select("file", "number", "first", F.coalesce(F.max("last").over(earlier), F.lit(0)).alias("due")).where("first <> due")


def records(manifest: DataFrame, folder: str, split: int = SPLIT, keep: bool = False) -> DataFrame:
    """All records of archives (file, bytes), chained."""
    spark = manifest.sparkSession
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(partitions(spark), -(-total // TASK))
    found = written(scanned(ranges(manifest, split).repartition(tasks, "file", "number"), folder, keep))
    tried: DataFrame | None = None
    while True:
        wrong = unchained(found)
        if tried is not None:
            wrong = wrong.join(tried, ["file", "number", "due"], "left_anti")
        wrong = written(wrong)
        if wrong.isEmpty():
            return found
        # in each archive the first of them: all it holds is read again from where it is due to start, and what that reaches over goes
        first = wrong.groupBy("file").agg(F.min(F.struct("number", "due")).alias("w")).select("file", "w.number", "w.due")
        again = first.select("file", "number", F.col("due").alias("begin"), ((F.col("number") + 1) * split).alias("end"))
        new = written(scanned(again.where("begin < end"), folder, keep))
        reach = first.join(new.groupBy("file").agg(F.max("stop").alias("stop")), "file", "left").select("file", F.col("number").alias("at"), F.greatest("due", "stop").alias("stop"))
        found = written(_beyond(found, reach).unionByName(new))
        mark = first.select("file", "number", "due")
        tried = mark if tried is None else tried.unionByName(mark)


def _beyond(found: DataFrame, reach: DataFrame) -> DataFrame:
    """Records that stay beside what was read again: those of earlier ranges and those that start where it ends or later."""
    own = reach.select(F.col("file").alias("_file"), "at", F.col("stop").alias("_stop"))
    kept = found.join(own, F.col("file") == F.col("_file"), "left").where("at is null or number < at or (number > at and offset >= _stop)")
    return kept.drop("_file", "at", "_stop")


# ---- payloads once


def looked_up(rows: DataFrame, other: DataFrame, key: str, spread: list[str], most: int = 2_000) -> DataFrame:
    """rows left-joined with other (key once, w: about how many rows have it). Keys with more than the share 1/most of all w, so fewer than
    `most`, are broadcast; rows of these and rows without a key are dealt by a hash of the columns `spread` in the join of the rest."""
    total = other.agg(F.sum("w")).first()[0] or 0
    heavy = F.col("w") * most > total
    more = [c for c in other.columns if c not in (key, "w")]
    hot = other.where(heavy).select(F.col(key).alias("_h"), F.struct(*more).alias("_hot"))
    cold = other.where(~heavy).select(F.col(key).alias("_c"), F.struct(*more).alias("_cold"))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_h"), "left")
    dealt = F.when(F.col("_h").isNotNull() | F.col(key).isNull(), F.concat(F.lit("/"), F.xxhash64(*spread).cast("string"))).otherwise(F.col(key))
    rows = rows.withColumn("_k", dealt).join(cold, F.col("_k") == F.col("_c"), "left").withColumn("_f", F.coalesce("_hot", "_cold"))
    return rows.select("*", *[F.col(f"_f.{c}").alias(c) for c in more]).drop("_h", "_hot", "_k", "_c", "_cold", "_f")


def record_id(key: Column, digest: Column) -> Column:
    """A URN from a row's key and its payload's digest."""
    h = F.md5(F.concat_ws("|", key.cast("string"), digest))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def payloads(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Rows to archive: kind, record_id, uri, digest, length, key, refers, payload."""
    text = F.col(f"`{html}`").cast("string")
    payload = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("i"), F.col(f"`{url}`").cast("string").alias("uri"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("length"), F.sha1(payload).alias("digest"), payload.alias("payload"))
    group = F.when(F.col("length") >= least, F.concat_ws(":", "digest", "length")).alias("g")
    rows = rows.select("*", group)
    again = rows.where("g is not null").groupBy("g").agg(F.max("i").alias("r"), F.count("*").alias("w")).where("w > 1 and r is not null")
    rows = looked_up(rows, written(again), "g", ["i", "uri"])
    revisit = F.col("r").isNotNull() & ~F.col("i").eqNullSafe(F.col("r"))
    refers = F.when(revisit, record_id(F.col("r"), F.col("digest")))
    return rows.select(F.when(revisit, "revisit").otherwise("response").alias("kind"), record_id(F.col("i"), F.col("digest")).alias("record_id"), "uri", "digest", "length", F.col("i").cast("string").alias("key"), refers.alias("refers"), "payload")


def resolved(found: DataFrame) -> DataFrame:
    """Records with the length and digest of the full payload: a revisit's are those of the response it refers to, whose key is refers_key; where no such response is there they are null."""
    here = found.where("kind <> 'revisit'").select("key", "uri", "kind", "record_id", "payload_bytes", "payload_digest", F.lit(None).cast("string").alias("refers_key"))
    away = found.where("kind = 'revisit'").select("key", "uri", "kind", "record_id", F.col("refers_to").alias("ref"), "declared_digest")
    wanted = away.groupBy("ref").agg(F.count("*").alias("w"))
    responses = found.where("kind = 'response' and not broken").select(F.col("record_id").alias("ref"), "payload_bytes", "payload_digest", F.col("key").alias("refers_key"))
    one = written(wanted.join(responses, "ref").groupBy("ref").agg(*[F.first(c).alias(c) for c in ("w", "payload_bytes", "payload_digest", "refers_key")]))
    away = looked_up(away, one, "ref", ["record_id", "uri"]).where("payload_digest is null or payload_digest = declared_digest")
    return here.unionByName(away.select(*here.columns))


def folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as archives, read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    to = folder(pages.sparkSession)
    manifest = written(archived(payloads(pages, page_id, url, html), to))
    found = resolved(records(manifest, to))
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_key").cast("long").alias("refers_to"))
