"""Game files as a Python data source: byte ranges cut at games, in batch and as a stream.

`spark.dataSource.register(GameSource)`, then `spark.read.format("game_files").option("path", ...)`. A file of any size is as many partitions as it has ranges of `split` bytes: a range owns the games that start in
it and reads its last one to its end, so each game is read once and no task holds more than a game and a piece. Naming fewer columns by `.schema(...)` reads and sends only those.

A game starts at a line with an Event tag; what stands before a file's first one is no game. Bytes that are not UTF-8 are replaced; of a tag that a game has twice the last one counts; a game without moves has empty
ones; an empty file or folder has no rows. Files whose names start with a dot or an underscore are left out.

The stream's progress is how many bytes of each file have been read: new files and what is appended to old ones are read once. Whole games must be appended.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

COLUMNS = "file string, offset long, tags map<string,string>, moves string"
#: Bytes of a range, of what is read at once, and of the games in a batch.
SPLIT, PIECE, BATCH = 16 << 20, 1 << 20, 4 << 20
MARK = b"\n[Event "
_TAG = re.compile(r'(?m)^\[(\w+) "([^"]*)"\]\s*?$')
_KINDS = {"file": pa.string(), "offset": pa.int64(), "tags": pa.map_(pa.string(), pa.string()), "moves": pa.string()}


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


def listed(path: str) -> dict[str, int]:
    """The files of a folder, or one file, with their bytes."""
    disk, base = fs.FileSystem.from_uri(path)
    scheme = path[: len(path) - len(base)] if path.endswith(base) else ""
    info = disk.get_file_info(base)
    found = disk.get_file_info(fs.FileSelector(base, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return {f"{scheme}{f.path}": f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[:1] not in "._"}


def ranges(sizes: dict[str, int], split: int, done: dict[str, int] | None = None) -> list[Range]:
    out = []
    for file, size in sizes.items():
        first = (done or {}).get(file, 0)
        out += [Range(file, at, min(at + split, size)) for at in range(first, size, split)]
    return out


def games(part: Range, piece: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each game that starts in a range."""
    disk, path = fs.FileSystem.from_uri(part.file)
    with disk.open_input_file(path) as f:
        base = part.begin - 1  # the byte before the range ends a line, or the file starts there
        f.seek(max(base, 0))
        data, more = (b"\n" if base < 0 else b"") + f.read(piece), True
        at = 0
        while True:
            start = data.find(MARK, at)
            if start < 0:
                keep = len(MARK) - 1
                if base + max(len(data) - keep, 0) + 1 >= part.end:
                    return
                base, data = base + max(len(data) - keep, 0), data[-keep:]
                new = f.read(piece)
                if not new:
                    return
                data, at = data + new, 0
                continue
            if base + start + 1 >= part.end:
                return
            stop, seen = -1, start + 1
            while more and (stop := data.find(MARK, seen)) < 0:
                new = f.read(piece)
                more, seen = bool(new), max(len(data) - len(MARK), start + 1)
                data += new
            if stop < 0:
                stop = data.find(MARK, start + 1)
            yield base + start + 1, data[start + 1 : stop + 1 if stop >= 0 else len(data)]
            if stop < 0:
                return
            base, data, at = base + stop, data[stop:], 0


def rows(part: Range, names: list[str]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, _KINDS[n]) for n in names])
    held: list[dict] = []
    size = 0
    for offset, raw in games(part):
        row: dict = {"file": part.file, "offset": offset}
        if "tags" in names or "moves" in names:
            text = raw.decode("utf-8", "replace")
            row["tags"] = list(dict(_TAG.findall(text)).items())
            row["moves"] = _TAG.sub("", text).strip() if "moves" in names else None
        held.append({n: row[n] for n in names})
        size += len(raw)
        if size >= BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class GameReader(DataSourceReader):
    def __init__(self, path: str, split: int, names: list[str]) -> None:
        self.path, self.split, self.names = path, split, names

    def partitions(self) -> Sequence[InputPartition]:
        return ranges(listed(self.path), self.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows(partition, self.names) if partition.file else iter(())


class GameStream(DataSourceStreamReader):
    def __init__(self, path: str, split: int, names: list[str]) -> None:
        self.path, self.split, self.names = path, split, names

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return listed(self.path)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return ranges(end, self.split, start) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows(partition, self.names) if partition.file else iter(())


class GameSource(DataSource):
    """Options: path (a file or folder by any URI that pyarrow opens), split (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "game_files"

    def schema(self) -> str:
        return COLUMNS

    def _made(self, kind: type, schema: StructType):
        names = schema.fieldNames()
        if set(names) - set(_KINDS):
            raise ValueError(f"game files have the columns {COLUMNS}")
        return kind(self.options["path"], int(self.options.get("split", SPLIT)), names)

    def reader(self, schema: StructType) -> GameReader:
        return self._made(GameReader, schema)

    def streamReader(self, schema: StructType) -> GameStream:
        return self._made(GameStream, schema)


def read(spark: SparkSession, path: str, columns: str = COLUMNS, split: int = SPLIT) -> DataFrame:
    """The games of files, a partition a range."""
    spark.dataSource.register(GameSource)
    return spark.read.format("game_files").schema(columns).option("path", path).option("split", split).load()


def stream(spark: SparkSession, path: str, columns: str = COLUMNS, split: int = SPLIT) -> DataFrame:
    """The games of files as they come."""
    spark.dataSource.register(GameSource)
    return spark.readStream.format("game_files").schema(columns).option("path", path).option("split", split).load()
