"""Writers of results: a book as JSON, one chapter of it, and parts that are kept by version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def book_json(lines: DataFrame, chapter: str) -> DataFrame:
    """One JSON object a chapter: its lines in order as an array; null fields are left out."""
    row = F.struct(*[F.col(c) for c in lines.columns if c != chapter])
    return lines.groupBy(chapter).agg(F.array_sort(F.collect_list(row)).alias("lines")).select(chapter, F.to_json(F.struct(chapter, "lines"), {"ignoreNullFields": "true"}).alias("value"))


def write_book(lines: DataFrame, chapter: str, path: str) -> None:
    """A folder a chapter; chapters are written side by side, so a book of any size has no single writer."""
    book_json(lines, chapter).repartition(chapter).write.partitionBy(chapter).mode("overwrite").text(path)


def chapter_data(lines: DataFrame, chapter: str, which: int, columns: list[str]) -> DataFrame:
    """One chapter's projection as JSON: the filter and the columns reach the scan."""
    return lines.where(F.col(chapter) == which).select(F.to_json(F.struct(*columns)).alias("value"))


def write_part(part: DataFrame, chapter: int, version: int, path: str) -> None:
    """A finished part under its version: later versions replace it when read, and a part that is written again is the same."""
    part.drop("chapter", "version").write.mode("overwrite").parquet(f"{path}/chapter={chapter}/version={version}")
