"""Pages as rows: lines that an extractor has written, what each page holds, and scans in batches whose order changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an extractor writes for each line of a page: nothing is inferred, and a column that it lacks is null.
LINES = "page int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, font string, size double"
#: What a label, a page reference and a caption look like.
LABEL, REFERENCE = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3})?[a-d]?)$", r"(?i)\b(?:diagrams?|positions?|exercises?) +([0-9]{1,3}(?:\.[0-9]{1,3})?)"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a book's pages: Parquet with the schema above; columns and pages that a query does not ask for are not read."""
    return spark.read.schema(LINES).parquet(path)


def inspected(rows: DataFrame) -> DataFrame:
    """For each page: kind (empty, plate, text), lines, characters, labels that stand alone and diagrams that the text refers to, both in order. One aggregate, so pages are independent of each other."""
    label = F.when(F.trim("text").rlike(LABEL), F.struct("line_no", F.trim("text").alias("label")))
    refs = F.transform(F.regexp_extract_all("text", F.lit(REFERENCE), 1), lambda x, k: F.struct(F.col("line_no"), k.alias("k"), x.alias("ref")))
    each = rows.select("page", F.length(F.trim("text")).alias("chars"), label.alias("label"), refs.alias("refs"))
    agg = each.groupBy("page").agg(
        F.count("*").alias("lines"), F.sum("chars").alias("chars"),
        F.transform(F.array_sort(F.collect_list("label")), lambda x: x["label"]).alias("labels"),
        F.transform(F.array_sort(F.flatten(F.collect_list("refs"))), lambda x: x["ref"]).alias("refs"),
    )
    kind = F.when(F.col("chars") == 0, "empty").when(F.col("chars") < 40 * F.size("labels"), "plate").otherwise("text")
    return agg.select("page", kind.alias("kind"), "lines", "chars", "labels", "refs")


def scanned(rows: DataFrame, first: int, size: int, last: int) -> Iterator[DataFrame]:
    """Inspections in batches of pages, the batch of the wanted page first: each page is in one batch, so their union is the same in any order."""
    starts = list(range(0, last + 1, size))
    own = first // size * size
    for start in sorted(starts, key=lambda s: (s != own, s)):
        yield inspected(rows.where(F.col("page").between(start, start + size - 1)))
