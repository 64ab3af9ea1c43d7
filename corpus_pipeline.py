"""A corpus pipeline over documents: stages in order, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame. All but the
last return the columns of documents; the last returns one row a document with its pieces, their digest and checks.

Edge cases, alike in all stages: a null or empty text is scored, deduplicated and encoded like any other (a null stays null
until the last stage, where it has no pieces); very long texts are taken whole; rows without an id are kept until a stage's rule
drops their text; repeated rows are one row after near_duplicates; an empty table passes through; further
columns, whatever their names, pass through all stages but the last. The Parquet of the stages stays in the shared folder until its owner removes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, lines, pieces, quality
from tessera.llm.common import checkpoint_dir
from tessera.llm.queries import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking rejects go. Labels are a table of their own, learnt from as in op9; without both labels all stay."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first that has them; no document goes, and one whose lines all go has an empty text."""
    return lines.dedup(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays, that with the smallest id: SimHash over five-word shingles, each link checked by a Jaccard of 0.8 or more, and an exact complement; texts without words are one class."""
    return jaccard.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that benchmark items share go; no document goes."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each text, their number and digest, parity with the library and round trip."""
    return pieces.digests(docs, keep=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pieces", piece_stage),
]

#: The stages learn, hash and tokenise beyond SQL; run() is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
