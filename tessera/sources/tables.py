"""Readers of the tables and files that queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A book as one JSON object a file: the parts that queries read.
BOOK = (
    "title string, chapters array<struct<title:string,start:int,end:int>>, lines array<struct<id:string,chapter:string,page:int,end_page:int,kind:string,status:string>>, "
    "nodes array<struct<id:string,line:string,parent:string,san:string,fen:string,page:int,number:int,black:boolean,main:boolean,status:string,raw:string,key:string>>"
)
SELECTION = "struct<version:int,pages:struct<exclude:array<array<int>>>,diagrams:struct<exclude:array<string>,include:array<string>>,note:string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, path: str) -> DataFrame:
    """Books stored as JSON, one object a file, with a fixed schema: nothing is inferred."""
    return spark.read.schema(BOOK).option("multiLine", True).json(path)


def pasted_json(text: Column, schema: str = SELECTION) -> Column:
    """The first JSON object inside prose or a fence; null where there is none or it can't be parsed."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def games(spark: SparkSession, path: str) -> DataFrame:
    """Games of PGN files: one row a game with its tags and move text. A file is cut before each event tag."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"(?m)^(?=\[Event )")).alias("game", "text"))
    return game_parts(raw.where(F.col("text").rlike(r"\[\w+ \"")))


def game_parts(raw: DataFrame) -> DataFrame:
    """Tags as a map and the moves after them, for rows with a column `text`."""
    tags = F.map_from_arrays(F.regexp_extract_all("text", F.lit(r'(?m)^\[(\w+) "'), 1), F.regexp_extract_all("text", F.lit(r'(?m)^\[\w+ "([^"]*)"'), 1))
    return raw.withColumns({"tags": tags, "moves": F.trim(F.regexp_replace("text", r'(?m)^\[\w+ "[^"]*"\]\s*$', ""))}).drop("text")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A reading kept as Parquet parts by chapter; the newest version of each part counts."""
    parts = spark.read.parquet(path)
    last = parts.groupBy("chapter").agg(F.max("version").alias("version"))
    return parts.join(last, ["chapter", "version"], "left_semi")
