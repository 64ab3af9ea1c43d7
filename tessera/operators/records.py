"""A record store over tables: what SQL statements of a keyed store do, as new versions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, arriving: DataFrame, keys: list[str], updated: str, arrival: str) -> DataFrame:
    """Newer or equal wins: of equal times the later arrival; of what is stored and what arrives at one time, what arrives."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(arriving.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(updated).desc_nulls_last(), F.col("_new").desc(), F.col(arrival).desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def insert_ignore(stored: DataFrame, arriving: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows whose keys are not stored yet; the first of equal keys."""
    first = arriving.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti"))


def update(stored: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], when: Column | None = None, largest: tuple[str, ...] = ()) -> DataFrame:
    """Set columns of the rows that changes name (one row a key, columns prefixed n_); those in `largest` keep the larger value, null counting as 0."""
    joined = stored.join(changes, keys, "left")
    given = F.col(f"n_{columns[0]}").isNotNull() if when is None else when

    def value(c: str) -> Column:
        new = F.greatest(F.coalesce(c, F.lit(0)), F.col(f"n_{c}")) if c in largest else F.col(f"n_{c}")
        return F.when(given, new).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) if c in columns else F.col(c) for c in stored.columns])


def delete(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys), keys, "left_anti")


def newest_first(stored: DataFrame, opened: str, added: str) -> DataFrame:
    return stored.orderBy(F.coalesce(opened, added).desc())


def created(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored table, made empty if there is none yet: what is there stays. Keys are kept by what writes to it (upsert, insert_ignore)."""
    from ..streaming.streams import _exists

    if not _exists(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def owned(stored: DataFrame, owner: Column, kind: Column) -> DataFrame:
    """An owner's records of a kind; both filters reach the scan."""
    return stored.where(owner & kind)


def with_marks(books: DataFrame, marks: DataFrame, keys: list[str], order: list[str], name: str = "marks") -> DataFrame:
    """Each record with its marks in order; an empty list where it has none."""
    values = F.struct(*order, *[c for c in marks.columns if c not in (*keys, *order)])
    each = marks.groupBy(*keys).agg(F.array_sort(F.collect_list(values)).alias(name))
    kind = each.schema[name].dataType
    return books.join(each, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
