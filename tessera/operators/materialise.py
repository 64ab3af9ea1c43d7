"""Cutting a lineage in loops, by a reliable checkpoint in the session's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.conf.get("spark.checkpoint.dir", None) and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def handed_on(df: DataFrame) -> DataFrame:
    """cut() for what a loop hands on from round to round, without the plan's estimate of its size.

    A join is estimated at the product of its sides and a checkpoint keeps the estimate, so where rounds join their own results its digits multiply with each round, up to all of the driver's memory. Rows that come in as an RDD have a fixed one instead;
    how large they are, adaptive execution sees."""
    spark = df.sparkSession
    return cut(DataFrame(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark))
