"""Streams give what a batch gives, also after a stop, and in any order of parts."""

from __future__ import annotations

from pyspark.sql import functions as F
from tessera.streaming import streams


def write(spark, path, rows):
    spark.createDataFrame(rows, "k int, at long, i long, v string").coalesce(1).write.mode("append").parquet(path)


def test_merged_versions_resume(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, src, [(1, 10, 1, "a"), (2, 10, 2, "b")])
    for more in (None, [(1, 10, 3, "c"), (2, 9, 4, "d")], [(3, 1, 5, "e")]):
        if more:
            write(spark, src, more)
        streams.drained(streams.files(spark, src), out, "append", streams.merged_into(spark, f"{out}/table", ["k"], "at", "i"))
    assert [(r.k, r.v) for r in streams.merged(spark, f"{out}/table").orderBy("k").collect()] == [(1, "c"), (2, "b"), (3, "e")]


def test_merged_tables_do_not_grow_with_batches(spark, tmp_path):
    """Of a key written by many batches the last two versions are there at most; keys of other parts stay where they are."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(6):
        write(spark, src, [(1, k, k, f"v{k}"), (100 + k, 1, k, "x")])
        streams.drained(streams.files(spark, src), out, "append", streams.merged_into(spark, f"{out}/table", ["k"], "at", "i"))
    assert {r.k: r.v for r in streams.merged(spark, f"{out}/table").collect()} == {1: "v5"} | {100 + k: "x" for k in range(6)}
    own = spark.range(1).select(F.pmod(F.xxhash64(F.lit(1)), F.lit(streams.PARTS))).first()[0]
    assert sum(own in parts for parts in streams._versions(spark, f"{out}/table").values()) <= 2


def test_sessions(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, src, [(1, 0, 1, "a"), (1, 60, 2, "b"), (1, 9000, 3, "c")])
    s = streams.files(spark, src).withColumn("ts", F.timestamp_seconds("at"))

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/v{number}")

    streams.drained(streams.sessions(s, "ts", "k", "10 minutes", "3650 days"), out, "complete", sink)
    assert sorted(r.n for r in streams.newest(spark, out).collect()) == [1, 2]


def test_order_of_parts_does_not_change_them(spark):
    assert streams.prioritised([1, 2, 3, 4], [3, 9, 1]) == [3, 1, 2, 4]
    df = spark.range(9).withColumn("part", (F.col("id") % 3).cast("int"))
    derive = lambda d: d.agg(F.sum("id").alias("s"))
    one = {p: d.first().s for p, d in streams.by_parts(df, "part", [0, 1, 2], derive)}
    assert one == {p: d.first().s for p, d in streams.by_parts(df, "part", [2, 0, 1], derive)}


def test_keyed_state_keeps_the_newest(spark, tmp_path):
    """The changelog's last row of a key is its record; a late, older record changes nothing."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, src, [(1, 10, 1, "a"), (2, 10, 2, "b")])

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/log/n={number}")

    for more in (None, [(1, 10, 3, "c"), (2, 9, 4, "d")]):
        if more:
            write(spark, src, more)
        with streams.keyed_state(spark):
            streams.drained(streams.last_writes(streams.files(spark, src), ["k"], "at", "i"), out, "update", sink)
    last = {}
    for r in spark.read.parquet(f"{out}/log").orderBy("n", "i").collect():
        last[r.k] = r.v
    assert last == {1: "c", 2: "b"}
