"""Queries of the reading, correction, clustering and streaming operators over the driver tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import notation_values, scalars
from ..operators import chains, clusters, corrections, reading, windows
from ..operators.materialise import cut, shared_folder
from ..sources.tables import game_parts, pasted_json, table
from ..streaming import streams
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A game for each benchmark item; reading is dear by row, so rows are spread over all tasks."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("game")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "game")


@query()
def token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered runs of every whole text."""
    return reading.runs(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by kind and language: the language goes along as the texts' key, so there is one small aggregate and no join."""
    return reading.tokens(table(spark, sf_dir, "documents"), "lang", "text").groupBy("lang", "kind").agg(F.count("*").alias("n"))


@query()
def noise_decode_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of 30 to 80 plies, each printed in two notations at one of three levels of noise, read in two passes: places read rightly. Each level and notation is a book with a noise model of its own."""
    keys, books = _games(spark, sf_dir), []
    for k, level in enumerate(notation_values.LEVELS):
        mine = keys.where(F.pmod("game", F.lit(len(notation_values.LEVELS))) == k)
        books += [reading.printed_games(mine, "game", level, junk).withColumns({"level": F.lit(level), "junk": F.lit(junk)}) for junk in (False, True)]
    games = cut(reduce(DataFrame.unionByName, books).withColumn("print", F.concat_ws(" ", "level", "junk", "game")))
    runs = reading.main_runs(games, "print", "text").join(games.select("print", "level", "junk"), "print")
    read = reading.read_passes(cut(runs), "start", "moves", passes=2, by=["level", "junk"])
    return reading.accuracy(read.drop("level", "junk"), games, "print", ["level", "junk"])


@query()
def pgn_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of clean print assembled into trees, written as game text and read back."""
    keys = _games(spark, sf_dir)
    games = reading.printed_games(keys, "game", "low", False)
    lines = reading.validated(reading.assembled(games, "game", "text"))
    tags = game_parts(lines.withColumn("text", F.col("pgn")))
    return tags.select("game", "line", "status", "result", "valid", F.col("tags")["Event"].alias("event"), F.length("moves").alias("size"))


@query()
def game_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of assembled games as rows, counted by status and level."""
    keys = _games(spark, sf_dir)
    games = reading.printed_games(keys, "game", "low", False)
    return reading.nodes(reading.assembled(games, "game", "text")).groupBy("main", "status").agg(F.count("*").alias("n"), F.max("ply").alias("last"))


@query()
def text_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards printed as lines of text: each benchmark item prints the position after a random game between lines of prose."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), "text")
    shown = reading.printed_boards(items, "page", 12)
    lines = shown.select("page", F.posexplode(F.split(F.concat_ws("\n", F.lit("before"), "board", "text"), "\n")).alias("line", "text"))
    return reading.diagrams(lines, "page", "line", "text")


@query()
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clustering of each label's vectors in order of ids."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return clusters.leaders(e, "label", "vec_id", "embedding", 8.0).select("vec_id", "label", "cluster")


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 100 AS number, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 86400000000, CAST(floor(value) AS BIGINT) % 100, CAST(CAST(floor(value) AS BIGINT) % 100 AS VARCHAR), event_id) AS rn FROM events),
walk AS (
  SELECT user_id, event_id, rn, CASE WHEN number = 1 THEN number END AS last, number = 1 AS main FROM o WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.event_id, o.rn, CASE WHEN (w.last IS NULL AND o.number = 1) OR (o.number > w.last AND o.number - w.last <= 12) THEN o.number ELSE w.last END,
         coalesce((w.last IS NULL AND o.number = 1) OR (o.number > w.last AND o.number - w.last <= 12), false)
  FROM walk w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT user_id, event_id, main FROM walk
""")
def main_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main numbered series of each user's events, walked by day and number."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_date(F.col("ts").cast("date")).alias("page"), (F.floor("value") % 100).cast("string").alias("label"))
    return chains.main_series(e, "user_id", ["page"], "label", ["event_id"]).select("user_id", "event_id", "main")


_FIXED = "SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'fixed' ELSE lang END AS lang, source, n_chars FROM documents"


@query(f"SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM ({_FIXED}) GROUP BY source, lang")
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections applied, touched sources derived again and the others kept: equal to a fresh build."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "doc_id", "lang", "source", "n_chars")
    fixes = d.where("doc_id % 17 = 0").select(F.lit("moves").alias("part"), "key", F.lit("fixed").alias("value"), F.lit(False).alias("auto"), F.col("doc_id").alias("seq"))
    derive = lambda x: x.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    new = corrections.applied(d, fixes, "key", {"moves": "lang"})
    return corrections.maintained(derive(d), d, new, "source", derive)


@query(f"SELECT o.source FROM documents o JOIN ({_FIXED}) n USING (doc_id) WHERE o.lang <> n.lang GROUP BY o.source")
def touched_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose rows a correction changes, by signatures."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    new = d.withColumn("lang", F.when(F.col("doc_id") % 17 == 0, "fixed").otherwise(F.col("lang")))
    return corrections.touched(d, new, "source")


@query("""
WITH f AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'bogus' ELSE 'moves' END AS part, (doc_id % 50) || ':1,2:' || lang AS key, source AS value, doc_id % 3 = 0 AS auto FROM documents)
SELECT part, key, arg_max(value, (CAST(NOT auto AS INTEGER), doc_id)) AS value, arg_max(auto, (CAST(NOT auto AS INTEGER), doc_id)) AS auto FROM f WHERE part <> 'bogus' GROUP BY part, key
""")
def canonical_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction set made canonical."""
    d = table(spark, sf_dir, "documents")
    f = d.select(
        F.when(F.col("doc_id") % 4 == 0, "bogus").otherwise("moves").alias("part"), F.concat((F.col("doc_id") % 50).cast("string"), F.lit(":1,2:"), "lang").alias("key"), F.col("source").alias("value"), (F.col("doc_id") % 3 == 0).alias("auto"), F.col("doc_id").alias("seq")
    )
    return corrections.canonical(f).select("part", "key", "value", "auto")


@query("SELECT page_id FROM pages WHERE NOT (page_id BETWEEN 10 AND 40 OR page_id BETWEEN 100 AND 180)")
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages outside the excluded ranges."""
    ranges = spark.createDataFrame([(10, 40), (100, 180)], "start long, end long")
    return corrections.selected(table(spark, sf_dir, "pages").select("page_id"), "page_id", ranges)


@query("""
SELECT doc_id, CASE WHEN doc_id % 100 BETWEEN 11 AND 13 THEN doc_id || 'th' WHEN doc_id % 10 = 1 THEN doc_id || 'st' WHEN doc_id % 10 = 2 THEN doc_id || 'nd' WHEN doc_id % 10 = 3 THEN doc_id || 'rd' ELSE doc_id || 'th' END AS ordinal,
  CASE WHEN n_chars = 1 THEN '1 char' ELSE n_chars || ' chars' END AS plural, CASE WHEN doc_id - 12 > 0 THEN doc_id - 12 END AS folio, (doc_id - 1) * 2 + CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END AS ply,
  doc_id || ':' || CAST(round(n_chars / 7.0) AS BIGINT) || ',3:' || source AS key, sha256(trim(text, chr(10) || chr(13) || chr(160) || ' ')) AS stripped_sha256 FROM documents
""")
def scalar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions of numbers, keys and spaces; whole texts are stripped."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", scalars.ordinal(F.col("doc_id")).alias("ordinal"), scalars.plural(F.col("n_chars"), "char").alias("plural"), scalars.folio(F.col("doc_id"), F.lit(12)).alias("folio"), scalars.ply(F.col("doc_id"), F.col("n_chars") % 2 == 0).alias("ply"),
        scalars.token_key(F.col("doc_id"), F.col("n_chars") / 7.0, F.lit(3), F.col("source")).alias("key"), F.sha2(scalars.strip_real(F.col("text")), 256).alias("stripped_sha256"),
    )


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 9 WHEN 3 THEN 1994 WHEN 4 THEN 40 END AS value FROM documents
""")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("I", "iv", "IX", "MCMXCIV", "xl", "abc")])
    return table(spark, sf_dir, "documents").select("doc_id", scalars.roman(F.get(words, (F.col("doc_id") % 6).cast("int"))).alias("value"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1921 END AS year, CASE WHEN doc_id % 2 = 0 THEN 'Lasker ' || doc_id END AS white FROM documents")
def game_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Lasker "), F.col("doc_id").cast("string"), F.lit(" - Capablanca, Havana 1 921"))).otherwise("no header")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.header(text).alias("h")).select("doc_id", F.col("h.year").alias("year"), F.col("h.white").alias("white"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS version FROM events")
def pasted_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON inside prose."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", pasted_json(F.concat(F.lit("Here it is:\n```json\n"), F.replace("props", F.lit('"k"'), F.lit('"version"')), F.lit("\n```\nbye"))).getField("version").alias("version"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins over a stream: versions merged by micro-batch."""
    path = _folder(spark, "latest")
    stream = streams.files(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", "value", "ts")
    streams.drained(stream, path, "append", streams.merged_into(spark, f"{path}/table", ["user_id", "event_type"], "ts", "event_id"))
    return streams.merged(spark, f"{path}/table").select("user_id", "event_type", "event_id", "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over a stream: a batch gives the windows that it changes, state older than the watermark is let go, and the last word on each window is kept."""
    path = _folder(spark, "windows")
    stream = streams.files(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    keep = streams.merged_into(spark, f"{path}/table", ["start", "event_type"], "batch", "n")
    streams.drained(streams.windowed(stream, "ts", "event_type", "value", "1 hour", "7 days"), path, "update", lambda batch, number: keep(batch.withColumn("batch", F.lit(number)), number))
    return streams.merged(spark, f"{path}/table").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins with keyed state: a changelog of newest records, and the last row of each key."""
    path = _folder(spark, "records")
    stream = streams.files(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/n={number}")

    with streams.keyed_state(spark):
        streams.drained(streams.last_writes(stream, ["user_id"], "at", "event_id"), path, "update", sink)
    log = spark.read.parquet(f"{path}/log")
    return log.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("n", "at", "event_id")).alias("r")).select("user_id", "r.*")


@query("""
SELECT user_id, event_type, best FROM (
  SELECT user_id, event_type, best, row_number() OVER (PARTITION BY user_id ORDER BY used DESC, event_type) AS rn FROM (SELECT user_id, event_type, max(value) AS best, max(event_id) AS used FROM events GROUP BY ALL)) WHERE rn <= 3
""")
def stream_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best value of each kind so far, for the three kinds of a user seen last, in keyed state of bounded size."""
    path = _folder(spark, "best")
    stream = streams.files(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type", F.col("value").alias("best"), F.col("event_id").alias("used"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/n={number}")

    with streams.keyed_state(spark):
        streams.drained(streams.best_so_far(stream, "user_id", "event_type", "best", "used", 3), path, "update", sink)
    log = spark.read.parquet(f"{path}/log")
    last = log.groupBy("user_id").agg(F.max("n").alias("n"))
    return log.join(last, ["user_id", "n"], "left_semi").select("user_id", "event_type", "best")
