"""Queries of layout, notation, naming, repair and maintenance operators: over the driver tables with SQL where it can express them, else over golden cases whose results are stated by hand as VALUES."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import board, scalars
from ..operators import aggregates, chains, clusters, corrections, inference, layout, paths, quality, reading, records, windows
from ..operators.materialise import shared_folder
from ..sources import pages, sinks, tables
from ..sources.tables import table
from ..streaming import streams
from .registry import case, query


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of stated rows."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns})"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- over the driver tables

_LINES = "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN true WHEN doc_id % 3 = 0 THEN false ELSE doc_id % 5 > 1 END AS kept FROM documents")
def selected_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit include over exclude over the default by kind."""
    kind = F.when(F.col("doc_id") % 5 == 0, "decoration").when(F.col("doc_id") % 5 == 1, "cover").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", corrections.diagram_selected(kind, F.col("doc_id") % 7 == 0, F.col("doc_id") % 3 == 0).alias("kept"))


@query("SELECT doc_id FROM documents WHERE doc_id <= 140 AND doc_id + n_chars % 50 >= 100")
def overlapping_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") + F.col("n_chars") % 50).alias("last"))
    return layout.overlapping(d, "doc_id", "last", 100, 140).select("doc_id")


@query("SELECT event_id FROM events WHERE event_id % 100 <= 45 AND event_id % 100 + 7 >= 25 AND user_id % 60 <= 35 AND user_id % 60 + 3 >= 15")
def near_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that touch a rectangle grown by five."""
    x, y = F.col("event_id") % 100, F.col("user_id") % 60
    own = {"x0": x, "x1": x + 7, "y0": y, "y1": y + 3}
    return table(spark, sf_dir, "events").where(scalars.box_near(own, {"x0": F.lit(30), "x1": F.lit(40), "y0": F.lit(20), "y1": F.lit(30)}, 5)).select("event_id")


@query("SELECT doc_id, sha256(replace(text, ' ', ' TITLE ')) AS rest_sha256 FROM documents")
def unglued_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title is injected after each e, where it is glued, and at each space, where it stands alone: only the glued ones go, in whole texts."""
    injected = F.replace(F.replace("text", F.lit(" "), F.lit(" TITLE ")), F.lit("e"), F.lit("eTITLE"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(layout.unglued(injected, "TITLE"), 256).alias("rest_sha256"))


@query(r"""
SELECT shape, count(*) AS n FROM (
  SELECT CASE WHEN regexp_matches(w, '^(?:[0-9]{1,3}\.(?:\.\.)?)?(?:[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?|O-O(?:-O)?)[+#!?]*$') THEN 'strong'
              WHEN regexp_matches(w, '[a-h£t][1-8lIsSB][t+#!?]*$') AND length(w) <= 8 THEN 'weak' ELSE 'none' END AS shape
  FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents)) GROUP BY shape
""")
def word_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all whole texts by how much they look like a move."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    return words.groupBy(layout.word_shape(F.col("w")).alias("shape")).agg(F.count("*").alias("n"))


@query("""
SELECT user_id FROM events GROUP BY user_id
HAVING NOT arg_min(event_type = 'error', event_id) AND avg(CAST(event_type = 'error' AS INTEGER)) <= 0.2 AND avg(CASE WHEN event_type <> 'error' THEN event_id % 4 END) <= 1.5
""")
def cleanly_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs: errors are failures."""
    costs = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 4).alias("cost"), (F.col("event_type") == "error").alias("failed"))
    return layout.clean_runs(costs, "user_id", "event_id", "cost", "failed")


@query("""
SELECT user_id, CASE WHEN share = 0 AND mean <= 1.5 THEN 0 WHEN NOT first AND share <= 0.2 THEN 1 ELSE 2 END AS fit FROM (
  SELECT user_id, avg(CAST(event_type = 'error' AS INTEGER)) AS share, avg(CASE WHEN event_type <> 'error' THEN event_id % 4 END) AS mean, arg_min(event_type = 'error', event_id) AS first FROM events GROUP BY user_id)
""")
def run_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), (F.col("event_id") % 4).alias("cost"), (F.col("event_type") == "error").alias("failed"))
    return layout.run_fit(costs, "user_id", "cost", "failed").select("user_id", "fit")


@query("SELECT d.doc_id, d.lang, coalesce(m.marks, '') AS marks FROM documents d LEFT JOIN (SELECT doc_id, string_agg(quality || ':' || toxic, ',' ORDER BY quality, toxic) AS marks FROM labels GROUP BY doc_id) m USING (doc_id)")
def bookmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their marks in order, an empty list where there are none."""
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    out = records.with_marks(table(spark, sf_dir, "documents").select("doc_id", "lang"), marks, ["doc_id"], ["quality"])
    return out.select("doc_id", "lang", F.array_join(F.transform("marks", lambda m: F.concat_ws(":", m["quality"].cast("string"), m["toxic"].cast("string"))), ",").alias("marks"))


@query("SELECT d.doc_id, d.doc_id % 9 AS page, n.n_name AS chapter, r.r_name AS book FROM documents d LEFT JOIN nation n ON d.doc_id % 30 = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi lookups from row to mark to chapter: the small sides are broadcast by their size."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 9).alias("page"), (F.col("doc_id") % 30).alias("k"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return d.join(n, F.col("k") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("doc_id", "page", F.col("n_name").alias("chapter"), F.col("r_name").alias("book"))


@query("SELECT doc_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS diagram FROM documents WHERE CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 2 = 0")
def reached_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose position is a diagram's: the first field of one is the other's placement."""
    d = table(spark, sf_dir, "documents")
    nodes = d.select("doc_id", F.concat("source", F.lit(" w - - 0 1")).alias("fen"))
    shown = d.select(F.col("source").alias("placement"), F.regexp_extract("source", "([0-9]+)", 1).cast("long").alias("id")).distinct().where("id % 2 = 0")
    return layout.reached(nodes, shown).select("doc_id", "diagram")


@query("SELECT doc_id, sha256(translate(text, 'lI|OoSsB', '11100888')) AS digits_sha256 FROM documents")
def ocr_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(scalars.ocr_digits(F.col("text")), 256).alias("digits_sha256"))


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type || ' of the ' || p_name), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('a', 'an', 'and', 'at', 'by', 'for', 'in', 'of', 'on', 'the', 'to') THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ') AS title FROM part
""")
def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.title_case(F.concat("p_type", F.lit(" of the "), "p_name")).alias("title"))


@query("SELECT l_orderkey, min(l_partkey % 100) AS x0, min(l_suppkey % 40) AS y0, max(l_partkey % 100 + l_linenumber) AS x1, max(l_suppkey % 40 + 5) AS y1 FROM lineitem GROUP BY l_orderkey")
def order_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest box around an order's boxes."""
    x, y = F.col("l_partkey") % 100, F.col("l_suppkey") % 40
    own = F.struct(x.alias("x0"), y.alias("y0"), (x + F.col("l_linenumber")).alias("x1"), (y + 5).alias("y1"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(own).alias("b")).select("l_orderkey", scalars.box_union(F.col("b")).alias("u")).select("l_orderkey", "u.*")


@query("SELECT doc_id, 10 + (n_chars % 90) / 30.0 * (doc_id % 10) AS x0, 10 + (n_chars % 90) / 30.0 * (doc_id % 10 + 5) AS x1 FROM documents")
def word_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a word of thirty, cut in proportion."""
    part = scalars.word_part(F.lit(10.0), 10.0 + F.col("n_chars") % 90, F.lit(30), F.col("doc_id") % 10, F.col("doc_id") % 10 + 5)
    return table(spark, sf_dir, "documents").select("doc_id", part.alias("p")).select("doc_id", "p.*")


@query(r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '[{}\x00-\x1f\x7f]', ' ', 'g'), ' +', ' ', 'g'))) AS comment_sha256 FROM pages")
def clean_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments without braces and control characters, from whole pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(scalars.clean_comment(F.col("html")), 256).alias("comment_sha256"))


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'M' || (doc_id % 7 - 3) ELSE printf('%+.1f', ((doc_id % 100 - 50) * 10) / 100.0) END AS score FROM documents")
def engine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    mate = F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") % 7 - 3)
    return table(spark, sf_dir, "documents").select("doc_id", scalars.engine_score((F.col("doc_id") % 100 - 50) * 10, mate).alias("score"))


@query("SELECT l_orderkey AS board, round(sum(l_quantity * 1000) - sum(l_extendedprice), 2) AS gain, round(sum(l_quantity * 1000) - sum(l_extendedprice), 2) > 12 AS turned FROM lineitem GROUP BY l_orderkey")
def turned_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards whose squares read better turned around."""
    squares = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("board"), F.col("l_extendedprice").alias("as_is"), (F.col("l_quantity") * 1000).alias("around"))
    return inference.turned(squares, "board").withColumn("gain", F.round("gain", 2))


@query("SELECT l_orderkey AS drawing, arg_min(l_suppkey, (l_quantity, l_suppkey)) AS name FROM lineitem WHERE l_quantity < 2 * 12 AND 1 - l_discount * 5 > 0.7 GROUP BY l_orderkey")
def attached_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("drawing"), F.col("l_suppkey").alias("name"), F.col("l_quantity").alias("distance"), (1 - F.col("l_discount") * 5).alias("iou"))
    return inference.attached(pairs, "drawing", "name", 12.0)


@query("""
SELECT l_orderkey AS drawing, CASE WHEN other IS NULL THEN 1.0 ELSE greatest(0.0, 1 - near / other) END AS closeness FROM (
  SELECT l_orderkey, min(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS near, min(CASE WHEN l_returnflag <> 'N' THEN l_quantity END) AS other FROM lineitem GROUP BY l_orderkey) WHERE near IS NOT NULL
""")
def drawing_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("drawing"), F.col("l_returnflag").alias("name"), F.lit("N").alias("own"), F.col("l_quantity").alias("distance"))
    return inference.closeness(pairs, "drawing").where("near is not null").select("drawing", "closeness")


@query("""SELECT o_custkey, to_json({'o_custkey': o_custkey, 'lines': list({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus} ORDER BY o_orderkey)}) AS value FROM orders GROUP BY o_custkey""")
def book_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object a chapter with its lines in order."""
    return sinks.book_json(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def books_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters written side by side as JSON and read back."""
    path = _folder(spark, "book")
    sinks.write_book(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_name"), "c_mktsegment", path)
    back = spark.read.text(path).where("c_mktsegment = 'BUILDING'").select(F.from_json("value", "lines array<struct<c_custkey:bigint,c_name:string>>").alias("b"))
    return back.select(F.explode("b.lines").alias("l")).select("l.*")


@query("SELECT to_json({'doc_id': doc_id, 'lang': lang}) AS value FROM documents WHERE source = 'src1'")
def chapter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chapter's projection: filter and columns reach the scan."""
    return sinks.chapter_data(table(spark, sf_dir, "documents").withColumn("n", F.regexp_extract("source", "([0-9]+)", 1).cast("int")), "n", 1, ["doc_id", "lang"])


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'error'")
def stage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON files, a folder a kind, and one kind read back with its schema."""
    path = _folder(spark, "stage")
    table(spark, sf_dir, "events").select("event_id", "event_type", "value").write.partitionBy("event_type").json(path)
    return spark.read.schema("event_id long, value double, event_type string").json(path).where("event_type = 'error'").select("event_id", "event_type", "value")


@query("SELECT doc_id % 20 AS chapter, doc_id, CASE WHEN doc_id % 20 < 5 THEN upper(lang) ELSE lang END AS lang FROM documents")
def stored_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts kept by chapter and version; a later version of five chapters replaces the first when read."""
    path = _folder(spark, "parts")
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).cast("int").alias("chapter"), "doc_id", "lang")
    d.withColumn("version", F.lit(1)).write.partitionBy("chapter", "version").mode("append").parquet(path)
    d.where("chapter < 5").withColumns({"lang": F.upper("lang"), "version": F.lit(2)}).write.partitionBy("chapter", "version").mode("append").parquet(path)
    return tables.stored(spark, path).select("chapter", "doc_id", "lang")


@query("SELECT o_orderkey, 2 * o_totalprice AS double_price FROM orders")
def shown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private fields are hidden."""
    return layout.hidden_removed(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("_owner"), (2 * F.col("o_totalprice")).alias("double_price")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '{\"k\":' || o_orderkey || '}' ELSE '{\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\"}' END AS value FROM orders")
def optional_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subset of columns as JSON; null fields are left out."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderstatus")).alias("s")), {"ignoreNullFields": "true"}).alias("value"))


@query("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, n_chars, doc_id) AS place FROM documents")
def sorted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in order of (chapter, offset), by place: one sort of the whole table."""
    return paths.placed_within(table(spark, sf_dir, "documents").select("lang", "source", "n_chars", "doc_id"), ["lang"], ["source", "n_chars", "doc_id"]).select("lang", "doc_id", "place")


@query("""
SELECT user_id, event_id, CAST(ply // 2 + 1 AS INTEGER) AS number, ply % 2 = 1 AS black FROM (
  SELECT user_id, event_id, 2 * (first_value(event_id % 40 + 1) OVER w - 1) + CAST(first_value(event_type = 'click') OVER w AS INTEGER) + row_number() OVER w - 1 AS ply FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
""")
def renumbered_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each user numbered anew from the first one's number and side."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 40 + 1).alias("number"), (F.col("event_type") == "click").alias("black"))
    return windows.renumbered(rows, "user_id", "event_id", "number", "black")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_type, value, event_id) AS place FROM events")
def review_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("date").alias("day"), "event_type", "value")
    return windows.review_rank(rows, ["user_id"], "day", "event_type", "value", "event_id").select("user_id", "event_id", "place")


@query("SELECT lang, source, n, round((n + 2.0 * (t + 1.0) / (a + 1.0 * k)) / (CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE) + 2.0), 9) AS p FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) JOIN (SELECT source, count(*) AS t FROM documents GROUP BY source) USING (source), (SELECT count(*) AS a, count(DISTINCT source) AS k FROM documents)")
def backed_off_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return aggregates.backed_off(counts, "lang", "source", "n").select("lang", "source", "n", F.round("p", 9).alias("p"))


@query("SELECT label, i - 1 AS pos, avg(CAST(embedding[i] AS DOUBLE)) > 0 AS mask FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i")
def mean_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return aggregates.mean_mask(e, ["label"], "embedding", 0.0).select("label", F.col("pos").cast("long").alias("pos"), "mask")


@query("SELECT event_type, median(value) AS value, median(user_id) AS user_id FROM events GROUP BY event_type")
def type_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.group_medians(table(spark, sf_dir, "events"), ["event_type"], ["value", "user_id"])


@query("SELECT part, key, value, auto FROM (SELECT CASE WHEN d = 3 THEN 'declined' ELSE 'moves' END AS part, '1:' || d || ',2:x' AS key, CASE WHEN d = 3 THEN NULL ELSE 'v' || d END AS value, CASE WHEN d = 3 THEN false ELSE d % 2 = 1 END AS auto FROM (SELECT DISTINCT doc_id % 10 AS d FROM documents))")
def declined_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An automatic entry is taken back and remembered."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("d")).distinct()
    fixes = d.select(F.lit("moves").alias("part"), F.concat(F.lit("1:"), "d", F.lit(",2:x")).alias("key"), F.concat(F.lit("v"), "d").alias("value"), (F.col("d") % 2 == 1).alias("auto"), F.col("d").alias("seq"))
    return corrections.declined(fixes, "1:3,2:x", "moves").select("part", "key", "value", "auto")


@query("""
WITH o AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS key, 'p' || (c_custkey % 500) || c_mktsegment AS path, c_acctbal AS v FROM customer WHERE c_custkey % 4 > 0),
n AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS key, 'p' || (c_custkey % 500) || c_mktsegment AS path, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 4 < 3)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN n.id IS NULL THEN CASE WHEN o.key IS NOT NULL THEN (SELECT min(id) FROM n WHERE n.key = o.key) ELSE (SELECT min(id) FROM n WHERE n.key IS NULL AND n.path = o.path) END END AS renamed
FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.v <> n.v
""")
def reading_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings compared by id: added, removed and changed rows, and removed ones found again by key or, without one, by path."""
    k = F.col("c_custkey")
    own = lambda id, v: table(spark, sf_dir, "customer").select(id.alias("id"), F.when(k % 3 > 0, F.col("c_name")).alias("key"), F.concat(F.lit("p"), k % 500, "c_mktsegment").alias("path"), v.alias("v"), k.alias("k"))
    old = own(k, F.col("c_acctbal")).where("k % 4 > 0").drop("k")
    new = own(F.when(k % 5 == 0, k + 1000000).otherwise(k), F.when(k % 7 == 0, 0.0).otherwise(F.col("c_acctbal"))).where("k % 4 < 3").drop("k")
    return corrections.patch(old, new, "id", "key", "path")


_FIXED = "SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'fixed' ELSE lang END AS lang, source, n_chars FROM documents"


@query(f"SELECT source, count(*) AS docs, CAST(count_if(lang = 'fixed') AS BIGINT) AS fixed FROM ({_FIXED}) GROUP BY source")
def recounted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after a correction: only touched groups are counted again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = d.withColumn("lang", F.when(F.col("doc_id") % 17 == 0, "fixed").otherwise(F.col("lang")))
    measures = {"docs": F.count("*"), "fixed": F.count_if(F.col("lang") == "fixed")}
    return corrections.recounted(d.groupBy("source").agg(*[c.alias(n) for n, c in measures.items()]), d, new, "source", measures)


@query(f"""
WITH b AS (SELECT source, lang AS status, count(*) AS n FROM documents GROUP BY ALL), a AS (SELECT source, lang AS status, count(*) AS n FROM ({_FIXED}) GROUP BY ALL),
hit AS (SELECT DISTINCT source FROM documents WHERE doc_id % 17 = 0)
SELECT coalesce(b.source, a.source) AS source, coalesce(b.status, a.status) AS status, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after FROM b FULL JOIN a ON a.source = b.source AND a.status = b.status WHERE coalesce(b.source, a.source) IN (SELECT source FROM hit)
""")
def correction_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What further corrections would change, by touched group and status."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("1:1,"), "doc_id", F.lit(":x")).alias("key"), "doc_id", "lang", "source")
    extra = d.where("doc_id % 17 = 0").select(F.lit("moves").alias("part"), "key", F.lit("fixed").alias("value"), F.lit(False).alias("auto"), F.col("doc_id").alias("seq"))
    return corrections.what_if(d, extra.limit(0), extra, "key", {"moves": "lang"}, "source", F.col("lang"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'MACHINERY'")
def owned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.owned(table(spark, sf_dir, "customer"), F.col("c_nationkey") == 7, F.col("c_mktsegment") == "MACHINERY").select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0")
def created_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made if there is none; a second call keeps what is there; keys are kept by what is inserted."""
    path, schema = _folder(spark, "store"), "s_suppkey long, s_name string"
    empty = records.created(spark, path, schema)
    rows = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey", "s_name")
    records.insert_ignore(empty, rows.unionByName(rows), ["s_suppkey"], [F.col("s_name")]).write.mode("append").parquet(path)
    return records.created(spark, path, schema)


@query("SELECT doc_id % 12 AS part, lang, count(*) AS n FROM documents GROUP BY ALL")
def parts_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished parts one by one, the wanted ones first: their union is what a fresh build gives."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 12).cast("long").alias("part"), "lang")
    order, out = streams.prioritised(list(range(12)), [7, 3]), None
    for _, part in streams.by_parts(d, "part", order, lambda x: x.groupBy("part", "lang").agg(F.count("*").alias("n"))):
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id AS page, CASE WHEN chars = 0 THEN 'empty' WHEN chars < 40 * labels THEN 'plate' ELSE 'text' END AS kind, lines, chars FROM (SELECT doc_id, count(*) AS lines, CAST(sum(length(trim(line))) AS BIGINT) AS chars, count_if(regexp_matches(trim(line), '^(?:[0-9]{1,3}(?:\\.[0-9]{1,3})?[a-d]?)$')) AS labels FROM " + _LINES + " GROUP BY doc_id)")
def inspected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages inspected in batches, a wanted one first; the union is the same in any order."""
    rows = _lines(spark, sf_dir).select(F.col("doc_id").alias("page"), F.col("pos").alias("line_no"), F.col("line").alias("text"))
    last, out = rows.agg(F.max("page")).first()[0], None
    for batch in pages.scanned(rows, last // 2, last // 4 + 1, last):
        out = batch if out is None else out.unionByName(batch)
    return out.select("page", "kind", "lines", "chars")


@query("SELECT doc_id, pos, regexp_matches(trim(line), '^([0-9]{1,3}\\.(\\.\\.)?|1-0|0-1|1/2-1/2|[!?+#=]{1,2}|([0-9]{1,3}\\.(\\.\\.)?)?([KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](=[QRBN])?|O-O(-O)?)[+#!?]*| )+$') AND regexp_matches(trim(line), '[a-h][1-8]|O-O') AS moves FROM " + _LINES)
def move_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whole texts that hold moves and nothing else."""
    return _lines(spark, sf_dir).select("doc_id", "pos", layout.moves_only(F.col("line")).alias("moves"))


_NODES = """(SELECT event_id AS id, user_id AS line, event_id - 1 AS parent, event_id % 50 AS page, event_id AS ply, event_type <> 'view' AS main,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'waiting' ELSE 'ok' END AS status, 'e' || (event_id % 8 + 1) AS san, 'Se' || (event_id % 9 + 1) || CASE WHEN event_id % 3 = 0 THEN '+' ELSE '' END AS raw FROM events)"""


def _scanned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Findings over users as lines and events as moves."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "waiting").otherwise("ok")
    nodes = e.select(
        k.alias("id"), F.col("user_id").alias("line"), (k - 1).alias("parent"), (k % 50).alias("page"), k.alias("ply"), (F.col("event_type") != "view").alias("main"), status.alias("status"),
        F.concat(F.lit("e"), (k % 8 + 1).cast("string")).alias("san"), F.concat(F.lit("Se"), (k % 9 + 1).cast("string"), F.when(k % 3 == 0, "+").otherwise("")).alias("raw"),
    )
    lines = e.select(F.col("user_id").alias("id")).distinct().select("id", (F.col("id") % 6).alias("chapter"), F.when(F.col("id") % 2 == 0, "game").otherwise("fragment").alias("kind"), F.col("id").cast("string").alias("title"))
    pictures = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("page"), F.when(F.col("page_id") % 4 == 0, "doubtful").otherwise("read").alias("status"))
    return quality.scan(nodes, lines, pictures)


@query(f"SELECT line, min(id) AS id, arg_min(page, id) AS page, min(ply) AS ply, arg_min(status, id) AS status FROM {_NODES} WHERE main AND status <> 'ok' GROUP BY line")
def scan_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir)["breaks"]


@query(f"SELECT id, page, san, raw FROM {_NODES} WHERE main AND status = 'ok' AND right(san, 2) <> right(rtrim(raw, '+'), 2)")
def scan_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves taken as read whose printed square is another one."""
    return _scanned(spark, sf_dir)["silent"]


@query("SELECT CASE WHEN page_id % 4 = 0 THEN 'doubtful' ELSE 'read' END AS status, count(*) AS n FROM pages GROUP BY ALL")
def scan_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir)["diagrams"]


@query(f"SELECT status, count(*) AS n FROM {_NODES} WHERE status IN ('waiting', 'failed') GROUP BY status")
def scan_unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir)["unplaced"]


@query(f"SELECT page, count(*) AS n FROM {_NODES} WHERE status <> 'ok' GROUP BY page ORDER BY n DESC, page LIMIT 40")
def scan_hot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with the most doubtful moves: a top-k report."""
    return _scanned(spark, sf_dir)["hot_pages"]


@query(f"SELECT l.line % 6 AS chapter, count(*) AS lines, CAST(sum(coalesce(m.moves, 0)) AS BIGINT) AS moves FROM (SELECT DISTINCT line FROM {_NODES}) l LEFT JOIN (SELECT line, count(*) AS moves FROM {_NODES} WHERE main GROUP BY line) m USING (line) GROUP BY 1")
def scan_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir)["chapters"]


# ---- golden cases


def _cases(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_CUES = [("with 12.Qh5 threatening", "threat"), ("Better was", "alternative"), ("Black intended this, and then", "follow"), ("as so often, e.g.", "bare"), ("in moves 12-15", "range"), ("a calm move", None), ("instead", "alternative")]


@case(values("before, cue", _CUES))
def cue_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, "before string", [(x,) for x, _ in _CUES]).select("before", layout.cue(F.col("before")).alias("cue"))


_FENS = [
    (board.START, True, "KQkq", 0),
    ("8/8/8/8/8/8/8/K6k w - - 0 1", True, "-", 62),
    ("8/8/8/8/8/8/8/8 w - - 0 1", False, "-", 64),
    ("P6k/8/8/8/8/8/8/K7 w - - 0 1", False, "-", 61),
    ("kk6/8/8/8/8/8/8/K7 w - - 0 1", False, "-", 61),
    ("r3k2r/8/8/8/8/8/8/R3K3 w - - 0 1", True, "Qkq", 59),
    ("4k3/8/8/8/8/8/4P3/4K2R w - - 0 1", True, "K", 60),
]


@case(values("fen, legal, castling, empty", [(f, a, b, c if k else 32) for k, (f, a, b, c) in enumerate(_FENS)]))
def positions_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal shape, castling rights from first squares, and empty squares."""
    f = F.col("fen")
    return _cases(spark, "fen string", [(x[0],) for x in _FENS]).select("fen", scalars.legal_shape(f).alias("legal"), scalars.castling(f).alias("castling"), F.size(F.filter(scalars.squares(f), lambda c: c == ".")).alias("empty"))


@case(values("name, diff", [("one move", "e2 P>.|e4 .>P"), ("same", ""), ("corner", "h1 R>r")]))
def square_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares where two positions differ."""
    rows = [("one move", board.START, "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1"), ("same", board.START, board.START), ("corner", board.START, "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNr w - - 0 1")]
    d = _cases(spark, "name string, a string, b string", rows)
    return d.select("name", F.array_join(F.array_sort(F.transform(scalars.square_diff(F.col("a"), F.col("b")), lambda x: F.concat(x["square"], F.lit(" "), x["first"], F.lit(">"), x["second"]))), "|").alias("diff"))


@case(values("raw, numbers, result, nag", [("12", "12", None, None), ("l2", "12", None, None), ("S", "8,5", None, None), ("012", "", None, None), ("1234", "", None, None), ("½-½", "", "1/2-1/2", None), (" 1-0 ", "", "1-0", None), ("!?", "", None, 5), ("??", "", None, 4)]))
def printed_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of badly printed numbers, results and annotation signs."""
    raw = F.col("raw")
    d = _cases(spark, "raw string", [(x,) for x in ("12", "l2", "S", "012", "1234", "½-½", " 1-0 ", "!?", "??")])
    return d.select("raw", F.array_join(scalars.number_values(raw).cast("array<string>"), ",").alias("numbers"), scalars.result(raw).alias("result"), scalars.nag(raw).alias("nag"))


@case(values("raw, want, slip", [("11.", 17, True), ("17", 17, False), ("12", 17, False), ("3", 8, True), ("36", 85, False), ("108", 188, True), ("1", 17, False)]))
def digit_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cases(spark, "raw string, want int", [("11.", 17), ("17", 17), ("12", 17), ("3", 8), ("36", 85), ("108", 188), ("1", 17)])
    return d.select("raw", "want", scalars.digit_slip(F.col("raw"), F.col("want")).alias("slip"))


@case(values("raw, squares", [("Nf3", "1:f3"), ("£l", "0:f1"), ("BxCs", "2:c5/c8"), ("e4d5", "0:e4;2:d5"), ("O-O", ""), ("x", "")]))
def squares_in_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every square that a printed token may show."""
    d = _cases(spark, "raw string", [(x,) for x in ("Nf3", "£l", "BxCs", "e4d5", "O-O", "x")])
    return d.select("raw", F.array_join(F.transform(scalars.printed_squares(F.col("raw")), lambda x: F.concat(x["at"].cast("string"), F.lit(":"), F.array_join(x["squares"], "/"))), ";").alias("squares"))


@case(values("text, kind, number, title", [("Chapter 3: The Open File", "chapter", 3, "The Open File"), ("PART iv", "part", 4, ""), ("Section 12 - Ends", "section", 12, "Ends"), ("A chapter of accidents", None, None, None)]))
def chapter_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cases(spark, "text string", [(x,) for x in ("Chapter 3: The Open File", "PART iv", "Section 12 - Ends", "A chapter of accidents")])
    return d.select("text", scalars.chapter_heading(F.col("text")).alias("h")).select("text", "h.kind", "h.number", "h.title")


@case(values("text, side", [("White to move and win", "w"), ("Black plays and draws", "b"), ("a quiet position", None), ("W", "w")]))
def sides_to_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, "text string", [(x,) for x in ("White to move and win", "Black plays and draws", "a quiet position", "W")]).select("text", layout.side_to_move(F.col("text")).alias("side"))


@case(values("picture, label", [(1, 11), (2, 12)]))
def picture_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pictures and three labels: one label lies between both pictures and goes to the nearer, the other picture takes one below it; a label far to the side has none."""
    pictures = _cases(spark, "page int, id int, x0 double, y0 double, x1 double, y1 double", [(1, 1, 100.0, 100.0, 200.0, 200.0), (1, 2, 100.0, 300.0, 200.0, 400.0)])
    labels = _cases(spark, "page int, id int, x0 double, y0 double, x1 double, y1 double", [(1, 11, 140.0, 60.0, 160.0, 70.0), (1, 12, 140.0, 405.0, 160.0, 415.0), (1, 13, 400.0, 80.0, 420.0, 90.0)])
    return layout.labelled(pictures, labels).select("picture", "label")


@case(values('"group", name', [("a", "N"), ("b", "N"), ("c", "Q")]))
def smoothed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups alike share their votes, a third is far from them."""
    rows = [(1, "a", [0.0, 0.0], {"N": 5}), (1, "b", [0.1, 0.0], {"B": 1}), (1, "c", [9.0, 9.0], {"Q": 2, "N": 1})]
    return inference.smoothed_votes(_cases(spark, "book int, `group` string, centre array<double>, votes map<string,int>", rows), "book", 1.0).select("group", "name")


@case(values('"group", name', [("g1", "K"), ("g2", "Q"), ("g3", "k")]))
def names_under_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs alone name two groups of a board kings; a board with two kings of a side is dearer than the second's other name."""
    costs = {"g1": {"K": 0.0, "Q": 5.0}, "g2": {"K": 0.5, "Q": 1.0}, "g3": {"k": 0.0, "q": 3.0}}
    return inference.constrained_names(_cases(spark, "book int, board int, `group` string, costs map<string,double>", [(1, 1, g, c) for g, c in costs.items()]), "book").select("group", "name")


@case(values("id, cluster", [(1, 0), (2, 0), (3, 1), (4, 1), (5, 0)]))
def leader_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders in order: the second vector is within the distance of the first, the third of none before it."""
    rows = [(1, 1, [0.0, 0.0]), (1, 2, [1.0, 0.0]), (1, 3, [10.0, 0.0]), (1, 4, [10.5, 0.0]), (1, 5, [0.0, 1.0])]
    out = clusters.leaders(_cases(spark, "g int, id int, v array<float>", rows), "g", "id", "v", 2.0)
    first = out.groupBy("cluster").agg(F.min("id").alias("low"))
    return out.join(first, "cluster").select("id", F.when(F.col("low") == 1, 0).otherwise(1).alias("cluster"))


@case(values('start, "end"', [(1, 3), (5, 6)]))
def settled_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic corrections that no longer hold go, and those that held by them after them; a reader's stay. Entries: key holds while the key it stands on (value) is there."""
    rows = [("1:1,1:a", None, False, 1), ("1:1,2:b", "1:1,1:a", True, 2), ("1:1,3:c", "1:1,2:b", True, 3), ("1:1,4:d", "1:9,9:z", True, 4), ("1:1,5:e", None, False, 5), ("1:1,6:f", "1:1,5:e", True, 6)]
    fixes = _cases(spark, "key string, value string, auto boolean, seq long", rows)
    holds = lambda auto: auto.join(fixes.where("seq <> 4").select(F.col("key").alias("value")), "value", "left_semi").select(*fixes.columns)
    kept = corrections.settled(fixes, holds).select(F.lit(0).alias("g"), F.col("seq").alias("start"), F.col("seq").alias("end"))
    return windows.merged_ranges(kept, ["g"], "start", "end").select("start", "end")


@case(values('"values", resolved', [("5/8,7", "5,7"), ("204,205/208,206", "204,205,206"), ("1,2/3,2/9", "1,2,9")]))
def resolved_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number with two readings takes the one that follows the number before most closely."""
    rows = [("5/8,7", [[5, 8], [7]]), ("204,205/208,206", [[204], [205, 208], [206]]), ("1,2/3,2/9", [[1], [2, 3], [2, 9]])]
    d = _cases(spark, "`values` string, options array<array<int>>", rows)
    return d.select("values", F.array_join(windows.resolve_ambiguous(F.col("options")).cast("array<string>"), ",").alias("resolved"))


@case(values("line_no, place", [(1, 0), (2, 1), (3, 3), (4, 2), (5, 4), (6, 5)]))
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full line, then two columns read left before right, then a full line."""
    rows = [(1, 1, 0.0, 0.0, 100.0, 10.0), (1, 2, 0.0, 12.0, 45.0, 22.0), (1, 3, 55.0, 12.0, 100.0, 22.0), (1, 4, 0.0, 24.0, 45.0, 34.0), (1, 5, 55.0, 24.0, 100.0, 34.0), (1, 6, 0.0, 36.0, 100.0, 46.0)]
    return layout.reading_order(_cases(spark, "page int, line_no int, x0 double, y0 double, x1 double, y1 double", rows), _cases(spark, "page int, x double", [(1, 50.0)]), 10.0).select("line_no", "place")


@case(values("id, band", [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)]))
def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of rows by the distance from their first."""
    return chains.row_groups(_cases(spark, "page int, id int, y double", [(1, 1, 0.0), (1, 2, 3.0), (1, 3, 5.0), (1, 4, 8.5), (1, 5, 9.5)]), "page", "y", 4.0).select("id", "band")


_ROLES = [(1, "head"), (2, "heading"), (3, "text"), (4, "moves"), (5, "coord"), (6, "game_header"), (7, "blank"), (8, "text")]


@case(values("line_no, role", _ROLES))
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of lines by role."""
    texts = ["Running title", "Openings", "White has a good game here", "1.e4 e5 2.Nf3 Nc6", "a b c d", "Smith - Jones, London", " ", "and Black is well"]
    rows = [(1, k + 1, 10.0 * k, 10.0 * k + 8, t, "F", 14.0 if k == 1 else 10.0) for k, t in enumerate(texts)]
    roles = layout.font_roles(layout.font_profiles(_cases(spark, "page int, line_no int, text string, font string, size double", [(1, 1, "x" * 500, "F", 10.0), (2, 1, "Openings", "F", 14.0)])))
    return layout.line_roles(_cases(spark, "page int, line_no int, y0 double, y1 double, text string, font string, size double", rows), roles, 8.0, 500.0).select("line_no", "role")


@case(values("line_no, original, main_text, note_text", [(1, "1.e4 wins a pawn", "1.e4            ", "¶    wins a pawn"), (2, "e5 2.Nf3", "e5 2.Nf3", "¶       ")]))
def aligned_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three texts of one length: words, those in the font of moves, and notes with a break in their place."""
    words = _cases(spark, "line_no int, word_no int, text string, font string", [(1, 0, "1.e4", "M"), (1, 1, "wins", "B"), (1, 2, "a", "B"), (1, 3, "pawn", "B"), (2, 0, "e5", "M"), (2, 1, "2.Nf3", "M")])
    roles = _cases(spark, "font string, role string", [("M", "moves"), ("B", "body")])
    return layout.buffers(layout.word_classes(words, roles), ["line_no"])


@case(values('"at", label, diagram', [(100, "1", "11"), (110, "2", "12"), (120, "9", "15"), (130, "1", "21"), (140, "2", "12"), (150, "7", None)]))
def solution_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions by label after the last one taken; by a label that is the book's only one; by place among a section's unlabelled diagrams where numbers start again."""
    shown = [(1, 1, 10, "1", True, 1), (1, 2, 11, "1", False, 1), (1, 3, 12, "2", False, 1), (1, 4, 15, "9", False, 1), (1, 50, 21, None, False, 2), (1, 51, 22, None, False, 2)]
    items = [(1, 100, "1"), (1, 110, "2"), (1, 120, "9"), (1, 130, "1"), (1, 140, "2"), (1, 150, "7")]
    return layout.solutions(_cases(spark, "book int, at int, label string", items), _cases(spark, "book int, at int, id int, label string, main boolean, section int", shown), "book").select("at", "label", "diagram")


_TOKENS = [
    ("1.e4 e5", "number 1.|move e4|move e5"),
    ("l.e4 e5 2.Nf3!", "number l.|move e4|move e5|number 2.|move Nf3!"),
    ("12...Qxd5+ 1-0", "number 12...|move Qxd5+|result 1-0"),
    ("(3.Bb5) and", "other (|number 3.|move Bb5|other )|other and"),
    ("no moves here", "other no|other moves|other here"),
]


@case(values("text, tokens", _TOKENS))
def token_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cases(spark, "text string", [(x,) for x, _ in _TOKENS])
    return reading.tokens(d.withColumn("name", F.col("text")), "name", "text").withColumnRenamed("name", "text").groupBy("text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", "raw"))), lambda t: F.concat(t["kind"], F.lit(" "), t["raw"])), "|").alias("tokens"))


_RUNS = [
    ("1.e4 e5 2.Nf3 Nc6 (2...d6 3.d4) 3.Bb5 a6 1-0", "1w0:e4 e5 Nf3 Nc6|2b1:d6 d4|3w0:Bb5 a6"),
    ("16.e4 e5 11.Nf3 Nc6 18.Bb5", "16w0:e4 e5 Nf3 Nc6 Bb5"),
    ("5.d4 and later 9.h3 a5", "5w0:d4|9w0:h3 a5"),
]


@case(values("text, runs", _RUNS))
def run_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs under consecutive numbers, in brackets, over a misread number (11 for 17), and apart."""
    found = reading.runs(_cases(spark, "name string, text string", [(x, x) for x, _ in _RUNS]), "name", "text").withColumnRenamed("name", "text")
    shown = F.concat(F.col("first_number").cast("string"), F.when(F.col("black_first"), "b").otherwise("w"), F.col("depth").cast("string"), F.lit(":"), F.array_join("moves", " "))
    return found.select("text", "run", shown.alias("shown")).groupBy("text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "shown"))), lambda x: x["shown"]), "|").alias("runs"))


@case(values("name, dotless, dotted, reads_dotless", [("plain", 3, 0, True), ("dotted", 0, 2, False), ("prose", 0, 0, False)]))
def numbering_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("plain", "1 e4 c5 2 Nf3 d6 and 3 d4 cxd4 4 Nxd4 or 5 Nc3 a6\n6 Be2"), ("dotted", "1.e4 c5 2.Nf3 d6, then 3.d4 cxd4 4.Nxd4"), ("prose", "in 3 days 4 men came")]
    return reading.numbering(_cases(spark, "name string, text string", rows), ["name"], "text")


_DECODE = [
    ("clean", "e4 e5 Nf3 Nc6 Bb5", "e4 e5 Nf3 Nc6 Bb5", "ok ok ok ok ok"),
    ("pound", "e4 e5 N£3", "e4 e5 Nf3", "ok ok ok"),
    ("figurine", "e4 e5 ♘f3", "e4 e5 Nf3", "ok ok ok"),
    ("long", "e2-e4 e7-e5 Ng1-f3", "e4 e5 Nf3", "ok ok ok"),
    ("zeros", "e4 e5 Nf3 Nc6 Bb5 a6 0-0", "e4 e5 Nf3 Nc6 Bb5 a6 O-O", "ok ok ok ok ok ok ok"),
    ("impossible", "e4 e5 zz", "e4 e5 -", "ok ok failed"),
]


@case(values("name, san, status", [(n, s, t) for n, _, s, t in _DECODE]))
def decode_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cases(spark, "name string, start string, moves array<string>", [(n, board.START, m.split()) for n, m, _, _ in _DECODE])
    out = reading.decode(d, "start", "moves")
    return out.select("name", F.array_join(F.transform("decoded", lambda x: F.coalesce(x["san"], F.lit("-"))), " ").alias("san"), F.array_join(F.transform("decoded", lambda x: x["status"]), " ").alias("status"))


@case(values("fen, depth, nodes", [(board.START, 1, 20), (board.START, 2, 400), (board.START, 3, 8902), ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", 2, 2039), ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", 3, 2812), ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", 2, 1486)]))
def legal_move_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known numbers of positions after so many plies."""
    rows = [(board.START, 1), (board.START, 2), (board.START, 3), ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", 2), ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", 3), ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", 2)]
    return reading.position_counts(_cases(spark, "fen string, depth int", rows), "fen", "depth")


_TREES = [
    ("main", "1.e4 e5 2.Nf3 Nc6 1-0", "0 e4,1 e5,2 Nf3,3 Nc6", "", 0),
    ("variation", "1.e4 e5 (1...c5 2.Nf3) 2.Nf3 Nc6 *", "0 e4,1 e5,2 Nf3,3 Nc6", "1 c5,2 Nf3", 0),
    ("gap", "1.e4 e5 3.Bb5 a6 *", "0 e4,1 e5,2 -", "", 1),
    ("threat", "1.e4 e5 2.Nf3 Nc6 3.Bc4 threatening 4.Ng5 and more. 3...Bc5 4.c3 Nf6 *", "0 e4,1 e5,2 Nf3,3 Nc6,4 Bc4,5 Bc5,6 c3,7 Nf6", "5 --,6 Ng5", 0),
    ("bare", "1.e4 e5 2.Nf3 Nc6 (or d6) 3.Bb5 a6 *", "0 e4,1 e5,2 Nf3,3 Nc6,4 Bb5,5 a6", "3 d6", 0),
    ("resumed", "1.e4 e5 2.Nf3 Nc6 3.Bb5\n\nAnother game\n\n1.d4 d5 2.c4 e6\n\nBack again\n\n3...a6 4.Ba4 Nf6 *", "0 e4,1 e5,2 Nf3,3 Nc6,4 Bb5,5 a6,6 Ba4,7 Nf6;0 d4,1 d5,2 c4,3 e6", "", 0),
    ("waits", "9.Qd2 Be6 *", "", "", 1),
]


@case(values("name, main, variations, waiting", [(n, m, v, w) for n, _, m, v, w in _TREES]))
def assembly_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts assembled into lines: main moves, gaps, variations in brackets, threats after a passed move, moves without numbers, a game that goes on after another, and what waits."""
    out = reading.assembled(_cases(spark, "name string, text string", [(n, t) for n, t, *_ in _TREES]), "name", "text")
    nodes = F.from_json("nodes", reading.NODE)
    shown = lambda main: F.array_join(F.transform(F.filter(nodes, lambda n: n["main"] == main), lambda n: F.concat(n["ply"].cast("string"), F.lit(" "), F.coalesce(n["san"], F.lit("-")))), ",")
    lines = out.select("name", "line", shown(True).alias("m"), shown(False).alias("v"), F.size(F.from_json("waiting", "array<array<string>>")).alias("w"))
    row = F.array_sort(F.collect_list(F.struct("line", "m", "v")))
    texts = lambda n: F.array_join(F.filter(F.transform(row, lambda x: x[n]), lambda x: x != ""), ";")
    return lines.groupBy("name").agg(texts("m").alias("main"), texts("v").alias("variations"), F.sum("w").alias("waiting"))


@case(values("chapter, line, joins, moves", [(1, 0, None, "0 e4 ok,1 e5 ok,2 Nf3 ok,3 Nc6 ok"), (2, 0, 0, "4 Bb5 ok,5 a6 ok"), (3, 0, None, "0 d4 ok,1 d5 ok")]))
def chapters_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line that goes on at the top of the next chapter."""
    rows = [(1, 1, "1.e4 e5 2.Nf3 Nc6"), (1, 2, "3.Bb5 a6 *"), (1, 3, "1.d4 d5 *")]
    return reading.assembled_chapters(_cases(spark, "book int, chapter int, text string", rows), "book", "chapter", "text").select("chapter", "line", "joins", F.array_join("moves", ",").alias("moves"))


@case(values("name, filled", [("decided", "e4"), ("open", None)]))
def filled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing move that only one choice makes the printed ones after it read by, and one that many do."""
    italian = "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2"
    rows = [("decided", "4k3/8/8/8/8/8/4P3/4K3 w - - 0 1", ["Kd7", "e5", "Ke6", "Kd2"], 1), ("open", italian, ["Nc6"], 1)]
    return reading.filled(_cases(spark, "name string, fen string, after array<string>, missing int", rows), "fen", "after", "missing").select("name", F.array_join("filled", " ").alias("filled"))


@case(values("plies, path", [(1, None), (2, "e4 e5"), (3, "e4")]))
def paths_to_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR", board.START), (2, "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR", board.START), (3, "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR", board.START)]
    d = _cases(spark, "plies int, placement string, start string", rows)
    return reading.paths(d.withColumn("goal", F.concat("placement", F.lit(" w - - 0 1"))), "start", "goal", "plies").select("plies", F.array_join("path", " ").alias("path"))


@case(values("name, read, changed", [("as named", "Nf3 Nc6", False), ("other side", "Nc6 Bb5", True)]))
def regions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's moves read with the side that the position names, or with the other where that reads better."""
    fen = "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2"
    rows = [("as named", fen, ["Nf3", "Nc6"]), ("other side", fen, ["Nc6", "Bb5"])]
    return reading.regions(_cases(spark, "name string, fen string, moves array<string>", rows), "fen", "moves").select("name", F.array_join("read", " ").alias("read"), "changed")


@case(
    values(
        "name, steps, gained, stop",
        [
            ("joins", "joined a | e4 e5;joined b | Nf3 Nc6", 4, "the text is read to its end"),
            ("cut", "joined a | e4 e5 Nf3 Nc6", 4, "a printed move is in doubt"),
            ("variation", "joined a | e4 e5", 2, "the next moves are a variation"),
            ("too far", "", 0, "too many moves are missing"),
            ("declined", "", 0, "the reader took this step back"),
            ("unsure", "", 0, "the next moves do not read surely"),
        ],
    )
)
def read_on_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read on by themselves as far as it is sure."""
    runs = "array<struct<ply:int,key:string,moves:array<string>>>"
    cases = {
        "joins": [(0, "a", ["e4", "e5"]), (2, "b", ["Nf3", "Nc6"])],
        "cut": [(0, "a", ["e4", "e5", "Nf3", "Nc6", "Kh8"])],
        "variation": [(0, "a", ["e4", "e5"]), (1, "b", ["c5"])],
        "too far": [(3, "a", ["Nc6"])],
        "declined": [(0, "k", ["e4", "e5"])],
        "unsure": [(0, "a", ["Qh5", "e5"])],
    }
    d = _cases(spark, f"name string, fen string, ply int, found {runs}, declined array<string>", [(n, board.START, 0, r, ["k"]) for n, r in cases.items()])
    return reading.read_on(d, "fen", "ply", "found", "declined").select("name", F.array_join("steps", ";").alias("steps"), "gained", "stop")


@case(values("run, chosen, read, failed", [(1, 1, 3, 0), (2, 0, 2, 0)]))
def chosen_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that fails from the initial position reads from the second candidate; one that reads stays with the default."""
    open_game = "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2"
    rows = [(1, 0, board.START, ["Bb5", "a6", "Ba4"]), (1, 1, open_game, ["Bb5", "a6", "Ba4"]), (2, 0, board.START, ["Nf3", "d5"]), (2, 1, open_game, ["Nf3", "d5"])]
    out = reading.choose_start(_cases(spark, "run int, place int, start string, moves array<string>", rows), "run", "place", "start", "moves")
    return out.select("run", F.col("place").alias("chosen"), "read", "failed")


@case(values("line, from_line, \"at\", gap", [(1, 3, 60, 0), (2, 4, 90, 2)]))
def next_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a branch's end: the next printed run of another line, no more than four plies and two pages on."""
    ends = _cases(spark, "book int, line int, offset int, page int, ply int", [(1, 1, 50, 3, 10), (1, 2, 70, 4, 20)])
    printed = _cases(spark, "book int, line int, offset int, page int, ply int, moves array<string>", [(1, 1, 55, 3, 10, ["a"]), (1, 3, 60, 4, 10, ["b"]), (1, 3, 65, 3, 11, ["c"]), (1, 4, 90, 5, 22, ["d"]), (1, 4, 80, 9, 20, ["e"])])
    return reading.suggestions(ends, printed).select("line", "from_line", "at", "gap")


@case(values("place, depth, shown", [(0, 0, "1. e4 ok"), (1, 0, "1... e5 ok"), (2, 1, "1... c5 ok"), (3, 1, "2. Nf3 ok"), (4, 0, "2. Nc3 ok")]))
def line_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's moves with a variation after the move it replaces."""
    return reading.listings(_cases(spark, "id int, text string", [(1, "1.e4 e5 (1...c5 2.Nf3) 2.Nc3 *")]), "id", "text").select("place", "depth", "shown")


@case(values("event, white, moves", [("A", "x", "1.e4 e5 1-0"), ("B", "y", "1.d4 *")]))
def game_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of a file: tags and moves."""
    path = _folder(spark, "games")
    text = '[Event "A"]\n[White "x"]\n\n1.e4 e5 1-0\n\n[Event "B"]\n[White "y"]\n\n1.d4 *\n'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return tables.games(spark, path).select(F.col("tags")["Event"].alias("event"), F.col("tags")["White"].alias("white"), F.trim(F.regexp_replace("moves", r"\s+", " ")).alias("moves"))


@case(values("title, chapter, line, san", [("T", "One", "l1", "e4"), ("T", "One", "l1", "e5")]))
def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored book read with a fixed schema."""
    path = _folder(spark, "books")
    book = {"title": "T", "chapters": [{"title": "One", "start": 1, "end": 4}], "lines": [{"id": "l1", "chapter": "One", "page": 1}], "nodes": [{"id": "n1", "line": "l1", "san": "e4"}, {"id": "n2", "line": "l1", "parent": "n1", "san": "e5"}], "more": 1}
    spark.createDataFrame([(json.dumps(book),)], "value string").coalesce(1).write.text(path)
    b = tables.books(spark, path)
    return b.select("title", F.explode("nodes").alias("n"), F.col("lines")[0]["chapter"].alias("chapter")).select("title", "chapter", F.col("n.line").alias("line"), F.col("n.san").alias("san"))


@case(values("chapter, event, result", [("c1", "?", "1-0"), ("c2", "?", "*")]))
def games_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled games written as files by chapter and read back; a line that only waits is left out."""
    path = _folder(spark, "pgn")
    lines = reading.assembled(_cases(spark, "chapter string, text string", [("c1", "1.e4 e5 1-0"), ("c2", "1.d4 d5 *"), ("c3", "9.Qd2 *")]), "chapter", "text")
    reading.write_games(lines, path, "chapter")
    back = tables.games(spark, f"{path}/*")
    return back.select(F.regexp_extract("file", "chapter=(c[0-9])", 1).alias("chapter"), F.col("tags")["Event"].alias("event"), F.col("tags")["Result"].alias("result"))


@case(values("page, kind, labels, refs", [(1, "plate", "12,13", ""), (2, "text", "", "12,3.4"), (3, "empty", "", "")]))
def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages hold: labels that stand alone and references of the text."""
    path = _folder(spark, "lines")
    rows = [(1, 1, "12"), (1, 2, "13"), (2, 1, "as in Diagram 12 and in exercise 3.4 we saw that the king"), (3, 1, "")]
    _cases(spark, "page int, line_no int, text string", rows).write.parquet(path)
    out = pages.inspected(pages.lines(spark, path))
    return out.select("page", "kind", F.array_join("labels", ",").alias("labels"), F.array_join("refs", ",").alias("refs"))
