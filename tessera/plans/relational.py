"""Queries of the relational operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates, inference, joins, layout, quality, records, windows
from ..sources.tables import table
from .registry import query


def _day(ts: Column) -> Column:
    """Cells of ordered operators: a hot group is spread over its days."""
    return F.to_date(ts)


@query("""
SELECT lang, count(*) AS docs, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(n) AS BIGINT) AS numbers FROM (
  SELECT lang, len(v) AS n, len(list_filter(range(1, len(v) + 1), lambda i: i = 1 OR NOT (v[i] = v[i - 1] OR v[i] = v[i - 1] + 1))) AS runs
  FROM (SELECT lang, list_transform(regexp_extract_all(text, '[0-9]{1,9}'), lambda x: CAST(x AS BIGINT)) AS v FROM documents)) GROUP BY lang
""")
def clean_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each document cut into runs that repeat or follow, counted by language: one shuffle, of a row a language."""
    v = F.transform(F.regexp_extract_all("text", F.lit("([0-9]{1,9})"), 1), lambda x: x.cast("long"))
    docs = table(spark, sf_dir, "documents").select("lang", v.alias("v"))
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size(windows.run_starts(F.col("v")))).alias("runs"), F.sum(F.size("v")).alias("numbers"))


@query("""
SELECT user_id, island, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
  SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM (
    SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS b FROM events))
GROUP BY user_id, island
""")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: a gap of over an hour starts the next."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    found = windows.gap_sessions(e, ["user_id"], "ts", ["event_id"], 3600, _day)
    return found.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins by key, as a partial aggregate and not a window: no group meets in one sort."""
    e = table(spark, sf_dir, "events")
    best = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return e.groupBy("user_id", "event_type").agg(best.alias("b")).select("user_id", "event_type", "b.event_id", "b.value")


@query("""
WITH stored AS (SELECT user_id, event_type, ts, event_id, value, 0 AS fresh FROM events WHERE event_id % 2 = 0), arriving AS (SELECT user_id, event_type, ts, event_id, value, 1 AS fresh FROM events WHERE event_id % 2 = 1)
SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, fresh DESC, event_id DESC) AS rn FROM (SELECT * FROM stored UNION ALL SELECT * FROM arriving)) WHERE rn = 1
""")
def upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return records.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "ts", "event_id")


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, c_name || ' again' FROM customer WHERE c_custkey % 3 = 0
""")
def insert_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or ignore: only keys that are not stored are added."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return records.insert_ignore(c.where("c_custkey % 3 <> 0"), c.withColumn("c_name", F.concat("c_name", F.lit(" again"))), ["c_custkey"], [F.col("c_name")])


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN greatest(s_acctbal, 5000) ELSE s_acctbal END AS s_acctbal FROM supplier")
def updated_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dynamic update that keeps the larger value."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = s.where("s_suppkey % 4 = 0").select("s_suppkey", F.lit(5000.0).alias("n_s_acctbal"))
    return records.update(s, changes, ["s_suppkey"], ["s_acctbal"], largest=("s_acctbal",))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def batch_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return records.delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), gone, ["o_orderkey"])


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42 AND c_nationkey IS NOT NULL")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey = 42 and c_nationkey is not null").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, max(coalesce(o_orderdate, DATE '1970-01-01')) AS opened FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey ORDER BY opened DESC, c_custkey")
def list_by_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing filtered by kind, newest first with a fallback time."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    joined = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.max(F.coalesce("o_orderdate", F.lit("1970-01-01").cast("timestamp_ntz"))).alias("opened")).orderBy(F.col("opened").desc(), "c_custkey")


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9A-Za-zÀ-ÿ]+')) AS tokens, len(regexp_extract_all(text, '[a-h][1-8]')) AS squares FROM documents")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit("[0-9A-Za-zÀ-ÿ]+")).cast("long").alias("tokens"), F.regexp_count("text", F.lit("[a-h][1-8]")).cast("long").alias("squares"))


@query("SELECT lang, source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def lang_source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("SELECT lang, count(*) AS docs, max(n_chars) AS longest FROM documents GROUP BY GROUPING SETS ((lang), ())")
def lang_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupingSets([[F.col("lang")], []], "lang").agg(F.count("*").alias("docs"), F.max("n_chars").alias("longest"))


@query("SELECT lang, v[CAST(floor(0.9 * (len(v) - 1)) AS BIGINT) + 1] AS p90 FROM (SELECT lang, list_sort(list(n_chars)) AS v FROM documents GROUP BY lang)")
def lang_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index-based percentile, from counts of values."""
    return aggregates.index_percentile(table(spark, sf_dir, "documents"), ["lang"], "n_chars", 0.9, "p90")


@query("SELECT source, min(n_chars) AS least, median(n_chars) AS middle, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source")
def source_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("n_chars").alias("least"), F.median("n_chars").alias("middle"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("""
SELECT event_id, user_id, ts, prev_ts, prev_value FROM (
  SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER w AS prev_ts, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS prev_value
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE event_type = 'click'
""")
def last_purchase_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join backward: the last purchase before each click."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return joins.asof(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'"), ["user_id"], "ts", ["value"], ["event_id"], cell=_day)


@query("""
SELECT c.event_id, c.user_id, c.ts, min(p.ts) AS next_ts, arg_min(p.value, (p.ts, -p.event_id)) AS next_value
FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts > c.ts WHERE c.event_type = 'click' GROUP BY ALL
""")
def next_purchase_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join forward."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return joins.asof(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'"), ["user_id"], "ts", ["value"], ["event_id"], forward=True, prefix="next_", cell=_day)


@query("""
SELECT a.event_id, b.event_id AS near_id, round(abs(a.value - b.value), 6) AS distance FROM events a JOIN events b
ON a.user_id = b.user_id AND b.event_type = 'signup' AND abs(a.value - b.value) <= 2.5 WHERE a.event_type = 'error'
QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.value - b.value), b.event_id) = 1
""")
def near_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on keys that agree within a tolerance, best first."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    left, right = e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'signup'").drop("event_type")
    gap = F.abs(F.col("value") - F.col("r_value"))
    out = joins.tolerance(left, right, ["user_id"], ["value"], 2.5, [gap, F.col("r_event_id")], ["event_id"])
    return out.select("event_id", F.col("r_event_id").alias("near_id"), F.round(gap, 6).alias("distance"))


@query("""
SELECT p_partkey, p_retailprice, band FROM part JOIN (VALUES (0, 900.0, 999.99), (1, 1000.0, 1299.99), (2, 1250.0, 1600.0), (3, 1500.0, 2200.0)) AS b(band, low, high) ON p_retailprice BETWEEN low AND high
""")
def range_price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval join, by cells."""
    bands = spark.createDataFrame([(0, 900.0, 999.99), (1, 1000.0, 1299.99), (2, 1250.0, 1600.0), (3, 1500.0, 2200.0)], "band int, low double, high double")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return joins.intervals(p, bands, "p_retailprice", "low", "high", 250.0).select("p_partkey", "p_retailprice", "band")


@query("""
WITH a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'ok' ELSE 'failed' END AS status FROM labels WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'ok' ELSE 'guessed' END AS status FROM labels WHERE doc_id % 10 <> 1)
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, a.status AS was, b.status AS now,
  CASE WHEN a.status IS NULL THEN 'new' WHEN b.status IS NULL THEN 'gone' WHEN list_position(['failed', 'guessed', 'ok'], b.status) > list_position(['failed', 'guessed', 'ok'], a.status) THEN 'gain'
       WHEN list_position(['failed', 'guessed', 'ok'], b.status) < list_position(['failed', 'guessed', 'ok'], a.status) THEN 'loss' ELSE 'same' END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id
""")
def compare_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings compared by key: a full outer join."""
    d = table(spark, sf_dir, "labels")
    a = d.where("doc_id % 10 <> 0").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    b = d.where("doc_id % 10 <> 1").select("doc_id", F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "ok").otherwise("guessed").alias("status"))
    return joins.compare(a, b, "doc_id", "status", ["failed", "guessed", "ok"])


@query("SELECT user_id, CAST(greatest(max(coalesce(CASE WHEN event_type = 'view' THEN event_id END, 0)), 100) AS BIGINT) AS opened FROM events GROUP BY user_id")
def best_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.greatest(F.max(F.coalesce(F.when(F.col("event_type") == "view", F.col("event_id")), F.lit(0))), F.lit(100)).cast("long").alias("opened"))


_CENTRES = [(k, [round(((k * 7 + j * 3) % 11 - 5) / 10, 1) for j in range(64)]) for k in range(6)]
_CENTRE_ROWS = ", ".join(f"({k}, {v}::DOUBLE[])" for k, v in _CENTRES)


@query(f"""
SELECT vec_id, CAST(arg_min(k, (round(d, 9), k)) AS INTEGER) AS centre, round(min(d), 6) AS distance FROM (
  SELECT vec_id, k, list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - c[i]) * (CAST(embedding[i] AS DOUBLE) - c[i]))) AS d FROM embeddings, (VALUES {_CENTRE_ROWS}) AS t(k, c)) GROUP BY vec_id
""")
def nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a short list of centres that stands in the plan."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return joins.nearest(e, _CENTRES, "embedding").select("vec_id", "centre", F.round("distance", 6).alias("distance"))


@query("""
SELECT conv_id, turn, CAST(bool_and(length(text) > 40) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BOOLEAN) AS path_ok FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
""")
def turn_path_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn and all before it hold: a condition along a linear path."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct()
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("conv_id", "turn", F.bool_and(F.length("text") > 40).over(w).alias("path_ok"))


@query("""
WITH RECURSIVE n AS (SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN (doc_id - 1) // 3 END AS parent, source, n_chars % 7 <> 0 AS agrees, CASE WHEN n_chars % 5 = 0 THEN 'guessed' ELSE 'ok' END AS status FROM documents),
p AS (SELECT id, agrees AS good FROM n WHERE parent IS NULL UNION ALL SELECT n.id, n.agrees AND p.good FROM n JOIN p ON n.parent = p.id)
SELECT source, count(*) AS tokens, count_if(status = 'ok' AND good) AS read, count_if(status = 'ok' AND NOT agrees) AS wrong, round(100.0 * count_if(status = 'ok' AND good) / count(*), 6) AS rate FROM n JOIN p USING (id) GROUP BY source
""")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rate over a tree: a node counts where it and all its ancestors agree."""
    d = table(spark, sf_dir, "documents")
    nodes = d.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") > 0, F.floor((F.col("doc_id") - 1) / 3)).alias("parent"), "source", (F.col("n_chars") % 7 != 0).alias("agrees"), F.when(F.col("n_chars") % 5 == 0, "guessed").otherwise("ok").alias("status")
    )
    return quality.success_rate(nodes, ["source"]).select("source", "tokens", "read", "wrong", "rate")


@query("SELECT doc_id, sha256(text) AS id, substr(sha256(lang || ':' || source), 1, 12) AS digest FROM documents")
def hash_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("id"), F.substring(F.sha2(F.concat_ws(":", "lang", "source"), 256), 1, 12).alias("digest"))


@query("SELECT source, row_number() OVER (ORDER BY CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), source) AS place FROM (SELECT DISTINCT source FROM documents)")
def natural_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A natural order of labels; only the distinct labels are ranked."""
    from ..functions.scalars import natural_key

    s = table(spark, sf_dir, "documents").select("source").distinct()
    return s.select("source", F.row_number().over(Window.orderBy(natural_key(F.col("source")), "source")).cast("long").alias("place"))


@query("SELECT user_id, count_if(event_type = 'view') AS view, count_if(event_type = 'click') AS click, count_if(event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id")
def event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click', 'purchase')")
    return e.groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count().na.fill(0)


@query("""
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def revenue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table is summed by supplier before it is joined, so the join moves a row a supplier."""
    money = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(money).alias("money"), F.count("*").alias("n"))
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = sums.join(s, sums.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.rollup("r_name", "n_name").agg(F.round(F.sum("money"), 2).alias("revenue"), F.sum("n").alias("n"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 10")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.col("total").desc(), "o_custkey").limit(10)


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    o = table(spark, sf_dir, "orders")
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def anti_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT p_partkey FROM part WHERE p_size > 10")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")).subtract(table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def common_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("""
WITH r AS (SELECT DISTINCT p_brand AS brand, p_size AS a, p_size + p_partkey % 3 AS b FROM part), s AS (SELECT *, max(b) OVER (PARTITION BY brand ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r),
g AS (SELECT *, sum(CASE WHEN a <= top + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY brand ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT brand, min(a) AS a, max(b) AS b FROM g GROUP BY brand, g
""")
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges merged where they touch."""
    r = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("a"), (F.col("p_size") + F.col("p_partkey") % 3).alias("b"))
    return windows.merged_ranges(r, ["brand"], "a", "b")


@query("""
WITH c AS (SELECT source, n_chars % 100 AS v, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT *, sum(n) OVER w AS n0, sum(CAST(v AS DOUBLE) * n) OVER w AS s0, sum(n) OVER (PARTITION BY source) AS nt, sum(CAST(v AS DOUBLE) * n) OVER (PARTITION BY source) AS st FROM c WINDOW w AS (PARTITION BY source ORDER BY v))
SELECT source, arg_max(v, (round(n0 * (nt - n0) * power(s0 / n0 - (st - s0) / (nt - n0), 2), 3), -v)) AS threshold FROM s WHERE n0 < nt GROUP BY source
""")
def otsu_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-class threshold of each source's values."""
    return aggregates.otsu(table(spark, sf_dir, "documents").select("source", (F.col("n_chars") % 100).alias("v")), ["source"], "v")


@query("""
WITH c AS (SELECT p_brand AS brand, p_type AS kind, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY brand ORDER BY n DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER (PARTITION BY brand) AS al FROM c)
SELECT brand, kind, n FROM r WHERE b < 0.8 * al
""")
def kind_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest kinds that cover four fifths of each brand."""
    return aggregates.coverage(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")), ["brand"], "kind", 0.8)


@query("""
WITH c AS (SELECT p_brand AS brand, p_size AS size, sum(p_retailprice) AS w, min(p_size) AS t FROM part GROUP BY ALL) SELECT brand, arg_max(size, (round(w, 2), -t)) AS size, round(max(w), 2) AS weight FROM c GROUP BY brand
""")
def brand_body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted mode with a tie rule."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), "p_retailprice")
    return aggregates.weighted_mode(p, ["brand"], "size", F.col("p_retailprice"), F.col("size")).withColumn("weight", F.round("weight", 2))


@query("SELECT o_orderpriority, o_orderstatus, n, total FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS total FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)) WHERE n >= 3 AND n >= 0.3 * total")
def status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with a large enough share of their group."""
    return aggregates.shares(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", 0.3, 3)


@query("""
WITH RECURSIVE p AS (SELECT o_orderpriority AS a, c_mktsegment AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, a, b) AS k FROM p),
g AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS used_a, []::VARCHAR[] AS used_b, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::BIGINT AS n
  UNION ALL SELECT o.k, CASE WHEN list_contains(used_a, o.a) OR list_contains(used_b, o.b) THEN used_a ELSE list_append(used_a, o.a) END, CASE WHEN list_contains(used_a, o.a) OR list_contains(used_b, o.b) THEN used_b ELSE list_append(used_b, o.b) END,
    CASE WHEN list_contains(used_a, o.a) OR list_contains(used_b, o.b) THEN NULL ELSE o.a END, o.b, o.n FROM g JOIN o ON o.k = g.k + 1)
SELECT a, b, n FROM g WHERE a IS NOT NULL
""")
def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one assignment by falling support."""
    o, c = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    pairs = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("o_orderpriority").alias("a"), F.col("c_mktsegment").alias("b")).agg(F.count("*").alias("n"))
    return aggregates.assign(pairs, "a", "b", "n")


@query("SELECT lang, source, n, round((n + 2.0 / 50) / (CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE) + 2), 6) AS p FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)")
def symbol_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed probabilities of values given their key."""
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return aggregates.posterior(counts, "lang", "source", "n", 50).withColumn("p", F.round("p", 6))


@query("""
WITH c AS (SELECT label AS g, CAST(vec_id % 7 AS INTEGER) AS name, count(*) AS n FROM embeddings GROUP BY ALL), b AS (SELECT g, arg_max(name, (n, name)) AS name, max(n) AS votes, CAST(sum(n) AS BIGINT) AS total, count(*) AS named, list(n) AS al FROM c GROUP BY g)
SELECT g, name, votes, total, round(1 / (list_sum(list_transform(al, lambda n: power(4.0, n - votes))) + (10 - named) * power(4.0, -votes)), 6) AS confidence FROM b
""")
def vote_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of groups by votes, with a confidence from odds."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("g"), (F.col("vec_id") % 7).cast("int").alias("name"))
    return aggregates.votes(e, "g", "name", 10).withColumn("confidence", F.round("confidence", 6))


@query("SELECT g, name, n, total FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY g) AS BIGINT) AS total FROM (SELECT label AS g, least(vec_id % 5, 1) AS name, count(*) AS n FROM embeddings GROUP BY ALL)) WHERE n >= 3 AND 3 * n >= 2 * total")
def twin_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twin values that hold two thirds of at least three votes."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("g"), F.least(F.col("vec_id") % 5, F.lit(1)).cast("long").alias("name"))
    return aggregates.shares(e, ["g"], "name", 2 / 3, 3)


@query(r"""
WITH l AS (SELECT lang AS font, 10.0 + 8 * (doc_id % 2) AS size, doc_id AS page, unnest(string_split(text, chr(10))) AS text FROM documents),
w AS (SELECT font, round(exp(round(ln(size) / ln(1.04)) * ln(1.04)), 1) AS size, page, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM l)
SELECT font, CAST(size AS DOUBLE) AS size, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT page) AS pages, count(*) AS lines, CAST(sum(len(ws)) AS BIGINT) AS words, CAST(sum(len(list_filter(ws, lambda x: regexp_matches(x, '^[a-h1-8]$')))) AS BIGINT) AS coordinates
FROM w GROUP BY font, size
""")
def line_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font profiles of all lines of documents, with the language as the font."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("font"), (10.0 + 8 * (F.col("doc_id") % 2)).alias("size"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n", -1)).alias("text"))
    return layout.font_profiles(d).select("font", "size", "chars", "pages", "lines", "words", "coordinates")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 40")
def hot_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top forty groups: a top-k report."""
    return quality.hot(table(spark, sf_dir, "events"), "user_id")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events WHERE event_type = 'error' GROUP BY user_id")
def first_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bad row of each line."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return quality.first_breaks(e, "user_id", F.struct("ts", "event_id"), F.col("event_type") == "error").select("user_id", "event_id", "ts")


@query("SELECT user_id, event_id, CAST(count_if(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS doubts, abs(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 500 AS jump FROM events")
def recent_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful rows among the last four, and jumps from the row before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.count_if(F.col("event_type") == "error").over(w.rowsBetween(-3, 0)).alias("doubts"), (F.abs(F.col("event_id") - F.lag("event_id").over(w)) > 500).alias("jump"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def lru_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most recent rows of each group stay: eviction is the feature."""
    return windows.kept_recent(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id")], 3).select("user_id", "event_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def parsed_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("""
SELECT reason, count(*) AS count FROM (SELECT CASE WHEN event_type = 'error' THEN regexp_replace('page ' || (event_id % 50), '[0-9]+', 'N', 'g') WHEN event_type <> 'view' THEN event_type WHEN value < 10 THEN 'wrong' ELSE 'broken earlier' END AS reason FROM events
WHERE event_id % 3 = 0 OR event_type <> 'ok') GROUP BY reason
""")
def why_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread tokens by reason, digits masked."""
    e = table(spark, sf_dir, "events").select(
        (F.col("event_type") != "error").alias("placed"), F.concat(F.lit("page "), (F.col("event_id") % 50).cast("string")).alias("reason"), F.when(F.col("event_type") == "view", "ok").otherwise(F.col("event_type")).alias("status"),
        (F.col("value") >= 10).alias("agrees"), F.lit(False).alias("path_ok"),
    )
    return quality.why(e)


@query("SELECT kind, id FROM (SELECT 'event' AS kind, event_id AS id FROM events WHERE event_type = 'error' UNION ALL SELECT 'page', page_id FROM pages WHERE html LIKE '%script%' UNION ALL SELECT 'doc', doc_id FROM labels WHERE toxic = 1)")
def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of several runs in one table."""
    one = lambda name, kind, key, cond: table(spark, sf_dir, name).where(cond).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return one("events", "event", "event_id", "event_type = 'error'").unionByName(one("pages", "page", "page_id", "html like '%script%'")).unionByName(one("labels", "doc", "doc_id", "toxic = 1"))


@query("""
SELECT page_id, len(regexp_extract_all(html, '<h[1-6]')) AS headings, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links,
  CASE WHEN len(regexp_extract_all(html, '<h[1-6]')) > 0 THEN 'heading' WHEN len(regexp_extract_all(html, '<p[ >]')) > 0 THEN 'text' ELSE 'blank' END AS role FROM pages
""")
def html_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles from tags: the classifier's pure predicates as chained conditions."""
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    h, p = n("<h[1-6]"), n("<p[ >]")
    return table(spark, sf_dir, "pages").select("page_id", h.alias("headings"), p.alias("paragraphs"), n("<a ").alias("links"), F.when(h > 0, "heading").when(p > 0, "text").otherwise("blank").alias("role"))


@query("""
SELECT c.doc_id AS id, (c.doc_id - 1) // 3 AS parent, c.n_chars % 100 AS page, p.n_chars % 100 AS parent_page FROM documents c JOIN documents p ON (c.doc_id - 1) // 3 = p.doc_id AND c.doc_id > 0 WHERE abs(c.n_chars % 100 - p.n_chars % 100) > 1
""")
def page_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose page is far from their parent's."""
    d = table(spark, sf_dir, "documents")
    return quality.jumps(d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") > 0, F.floor((F.col("doc_id") - 1) / 3)).alias("parent"), (F.col("n_chars") % 100).alias("page")))


@query("SELECT c_custkey AS id, c_name AS title, moves FROM customer JOIN (SELECT o_custkey, count(*) AS moves FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND moves < 12")
def short_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of fewer than twelve moves."""
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("x").alias("chapter"), F.when(F.col("c_mktsegment") == "BUILDING", "game").otherwise("fragment").alias("kind"), F.col("c_name").alias("title"))
    o = table(spark, sf_dir, "orders")
    nodes = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("line"), F.lit(None).cast("long").alias("parent"), F.lit(1).alias("page"), F.lit(1).alias("ply"), F.lit(True).alias("main"), F.lit("ok").alias("status"), F.lit("e4").alias("san"), F.lit("e4").alias("raw"))
    return quality.scan(nodes, lines, lines.select("id", F.lit(1).alias("page"), F.col("kind").alias("status")))["short_games"]


@query("SELECT vec_id AS board, list_position(embedding, list_min(embedding)) - 1 AS weakest, CAST(list_min(embedding) AS DOUBLE) AS confidence FROM embeddings")
def board_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least sure square of each board: every element of its vector is a square."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("board"), F.posexplode("embedding").alias("square", "c")).select("board", "square", F.col("c").cast("double").alias("confidence"))
    return inference.board_confidence(e, "board")
