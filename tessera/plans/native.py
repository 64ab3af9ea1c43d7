"""Queries of operators that run in Spark's own expressions, over whole driver tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import notation, scalars
from ..operators import aggregates, chains, corrections, inference, lattice, layout, paths, reading, runs, scripts, windows
from ..operators.materialise import shared_folder
from ..sources import gamefiles, pages, tables
from ..sources.tables import table
from ..streaming import steps, streams
from .registry import query

# ---- frontiers, pointers and cells

_STATES = "('click'), ('error'), ('purchase'), ('signup'), ('view')"


@query(f"""
WITH RECURSIVE moves AS (
  SELECT before, after, (1000 * (sum(n) OVER (PARTITION BY before) - n)) // sum(n) OVER (PARTITION BY before) AS cost
  FROM (SELECT before, after, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events) WHERE before IS NOT NULL GROUP BY ALL)),
steps AS (
  SELECT user_id || '/' || day AS key, pos, s AS state, CASE WHEN s = event_type THEN 0 ELSE 300 + event_id % 7 * 100 END AS cost
  FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos FROM events), (VALUES {_STATES}) v(s)),
beam AS (
  SELECT key, 1 AS pos, CAST(cost AS BIGINT) AS cost, [state] AS way FROM steps WHERE pos = 1
  UNION ALL
  SELECT key, pos, cost, way FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY cost, way) AS r FROM (
      SELECT *, sum(old) OVER (PARTITION BY key ORDER BY cost, way ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS olds FROM (
        SELECT *, count(*) OVER (PARTITION BY key) AS n, CASE WHEN pos > 4 AND way[1:pos - 4] <> first_value(way[1:pos - 4]) OVER (PARTITION BY key ORDER BY cost, way) THEN 1 ELSE 0 END AS old FROM (
          SELECT b.key, b.pos + 1 AS pos, CAST(b.cost + m.cost + s.cost AS BIGINT) AS cost, list_append(b.way, s.state) AS way
          FROM beam b JOIN steps s ON s.key = b.key AND s.pos = b.pos + 1 JOIN moves m ON m.before = b.way[-1] AND m.after = s.state)))
    WHERE n <= 8 OR old = 0 OR olds <= 2) WHERE r <= 8)
SELECT key, cost, array_to_string(way, ' ') AS way FROM beam b WHERE pos = (SELECT max(pos) FROM steps s WHERE s.key = b.key) QUALIFY row_number() OVER (PARTITION BY key ORDER BY cost, b.way) = 1
""")
def beam_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best reading of each user's day: each event may be of another type, at a cost, and a type after another costs what its share of all such steps says; a beam of eight, of which two may have parted from the best more than four steps ago."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    moves = lattice.move_costs(e, "user_id", ["ts", "event_id"], "event_type")
    day = F.col("ts").cast("date")
    placed = windows.numbered(e.withColumn("day", day), ["user_id", "day"], ["ts", "event_id"], "pos")
    states = e.select(F.col("event_type").alias("state")).distinct()
    typed = F.broadcast(states)  # a row a type of event, five by the table's definition
    steps = placed.crossJoin(typed).select(F.concat_ws("/", "user_id", F.col("day").cast("string")).alias("key"), "pos", "state", F.when(F.col("state") == F.col("event_type"), 0).otherwise(300 + F.col("event_id") % 7 * 100).alias("cost"))
    return lattice.beam(steps, moves, 8, old=2, age=4).where("place = 1").select("key", "cost", F.array_join("way", " ").alias("way"))


_TOKENS = r"""
pieces AS (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS raw FROM (SELECT doc_id, regexp_extract_all(text, '([0-9]+|[()\[\]{}]|[^0-9()\[\]{}]+)') AS p FROM documents)),
placed AS (SELECT doc_id, k, raw, CAST(coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM pieces),
tokens AS (SELECT doc_id, pos, raw, TRY_CAST(raw AS INTEGER) AS value FROM placed WHERE regexp_matches(raw, '^([0-9]{1,3}|[()\[\]{}])$'))
"""


def _depth(name: str, sign: str, close: str, life: int) -> str:
    return f"""
{name}_sum AS (SELECT doc_id, pos, sum(CASE raw WHEN '{sign}' THEN 1 WHEN '{close}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM tokens),
{name}_w AS (SELECT doc_id, pos, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY pos)) AS w FROM {name}_sum),
{name}_before AS (SELECT doc_id, pos, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS w FROM {name}_w),
{name} AS (SELECT doc_id, pos, CAST(w - min(w) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN {life} PRECEDING AND CURRENT ROW) AS INTEGER) AS d FROM {name}_before)"""


@query(f"""
WITH {_TOKENS}, {_depth("rounds", "(", ")", 600)}, {_depth("squares", "[", "]", 3000)}, {_depth("curls", "{", "}", 600)},
told AS (SELECT t.*, r.d + s.d + c.d AS depth, lag(value) OVER (PARTITION BY t.doc_id ORDER BY t.pos) AS last FROM tokens t JOIN rounds r USING (doc_id, pos) JOIN squares s USING (doc_id, pos) JOIN curls c USING (doc_id, pos)),
numbered AS (SELECT *, sum(CASE WHEN value - last BETWEEN 0 AND 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM told)
SELECT doc_id, min(pos) AS start, max(pos) AS stop, arg_min(value, pos) AS first, arg_max(value, pos) AS last, count(*) AS numbers, arg_min(depth, pos) AS depth FROM numbered WHERE value IS NOT NULL GROUP BY doc_id, run
""")
def numbered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of numbers in all whole documents, with the brackets that are open before each."""
    return runs.numbered_runs(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem WHERE l_quantity >= 49),
links AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
pairs AS (SELECT 's' || s_suppkey AS source, 's' || (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS target FROM supplier),
ways AS (
  SELECT source, target, source AS node, [source] AS way, 0 AS steps, false AS done FROM pairs
  UNION ALL
  SELECT source, target, node, way, steps, done FROM (
    SELECT w.source, w.target, l.y AS node, list_append(w.way, l.y) AS way, w.steps + 1 AS steps, false AS done, row_number() OVER (PARTITION BY w.source, w.target, l.y ORDER BY w.way) AS r
    FROM ways w JOIN links l ON l.x = w.node WHERE w.steps < 6 AND w.node <> w.target AND NOT list_contains(w.way, l.y)) WHERE r = 1)
SELECT p.source, p.target, w.steps, array_to_string(w.way, ' ') AS way FROM pairs p LEFT JOIN (SELECT * FROM ways WHERE node = target QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY steps, way) = 1) w USING (source, target)
""")
def shortest_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest way of at most six steps from each supplier to another one, over parts that both have sold in large lots."""
    e = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    pairs = s.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("s"), (F.col("s_suppkey") * 7 + 3) % s.count()).alias("target"))
    found, _ = paths.shortest(e, pairs, 6)
    return found.select("source", "target", "steps", F.array_join("way", " ").alias("way"))


# an event goes on with the one before; every seventh is another choice instead of the one three before it; every five hundredth starts a tree
_TREE = "SELECT event_id AS id, CASE WHEN event_id % 500 = 0 THEN NULL WHEN event_id % 7 = 3 AND event_id % 500 > 4 THEN event_id - 3 ELSE event_id - 1 END AS parent, CASE WHEN event_id % 500 > 4 AND event_id % 7 = 3 THEN 1 ELSE 0 END AS k, event_type FROM events"


@query(f"""
WITH RECURSIVE t AS ({_TREE}),
walk AS (
  SELECT id, id AS root, [0::BIGINT, 0] AS key, 0 AS depth FROM t WHERE parent IS NULL
  UNION ALL
  SELECT c.id, w.root, CASE WHEN c.k = 0 THEN list_concat(w.key[1:len(w.key) - 2], [w.key[-2] + 1, 0]) ELSE list_concat(w.key[1:len(w.key) - 2], [w.key[-2] + 1, c.k, 0, 0]) END, CASE WHEN c.k = 0 THEN w.depth ELSE w.depth + 1 END
  FROM walk w JOIN t c ON c.parent = w.id)
SELECT id, root, depth, row_number() OVER (ORDER BY root, key) AS place FROM walk
""")
def printed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all events listed as they are printed, each variation after what it replaces, and each row's place in the listing."""
    k = F.col("event_id")
    other = (k % 7 == 3) & (k % 500 > 4)
    nodes = table(spark, sf_dir, "events").select(k.alias("id"), F.when(k % 500 == 0, None).when(other, k - 3).otherwise(k - 1).alias("parent"), other.cast("int").alias("k"))
    return paths.placed(paths.listed(nodes, "id", "parent", "k"), ["root", "key"]).select("id", "root", "depth", "place")


@query("""
WITH RECURSIVE v AS (SELECT DISTINCT event_type AS g, value AS y FROM events),
opens AS (SELECT g, min(y) AS y FROM v GROUP BY g UNION ALL SELECT o.g, (SELECT min(v.y) FROM v WHERE v.g = o.g AND v.y > o.y + 2.5) FROM opens o WHERE o.y IS NOT NULL)
SELECT event_id, CAST((SELECT count(*) FROM opens o WHERE o.g = e.event_type AND o.y <= e.value) - 1 AS INTEGER) AS band FROM events e
""")
def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of each type's events by value: a row is no more than 2.5 above its band's first."""
    return chains.row_groups(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "value", 2.5).select("event_id", "band")


# ---- scalar rules over values of the tables

_SAY = ["with 12.Qh5 threatening", "Better was", "Black intended this, and then", "as so often, e.g.", "in moves 12-15", "a calm move", "instead", "White to move and win", "Black plays on", "after this"]
_SAID = "[" + ", ".join(f"'{x}'" for x in _SAY) + "][1 + doc_id % 10]"
_SENTENCE = f"(SELECT doc_id, source || ' ' || {_SAID} AS t FROM documents)"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each document, one of ten after its source."""
    said = F.get(F.array(*[F.lit(x) for x in _SAY]), (F.col("doc_id") % len(_SAY)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "source", said).alias("t"))


@query(rf"""
SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)\b(threat(?:en(?:s|ing)?|s)?|intending|with the idea)\b') THEN 'threat' WHEN regexp_matches(t, '(?i)\b(or|instead|if|better(?: was)?|after)\b[^.]{{0,12}}$') THEN 'alternative'
  WHEN regexp_matches(t, '(?i)\b(followed by|and then|then)\b[^.]{{0,12}}$') THEN 'follow' WHEN regexp_matches(t, '(?i)\b(e\.g\.|for example|namely)([^a-z]|$)') THEN 'bare' WHEN regexp_matches(t, '(?i)\bmoves? +[0-9]{{1,3}} *(?:-|–|to) *[0-9]{{1,3}}\b') THEN 'range' END AS cue FROM {_SENTENCE}
""")
def cue_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("doc_id", layout.cue(F.col("t")).alias("cue"))


@query(rf"""
SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)\bwhite\b[^.]{{0,20}}\b(to (?:move|play)|plays?|moves?)\b|\bw\b\s*$') THEN 'w' WHEN regexp_matches(t, '(?i)\bblack\b[^.]{{0,20}}\b(to (?:move|play)|plays?|moves?)\b|\bb\b\s*$') THEN 'b' END AS side FROM {_SENTENCE}
""")
def sides_to_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("doc_id", layout.side_to_move(F.col("t")).alias("side"))


_ROMAN = ["i", "iv", "ix", "xl", "xc", "cd", "cm", "xiv", "lxxxviii", "mcmxcix"]
_VALUE = [1, 4, 9, 40, 90, 400, 900, 14, 88, 1999]


@query(f"""
WITH t AS (SELECT p_partkey AS id, p_partkey % 4 AS c, p_partkey % 10 AS r, p_name AS n, p_size AS z FROM part)
SELECT id, CASE c WHEN 0 THEN 'chapter' WHEN 1 THEN 'part' WHEN 2 THEN 'section' END AS kind, CASE c WHEN 1 THEN {_VALUE}[1 + r] WHEN 3 THEN NULL ELSE z END AS number, CASE c WHEN 3 THEN NULL ELSE n END AS title FROM t
""")
def chapter_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings made of parts' names and sizes, one kind in Roman numerals, one no heading."""
    c, roman = F.col("p_partkey") % 4, F.get(F.array(*[F.lit(x.upper()) for x in _ROMAN]), (F.col("p_partkey") % 10).cast("int"))
    text = F.when(c == 0, F.format_string("Chapter %d: %s", "p_size", "p_name")).when(c == 1, F.concat_ws(" ", F.lit("PART"), roman, F.lit("-"), "p_name")).when(c == 2, F.format_string(" section %d. %s", "p_size", "p_name")).otherwise(F.concat(F.lit("a chapter of "), "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalars.chapter_heading(text).alias("h")).select("id", "h.kind", "h.number", "h.title")


@query(f"SELECT p_partkey AS id, {_VALUE}[1 + p_partkey % 10] + 2000 * (p_partkey % 3) AS value FROM part")
def roman_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a Roman numeral for each part, thousands before it."""
    k = F.col("p_partkey")
    text = F.concat(F.repeat(F.lit("M"), (2 * (k % 3)).cast("int")), F.get(F.array(*[F.lit(x) for x in _ROMAN]), (k % 10).cast("int")))
    return table(spark, sf_dir, "part").select(k.alias("id"), scalars.roman(text).alias("value"))


@query("SELECT o_orderkey, c_name AS white, 'Clerk #' || o_orderkey AS black, CASE WHEN o_orderkey % 3 > 0 THEN c_mktsegment END AS site, CASE WHEN o_orderkey % 2 = 0 THEN CAST(1000 + o_orderkey % 1900 AS INTEGER) END AS year FROM orders JOIN customer ON o_custkey = c_custkey")
def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players, place and year from a heading made for each order, the year printed apart in some (1 921)."""
    k = F.col("o_orderkey")
    year = (1000 + k % 1900).cast("string")
    shown = F.when(k % 4 == 0, F.concat(F.substring(year, 1, 1), F.lit(" "), F.substring(year, 2, 3))).when(k % 2 == 0, year)
    head = F.concat(F.col("c_name"), F.lit(" - Clerk #"), k.cast("string"))
    text = F.concat(head, F.when(k % 3 > 0, F.concat(F.lit(", "), F.col("c_mktsegment"))).otherwise(""), F.coalesce(F.concat(F.lit(" "), shown), F.lit("")))
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", scalars.header(text).alias("h")).select("o_orderkey", "h.*")


_SIGN = "CASE event_id % 4 WHEN 0 THEN ['1-0', '0-1', '½-½', '1/2', '*'][1 + event_id % 5] WHEN 1 THEN ['!', '?', '!!', '??', '!?', '?!', '!!!'][1 + event_id % 7] WHEN 2 THEN translate(CAST(event_id % 1000 AS VARCHAR), '180', 'lSO') ELSE CAST(event_id % 1100 AS VARCHAR) END"


@query(f"""
WITH s AS (SELECT event_id, {_SIGN} AS raw FROM events),
n AS (SELECT *, translate(raw, 'lI|OoSsB', '11100888') AS a, translate(translate(raw, 'Ss', '55'), 'lI|OoSsB', '11100888') AS b FROM s)
SELECT event_id, CASE WHEN length(raw) <= 3 AND regexp_matches(a, '^[1-9][0-9]*$') THEN CASE WHEN a = b THEN a ELSE a || ',' || b END ELSE '' END AS numbers,
  CASE raw WHEN '1-0' THEN '1-0' WHEN '0-1' THEN '0-1' WHEN '½-½' THEN '1/2-1/2' WHEN '1/2' THEN '1/2-1/2' WHEN '*' THEN '*' END AS result,
  CASE raw WHEN '!' THEN 1 WHEN '?' THEN 2 WHEN '!!' THEN 3 WHEN '??' THEN 4 WHEN '!?' THEN 5 WHEN '?!' THEN 6 END AS nag FROM n
""")
def printed_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of badly printed numbers, results and annotation signs, one a event."""
    k = F.col("event_id")
    pick = lambda options, n: F.get(F.array(*[F.lit(x) for x in options]), (k % n).cast("int"))
    raw = F.when(k % 4 == 0, pick(["1-0", "0-1", "½-½", "1/2", "*"], 5)).when(k % 4 == 1, pick(["!", "?", "!!", "??", "!?", "?!", "!!!"], 7)).when(k % 4 == 2, F.translate((k % 1000).cast("string"), "180", "lSO")).otherwise((k % 1100).cast("string"))
    d = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    raw = F.col("raw")
    return d.select("event_id", F.array_join(scalars.number_values(raw).cast("array<string>"), ",").alias("numbers"), scalars.result(raw).alias("result"), scalars.nag(raw).alias("nag"))


@query("""
WITH d AS (SELECT event_id, CAST(event_id % 1000 AS VARCHAR) AS a, CAST(user_id * 7 % 1000 AS VARCHAR) AS b FROM events),
w AS (SELECT *, [least(a[i], b[i]) || greatest(a[i], b[i]) FOR i IN range(1, 4) IF a[i] <> b[i]] AS wrong FROM d)
SELECT event_id, length(a) = length(b) AND len(wrong) = 1 AND wrong[1] IN ('17', '38', '56', '58', '68', '08') AS slip FROM w
""")
def digit_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event's number is a user's with one digit misread."""
    raw = F.concat((F.col("event_id") % 1000).cast("string"), F.lit("."))
    return table(spark, sf_dir, "events").select("event_id", scalars.digit_slip(raw, F.col("user_id") * 7 % 1000).alias("slip"))


_FILES, _RANKS = "abcdefgh£C-", "12345678lSBZ+"


@query(rf"""
WITH r AS (SELECT event_id, 'N' || substr('{_FILES}', 1 + event_id % 11, 1) || substr('{_RANKS}', 1 + user_id % 13, 1) || substr('{_FILES}', 1 + (event_id + user_id) % 11, 1) || substr('{_RANKS}', 1 + event_id * 5 % 13, 1) AS raw FROM events),
c AS (SELECT event_id, i, CASE substr(raw, i + 1, 1) WHEN '£' THEN 'f' WHEN 'C' THEN 'c' ELSE substr(raw, i + 1, 1) END AS f, CASE WHEN regexp_matches(substr(raw, i + 2, 1), '[1-8]') THEN substr(raw, i + 2, 1) ELSE CASE substr(raw, i + 2, 1) WHEN 'l' THEN '1' WHEN 'S' THEN '58' WHEN 'B' THEN '8' WHEN 'Z' THEN '2' ELSE '' END END AS k FROM r, range(0, 4) g(i))
SELECT event_id, coalesce(string_agg(CASE WHEN regexp_matches(f, '^[a-h]$') AND k <> '' THEN i || ':' || f || k[1] || CASE WHEN length(k) = 2 THEN '/' || f || k[2] ELSE '' END END, ';' ORDER BY i), '') AS squares FROM c GROUP BY event_id
""")
def squares_in_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every square that a token printed for each event may show."""
    at = lambda options, n: F.substr(F.lit(options), (1 + n % len(options)).cast("int"), F.lit(1))
    k, u = F.col("event_id"), F.col("user_id")
    raw = F.concat(F.lit("N"), at(_FILES, k), at(_RANKS, u), at(_FILES, k + u), at(_RANKS, k * 5))
    d = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return d.select("event_id", F.array_join(F.transform(scalars.printed_squares(F.col("raw")), lambda x: F.concat(x["at"].cast("string"), F.lit(":"), F.array_join(x["squares"], "/"))), ";").alias("squares"))


# a board from each vector: a square for each of 64 components, most of them empty
_PIECES = "KkQRBNPqrbnp"
_BOARD = f"SELECT vec_id, array_to_string([CASE WHEN CAST(floor(abs(c::DOUBLE) * 1000) AS BIGINT) % 64 < 12 THEN '{_PIECES}'[1 + CAST(floor(abs(c::DOUBLE) * 1000) AS BIGINT) % 64] ELSE '1' END FOR c IN embedding], '') AS b FROM embeddings"


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = lambda c: (F.floor(F.abs(c.cast("double")) * 1000) % 64).cast("int")
    spread = F.array_join(F.transform("embedding", lambda c: F.when(piece(c) < 12, F.substr(F.lit(_PIECES), piece(c) + 1, F.lit(1))).otherwise("1")), "")
    ranks = F.regexp_replace(spread, "(.{8})(?=.)", "$1/")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(ranks, F.lit(" w - - 0 1")).alias("fen"))


@query(f"""
SELECT vec_id, length(b) - length(replace(b, 'K', '')) = 1 AND length(b) - length(replace(b, 'k', '')) = 1 AND NOT regexp_matches(b[1:8] || b[57:64], '[Pp]') AS legal,
  CASE WHEN c = '' THEN '-' ELSE c END AS castling, CAST(length(b) - length(replace(b, '1', '')) AS INTEGER) AS empty
FROM (SELECT *, CASE WHEN b[61] = 'K' AND b[64] = 'R' THEN 'K' ELSE '' END || CASE WHEN b[61] = 'K' AND b[57] = 'R' THEN 'Q' ELSE '' END || CASE WHEN b[5] = 'k' AND b[8] = 'r' THEN 'k' ELSE '' END || CASE WHEN b[5] = 'k' AND b[1] = 'r' THEN 'q' ELSE '' END AS c FROM ({_BOARD}))
""")
def positions_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal shape, castling rights from first squares, and empty squares of each vector's board."""
    f = F.col("fen")
    return _boards(spark, sf_dir).select("vec_id", scalars.legal_shape(f).alias("legal"), scalars.castling(f).alias("castling"), F.size(F.filter(scalars.squares(f), lambda c: c == ".")).alias("empty"))


@query(f"""
WITH b AS ({_BOARD})
SELECT x.vec_id, len(d) AS squares, array_to_string(list_sort(d), '|') AS diff FROM (
  SELECT x.vec_id, [chr(CAST(97 + i % 8 AS INTEGER)) || (8 - i // 8) || ' ' || replace(x.b[i + 1], '1', '.') || '>' || replace(y.b[i + 1], '1', '.') FOR i IN range(64) IF x.b[i + 1] <> y.b[i + 1]] AS d FROM b x JOIN b y ON y.vec_id = x.vec_id + 1) x
""")
def square_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares where a vector's board and the next one's differ."""
    b = _boards(spark, sf_dir)
    both = b.join(b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("fen").alias("next")), "vec_id").withColumn("d", scalars.square_diff(F.col("fen"), F.col("next")))
    shown = F.array_join(F.array_sort(F.transform("d", lambda x: F.concat(x["square"], F.lit(" "), x["first"], F.lit(">"), x["second"]))), "|")
    return both.select("vec_id", F.size("d").cast("long").alias("squares"), shown.alias("diff"))


# ---- order and layout

_OPTIONS = "CASE WHEN l_linenumber % 3 = 0 THEN [CAST(l_quantity AS INTEGER)] ELSE [CAST(l_quantity AS INTEGER), CAST(l_partkey % 60 AS INTEGER)] END"


@query(f"""
WITH RECURSIVE o AS (SELECT l_orderkey AS k, {_OPTIONS} AS options, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem),
walk AS (
  SELECT k, rn, options[1] AS last, [options[1]] AS chosen FROM o WHERE rn = 1
  UNION ALL
  SELECT o.k, o.rn, coalesce(list_min([x FOR x IN o.options IF x > w.last]), o.options[1]), list_append(w.chosen, coalesce(list_min([x FOR x IN o.options IF x > w.last]), o.options[1])) FROM walk w JOIN o ON o.k = w.k AND o.rn = w.rn + 1)
SELECT k AS l_orderkey, array_to_string(chosen, ',') AS resolved FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY rn DESC) = 1
""")
def resolved_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the numbers that an order's lines may show, in order of lines, each takes that which follows the one before most closely."""
    q = F.col("l_quantity").cast("int")
    options = F.when(F.col("l_linenumber") % 3 == 0, F.array(q)).otherwise(F.array(q, (F.col("l_partkey") % 60).cast("int")))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", options.alias("options"))
    orders = table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return orders.select("l_orderkey", F.array_join(windows.resolve_ambiguous(F.transform("x", lambda x: x["options"])).cast("array<string>"), ",").alias("resolved"))


# every number of these texts stands after a space or first, and every move before a space or last
_PAIRS = [p.replace(r"(?<![\w.,])", "(?:^| )").replace(r"(?!\w)", "") for p in (notation.DOTLESS_PAIR, notation.DOTTED_PAIR)]
_PRINTED = "string_agg(CASE WHEN event_id % 3 = 0 THEN n || '.e4 e5' WHEN event_id % 3 = 1 THEN n || ' e4 c5' ELSE n || ' men' END, ' ' ORDER BY event_id)"


@query(rf"""
WITH t AS (SELECT user_id % 40 AS book, user_id, {_PRINTED} AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY ALL),
c AS (SELECT book, len([1 FOR i IN range(1, len(a) + 1) IF CAST(b[i] AS INTEGER) = CAST(a[i] AS INTEGER) + 1]) AS dotless, len([1 FOR i IN range(1, len(c) + 1) IF CAST(d[i] AS INTEGER) = CAST(c[i] AS INTEGER) + 1]) AS dotted
  FROM (SELECT book, regexp_extract_all(text, '{_PAIRS[0]}', 1) AS a, regexp_extract_all(text, '{_PAIRS[0]}', 2) AS b, regexp_extract_all(text, '{_PAIRS[1]}', 1) AS c, regexp_extract_all(text, '{_PAIRS[1]}', 2) AS d FROM t))
SELECT book, CAST(sum(dotless) AS BIGINT) AS dotless, CAST(sum(dotted) AS BIGINT) AS dotted, sum(dotless) >= 3 AND sum(dotless) >= 0.08 * sum(dotted) AS reads_dotless FROM c GROUP BY book
""")
def numbering_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How books number their moves: a text a user, a number an event, some with dots."""
    e = windows.numbered(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], "n")
    k, n = F.col("event_id"), F.col("n").cast("string")
    move = F.when(k % 3 == 0, F.concat(n, F.lit(".e4 e5"))).when(k % 3 == 1, F.concat(n, F.lit(" e4 c5"))).otherwise(F.concat(n, F.lit(" men")))
    texts = e.select("user_id", F.struct("event_id", move.alias("m")).alias("x")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]), " ").alias("text"))
    return reading.numbering(texts.withColumn("book", F.col("user_id") % 40), ["book"], "text")


_WORDS = "(SELECT doc_id, line, generate_subscripts(w, 1) - 1 AS k, unnest(w) AS text FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, string_split(unnest(l), ' ') AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


@query(f"""
WITH w AS (SELECT *, CASE WHEN (k + doc_id) % 5 < 2 THEN 'M' WHEN (k + doc_id) % 5 = 2 THEN 'N' ELSE 'B' END = 'M' AS main FROM {_WORDS}),
n AS (SELECT *, lag(main) OVER (PARTITION BY doc_id, line ORDER BY k) AS before FROM w)
SELECT doc_id, line, md5(string_agg(text, ' ' ORDER BY k)) AS original, md5(string_agg(CASE WHEN main THEN text ELSE repeat(' ', length(text)) END, ' ' ORDER BY k)) AS main_text,
  md5(string_agg(CASE WHEN NOT main THEN text WHEN coalesce(before, false) OR length(text) = 0 THEN repeat(' ', length(text)) ELSE rpad('¶', CAST(length(text) AS INTEGER), ' ') END, ' ' ORDER BY k)) AS note_text FROM n GROUP BY doc_id, line
""")
def aligned_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the three texts of one length of each line of whole documents: words, those in the font of moves, and notes; fonts go by the place of words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    font = F.when((F.col("word_no") + F.col("doc_id")) % 5 < 2, "M").when((F.col("word_no") + F.col("doc_id")) % 5 == 2, "N").otherwise("B")
    words = d.select("doc_id", "line", F.posexplode(F.split("l", " ")).alias("word_no", "text")).withColumn("font", font)
    roles = words.select("font").distinct().select("font", F.when(F.col("font") == "M", "moves").when(F.col("font") == "N", "other").otherwise("body").alias("role"))
    out = layout.buffers(layout.word_classes(words, roles), ["doc_id", "line"])
    return out.select("doc_id", "line", *[F.md5(n).alias(n) for n in ("original", "main_text", "note_text")])


_KEPT = "SELECT key FROM now{n} WHERE NOT auto UNION ALL SELECT a.key FROM now{n} a WHERE a.auto AND a.value IN (SELECT key FROM now{n})"


@query("WITH now0 AS (SELECT event_id AS key, event_id - 7 AS value, event_id % 11 > 0 AS auto FROM events WHERE event_id % 13 > 0)" + "".join(f", now{n + 1} AS (SELECT * FROM now0 WHERE key IN ({_KEPT.format(n=n)}))" for n in range(3)) + " SELECT key, auto FROM now3")
def settled_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic corrections stay as long as the one they stand on does, three rounds at most; a reader's stay."""
    k = F.col("event_id")
    fixes = table(spark, sf_dir, "events").where("event_id % 13 > 0").select(k.alias("key"), (k - 7).alias("value"), (k % 11 > 0).alias("auto"))
    holds = lambda auto, now: auto.join(now.select(F.col("key").alias("value")), "value", "left_semi").select(*fixes.columns)
    return corrections.settled(fixes, holds, beside=True).select("key", "auto")


# boxes of a page: one across, then one to three columns of rows, the columns a little lower each, and one across below
_BOXES = """SELECT page_id AS page, j AS id, CASE WHEN j IN (0, n) THEN 0 ELSE 100 * ((j - 1) % c) END AS x0, CASE WHEN j IN (0, n) THEN 100 * c - 10 ELSE 100 * ((j - 1) % c) + 90 END AS x1,
  CASE j WHEN 0 THEN 0 WHEN n THEN 500 ELSE 20 + 12 * ((j - 1) // c) + 4 * ((j - 1) % c) END AS y0, CASE j WHEN 0 THEN 10 WHEN n THEN 510 ELSE 30 + 12 * ((j - 1) // c) + 4 * ((j - 1) % c) END AS y1
  FROM (SELECT page_id, 1 + page_id % 3 AS c, unnest(range(0, 12 + page_id % 9)) AS j, 11 + page_id % 9 AS n FROM pages)"""


def _cuts(rounds: int) -> str:
    out = f"r0 AS (SELECT *, []::BIGINT[] AS region FROM ({_BOXES}))"
    for r in range(rounds):
        low, high, gap = ("y0", "y1", 1) if r % 2 == 0 else ("x0", "x1", 5)
        out += f""",
t{r} AS (SELECT *, CASE WHEN {low} > max({high}) OVER (PARTITION BY page, region ORDER BY {low}, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS opens FROM r{r}),
r{r + 1} AS (SELECT * EXCLUDE (region, opens), list_append(region, CAST(sum(opens) OVER (PARTITION BY page, region ORDER BY {low}, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)) AS region FROM t{r})"""
    return out


@query(f"WITH {_cuts(6)} SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY region, y0, x0, id) AS place FROM r6")
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of boxes made for each page, in one to three columns between two that go across, by recursive cuts."""
    page, j = F.col("page_id"), F.col("id")
    c, n = 1 + page % 3, 11 + page % 9
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("id"))
    wide, col, row = (j == 0) | (j == n), (j - 1) % c, F.floor((j - 1) / c)
    y0 = F.when(j == 0, 0).when(j == n, 500).otherwise(20 + 12 * row + 4 * col)
    boxes = rows.select(page.alias("page"), "id", F.when(wide, 0).otherwise(100 * col).alias("x0"), F.when(wide, 100 * c - 10).otherwise(100 * col + 90).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"))
    return layout.cut_order(boxes, "page", "id", across=5, down=1).select("page", "id", F.col("place").cast("long").alias("place"))


@query("""
WITH RECURSIVE c AS (SELECT o_orderpriority AS a, c_mktsegment AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
p AS (SELECT a, b, n FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS total FROM c) WHERE n >= 5 AND n >= 0.19 * total), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, a, b) AS k FROM p),
g AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS used_a, []::VARCHAR[] AS used_b, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::BIGINT AS n
  UNION ALL SELECT o.k, CASE WHEN list_contains(used_a, o.a) OR list_contains(used_b, o.b) THEN used_a ELSE list_append(used_a, o.a) END, CASE WHEN list_contains(used_a, o.a) OR list_contains(used_b, o.b) THEN used_b ELSE list_append(used_b, o.b) END,
    CASE WHEN list_contains(used_a, o.a) OR list_contains(used_b, o.b) THEN NULL ELSE o.a END, o.b, o.n FROM g JOIN o ON o.k = g.k + 1)
SELECT a, b, n FROM g WHERE a IS NOT NULL
""")
def learnt_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each symbol stands for: values with enough uses and a large enough share of their symbol, then one to one by falling support."""
    o, c = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    seen = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderpriority").alias("a"), F.col("c_mktsegment").alias("b"))
    return aggregates.learnt_code(seen, "a", "b", 0.19, 5)


_MOVE = layout.MOVE_WORD
_SHOWN = """SELECT doc_id AS page, k AS line_no, 12 * k AS y0, 12 * k + 10 AS y1, 50 * (k % 5) AS x0, 50 * (k % 5) + 80 AS x1, CASE WHEN (doc_id + 2 * k) % 13 = 0 THEN 'H' ELSE 'B' END AS font,
  CASE (doc_id + k) % 9 WHEN 0 THEN '1.e4 e5 2.Nf3 Nc6' WHEN 1 THEN 'a b c d' WHEN 2 THEN 'Smith - Jones, London' WHEN 3 THEN ' ' WHEN 4 THEN CAST(k % 200 AS VARCHAR) WHEN 5 THEN 'and so - he thought' ELSE t END AS text
  FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


@query(f"""
WITH l AS ({_SHOWN}),
c AS (SELECT *, [w FOR w IN string_split(text, ' ') IF w <> ''] AS w, page % 2 = 0 AND (x0 + x1) / 2.0 BETWEEN 75 AND 225 AS beside FROM l),
m AS (SELECT *, len(w) AS n, len([x FOR x IN w IF regexp_matches(x, '{_MOVE}')]) AS moves, len([x FOR x IN w IF regexp_matches(x, '{layout.COORDINATE_WORD}')]) AS coords FROM c),
r AS (SELECT *, CASE WHEN y1 <= 10 OR y0 >= 2400 THEN 'head' WHEN trim(text) = '' THEN 'blank'
  WHEN beside AND (120 - y1 BETWEEN -2 AND 90 OR y0 - 168 BETWEEN -2 AND 30) AND regexp_matches(trim(text), '{layout.LABEL}') THEN 'label'
  WHEN beside AND (120 - y1 BETWEEN -2 AND 14 OR y0 - 168 BETWEEN -2 AND 14) AND n <= 8 AND moves = 0 AND coords < n THEN 'caption'
  WHEN coords = n THEN 'coord' WHEN regexp_matches(text, '{layout.GAME_HEADER}') AND n <= 12 AND moves = 0 THEN 'game_header' WHEN font = 'H' THEN 'heading' WHEN moves > 0.5 * n THEN 'moves' ELSE 'text' END AS role FROM m),
b AS (SELECT *, lag(role) OVER (PARTITION BY page ORDER BY line_no) AS before FROM r)
SELECT page, line_no, CASE WHEN role = 'game_header' AND regexp_matches(text, '^[a-z]') AND before = 'text' THEN 'text' ELSE role END AS role FROM b
""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all lines of whole documents, some of them made moves, coordinates, headers, blanks and labels, with a picture on every other page."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    page, k = F.col("page"), F.col("line_no")
    c = (page + k) % 9
    text = F.when(c == 0, "1.e4 e5 2.Nf3 Nc6").when(c == 1, "a b c d").when(c == 2, "Smith - Jones, London").when(c == 3, " ").when(c == 4, (k % 200).cast("string")).when(c == 5, "and so - he thought").otherwise(F.col("t"))
    lines = d.select("page", "line_no", (12 * k).alias("y0"), (12 * k + 10).alias("y1"), (50 * (k % 5)).alias("x0"), (50 * (k % 5) + 80).alias("x1"), F.when((page + 2 * k) % 13 == 0, "H").otherwise("B").alias("font"), F.lit(10.0).alias("size"), text.alias("text"))
    roles = layout.font_profiles(lines).select("font", "size", F.when(F.col("font") == "H", "heading").otherwise("body").alias("role"))
    pictures = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("page"), F.lit(100).alias("x0"), F.lit(120).alias("y0"), F.lit(200).alias("x1"), F.lit(168).alias("y1"))
    return layout.line_roles(lines, roles, 10.0, 2400.0, pictures).select("page", "line_no", "role")


@query("""
WITH RECURSIVE p AS (SELECT page_id AS page, page_id * 10 + j AS picture, 100 * j + page_id % 7 AS x0, 100 * j + 60 AS x1, 100 + 150 * (j % 2) AS y0, 160 + 150 * (j % 2) AS y1 FROM pages, range(0, 4) g(j)),
l AS (SELECT page_id AS page, page_id * 10 + j AS label, 100 * (j % 4) + (page_id * 3 + j) % 50 AS x0, 100 * (j % 4) + (page_id * 3 + j) % 50 + 10 AS x1, 40 + (page_id * 11 + j * 37) % 330 AS y0, 50 + (page_id * 11 + j * 37) % 330 AS y1 FROM pages, range(0, 6) g(j)),
n AS (SELECT picture, label, CASE WHEN p.y0 - l.y1 BETWEEN -2 AND 90 THEN p.y0 - l.y1 WHEN l.y0 - p.y1 BETWEEN -2 AND 30 THEN 90 + l.y0 - p.y1 END AS d FROM p JOIN l ON p.page = l.page AND (l.x0 + l.x1) / 2.0 BETWEEN p.x0 - 25 AND p.x1 + 25),
o AS (SELECT picture, label, d, row_number() OVER (ORDER BY d, picture, label) AS k FROM n WHERE d IS NOT NULL),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used_a, []::BIGINT[] AS used_b, NULL::BIGINT AS picture, NULL::BIGINT AS label, NULL::BIGINT AS d
  UNION ALL SELECT o.k, CASE WHEN list_contains(used_a, o.picture) OR list_contains(used_b, o.label) THEN used_a ELSE list_append(used_a, o.picture) END, CASE WHEN list_contains(used_a, o.picture) OR list_contains(used_b, o.label) THEN used_b ELSE list_append(used_b, o.label) END,
    CASE WHEN list_contains(used_a, o.picture) OR list_contains(used_b, o.label) THEN NULL ELSE o.picture END, o.label, o.d FROM g JOIN o ON o.k = g.k + 1)
SELECT picture, label, CAST(d AS DOUBLE) AS distance FROM g WHERE picture IS NOT NULL
""")
def picture_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pictures and six labels made for each page: the nearest pairs first, each picture and each label once."""
    t, page = table(spark, sf_dir, "pages"), F.col("page_id")
    j = F.col("j")
    rows = lambda n: t.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("j"))
    pictures = rows(4).select(page.alias("page"), (page * 10 + j).alias("id"), (100 * j + page % 7).alias("x0"), (100 * j + 60).alias("x1"), (100 + 150 * (j % 2)).alias("y0"), (160 + 150 * (j % 2)).alias("y1"))
    x, y = 100 * (j % 4) + (page * 3 + j) % 50, 40 + (page * 11 + j * 37) % 330
    labels = rows(6).select(page.alias("page"), (page * 10 + j).alias("id"), x.alias("x0"), (x + 10).alias("x1"), y.alias("y0"), (y + 10).alias("y1"))
    return layout.labelled(pictures, labels).select("picture", "label", F.col("distance").cast("double").alias("distance"))


@query("""
WITH e AS (SELECT event_id % 7 AS book, user_id AS line, event_id AS pos, event_id // 60 AS page, event_id % 23 AS ply, event_type FROM events),
ends AS (SELECT book, line, max(pos) AS pos, max(pos) // 60 AS page, max(pos) % 23 AS ply FROM e WHERE event_type = 'error' AND pos < 9000 GROUP BY book, line),
c AS (SELECT a.book, a.line, a.pos AS ends, b.line AS from_line, b.pos AS "at", b.ply - a.ply AS gap FROM ends a JOIN e b ON b.event_type = 'click' AND a.book = b.book AND b.page BETWEEN a.page AND a.page + 2 AND b.pos > a.pos AND b.line <> a.line AND b.ply - a.ply BETWEEN 0 AND 4)
SELECT book, line, arg_min(from_line, "at") AS from_line, min("at") AS "at", arg_min(gap, "at") AS gap FROM c GROUP BY book, line
""")
def next_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a branch's end: the first click of another user after a user's last error before event 9000, no more than four plies and two pages on."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select((k % 7).alias("book"), F.col("user_id").alias("line"), k.alias("offset"), F.floor(k / 60).alias("page"), (k % 23).alias("ply"), "event_type")
    printed = e.where("event_type = 'click'").drop("event_type").withColumn("moves", F.array(F.col("ply").cast("string")))
    last = e.where("event_type = 'error' and offset < 9000").groupBy("book", "line").agg(F.max("offset").alias("offset"))
    ends = last.select("book", "line", "offset", F.floor(F.col("offset") / 60).alias("page"), (F.col("offset") % 23).alias("ply"))
    return reading.suggestions(ends, printed).select("book", "line", "from_line", "at", "gap")


# ---- names of drawings

_LETTERS = "KQRBN"


@query(f"""
WITH g AS (SELECT vec_id, label, [c::DOUBLE FOR c IN embedding[1:4]] AS x, 1 + vec_id % 5 AS c1, 1 + vec_id * 7 % 5 AS c2, vec_id % 3 + 1 AS n FROM embeddings),
w AS (SELECT a.vec_id, a.label, exp(-((a.x[1] - b.x[1]) ** 2 + (a.x[2] - b.x[2]) ** 2 + (a.x[3] - b.x[3]) ** 2 + (a.x[4] - b.x[4]) ** 2) / (2 * 0.04 ** 2)) AS k, b.c1, b.c2, b.n FROM g a JOIN g b ON a.label = b.label),
s AS (SELECT vec_id, label, c, sum(CASE WHEN c2 = c THEN k WHEN c1 = c THEN k * n ELSE 0 END) AS s FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS c) GROUP BY ALL),
t AS (SELECT *, max(s) OVER (PARTITION BY vec_id) AS top FROM s)
SELECT vec_id, '{_LETTERS}'[arg_min(c, CASE WHEN s = top THEN c ELSE 9 END)] AS name, round(1 / sum(pow(4, s - top)), 6) AS confidence FROM t GROUP BY vec_id
""")
def smoothed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a group of its label, with votes for two letters, named by the votes of all near ones."""
    k = F.col("vec_id")
    letter = lambda n: F.substr(F.lit(_LETTERS), (1 + n % 5).cast("int"), F.lit(1))
    votes = F.map_concat(F.map_from_arrays(F.array(letter(k * 7)), F.array(F.lit(1).cast("long"))), F.when(k % 5 == k * 7 % 5, F.create_map().cast("map<string,bigint>")).otherwise(F.map_from_arrays(F.array(letter(k)), F.array(k % 3 + 1))))
    groups = table(spark, sf_dir, "embeddings").select("label", k.alias("group"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("centre"), votes.alias("votes"))
    return inference.smoothed_votes(groups, "label", 0.04, faint=1e-12).select(F.col("group").alias("vec_id"), "name", F.round("confidence", 6).alias("confidence"))


@query()
def names_under_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the groups of drawings on boards made of vectors: each label is a book, eight vectors a board, vectors of one remainder a group; no single change is better."""
    e = table(spark, sf_dir, "embeddings")
    cost = lambda k: F.abs(F.get("embedding", F.lit(k)).cast("double")) * 10
    names = "KQRBNPkqrbnp"
    rows = e.select("label", "vec_id", F.floor(F.col("vec_id") / 40).alias("board"), (F.col("vec_id") % 37).alias("group"), F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[cost(k) for k in range(len(names))])).alias("costs"))
    one = rows.groupBy("label", "group").agg(F.min_by("costs", "vec_id").alias("costs"))
    return inference.constrained_names(rows.drop("costs").join(one, ["label", "group"]), "label")


_MASK = "SELECT vec_id, [CASE WHEN c > 0 THEN 1 ELSE 0 END FOR c IN embedding] || [CASE WHEN abs(c::DOUBLE) > 0.1 THEN 1 ELSE 0 END FOR c IN embedding] AS m FROM embeddings"


@query(f"""
WITH m AS ({_MASK}),
q AS (SELECT a.vec_id, b.vec_id AS other, list_sum([CASE WHEN a.m[i] + b.m[i] = 2 THEN 1 ELSE 0 END FOR i IN range(1, 129)]) AS inter, list_sum([CASE WHEN a.m[i] + b.m[i] > 0 THEN 1 ELSE 0 END FOR i IN range(1, 129)]) AS either FROM m a JOIN m b ON a.vec_id % 10 = 0 AND b.vec_id % 10 > 0)
SELECT vec_id, other, round(inter / either, 9) AS iou FROM q WHERE inter >= 0.4 * either
""")
def overlapping_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of every tenth vector with those of the others that overlap them by two fifths or more: signs and sizes of components as 128 packed bits."""
    e = table(spark, sf_dir, "embeddings")
    bits = F.concat(F.transform("embedding", lambda c: c > 0), F.transform("embedding", lambda c: F.abs(c.cast("double")) > 0.1))
    masks = e.select(F.col("vec_id").alias("id"), inference.packed(bits).alias("mask"))
    found = inference.overlapping_masks(masks.where("id % 10 = 0"), masks.where("id % 10 > 0"), 0.4)
    return found.select(F.col("id").alias("vec_id"), "other", F.round("iou", 9).alias("iou"))


# ---- edit scripts and steps

_LINES = "(SELECT source AS book, CAST(doc_id AS VARCHAR) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"


@query(f"""
WITH b AS (SELECT *, CAST(line AS BIGINT) % 6 AS c, max(pos) OVER (PARTITION BY line) AS n FROM {_LINES}),
out AS (
  SELECT book, line, line AS of, pos, NULL AS "row", pos AS o FROM b WHERE book NOT IN ('src1', 'src3') OR c = 5 OR (c = 0 AND pos < 3) OR (c = 1 AND NOT pos BETWEEN 2 AND 3) OR c IN (2, 3)
  UNION ALL SELECT book, line || 'n', line, pos, NULL, pos FROM b WHERE book IN ('src1', 'src3') AND c = 0 AND pos >= 3
  UNION ALL SELECT book, line, line, pos, NULL, CASE WHEN pos = 1 THEN n + 1 ELSE pos END FROM b WHERE book IN ('src1', 'src3') AND c = 4
  UNION ALL SELECT DISTINCT book, line, NULL, NULL::BIGINT, 'new ' || line, 1.5 FROM b WHERE book IN ('src1', 'src3') AND c = 3 AND n >= 2)
SELECT book, line, row_number() OVER (PARTITION BY book, line ORDER BY o) AS place, of, pos, "row" FROM out
""")
def edited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two sources' documents under a script: some are split, some lose rows, some are split and joined again, some have a row added, some have their first row moved twice; the last entry counts. Other sources are as they were."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").cast("string").alias("line"), F.size(F.split("text", "\n")).alias("n"), "doc_id")
    base = d.select("book", "line", F.explode(F.sequence(F.lit(1), "n")).alias("pos"))
    none, c, own = F.lit(None), F.col("doc_id") % 6, F.col("line")

    def entry(k: int, op: str, **given) -> F.Column:
        kinds = {"at": "long", "until": "long", "before": "long"}
        return F.struct((F.col("doc_id") * 4 + k).alias("seq"), F.lit(op).alias("op"), *[given.get(n, none).cast(kinds.get(n, "string")).alias(n) for n in scripts.ENTRY[1:]])

    new = F.concat("line", F.lit("n"))
    told = {
        0: [entry(0, "split", line=own, of=own, at=F.lit(3), to=new)],
        1: [entry(0, "remove", of=own, at=F.lit(2), until=F.lit(4))],
        2: [entry(0, "split", line=own, of=own, at=F.lit(2), to=new), entry(1, "join", line=new, to=own)],
        3: [entry(0, "add", line=own, before_of=own, before=F.lit(2), row=F.concat(F.lit("new "), own))],
        4: [entry(0, "move", of=own, at=F.lit(1), until=F.lit(2), line=own, before_of=own, before=F.lit(3)), entry(1, "move", of=own, at=F.lit(1), until=F.lit(2), line=own)],
    }
    script = None
    for k, entries in told.items():
        part = d.where(F.col("book").isin("src1", "src3") & (c == k) & ((F.lit(k) != 3) | (F.col("n") >= 2)) & ((F.lit(k) != 0) | (F.col("n") >= 3)) & ((F.lit(k) != 2) | (F.col("n") >= 2)))
        part = part.select("book", F.explode(F.array(*entries)).alias("e")).select("book", "e.*")
        script = part if script is None else script.unionByName(part)
    return scripts.derived(base, script)


@query("SELECT event_id % 4 AS step, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users, max(event_id) AS last FROM events GROUP BY 1")
def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch of a stream over four files of events told while it ran."""
    path = f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    for k in range(4):
        events.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    measures = {"n": F.count("*"), "users": F.sum("user_id"), "last": F.max("event_id")}
    start = lambda s: s.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/progress").format("parquet").option("path", f"{path}/out").start()
    told = [(e["step"], e["n"], e["users"], e["last"]) for e in steps.stepped(streams.files(spark, f"{path}/in"), "step", measures, start)]
    return spark.createDataFrame(told, "step long, n long, users long, last long")


# ---- files

@query("SELECT user_id, event_id % 3 AS game, 'e' || (event_id % 8 + 1) AS moves FROM events")
def game_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A game a event, written as a few files of games and read back in parts that are cut at games."""
    path = f"{shared_folder(spark)}/games-{uuid.uuid4().hex}"
    k = F.col("event_id")
    text = F.concat(F.lit('[Event "'), (k % 3).cast("string"), F.lit('"]\n[White "'), F.col("user_id").cast("string"), F.lit('"]\n\n'), F.concat(F.lit("e"), (k % 8 + 1).cast("string")), F.lit("\n"))
    table(spark, sf_dir, "events").select(text.alias("value")).coalesce(2).write.text(path)
    g = gamefiles.read(spark, path, "tags map<string,string>, moves string", split=64 << 10)
    return g.select(F.col("tags")["White"].cast("long").alias("user_id"), F.col("tags")["Event"].cast("long").alias("game"), F.trim(F.regexp_replace("moves", r"\s+", " ")).alias("moves"))


@query("SELECT n_name AS title, 'c' || c_custkey % 3 AS chapter, 'l' || c_custkey AS line, c_mktsegment AS san FROM customer JOIN nation ON c_nationkey = n_nationkey")
def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book a nation, a line and a node a customer, written as JSON and read with a fixed schema."""
    path = f"{shared_folder(spark)}/books-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.concat(F.lit("l"), "c_custkey")
    lines = F.collect_list(F.struct(line.alias("id"), F.concat(F.lit("c"), F.col("c_custkey") % 3).alias("chapter"))).alias("lines")
    nodes = F.collect_list(F.struct(F.concat(F.lit("n"), "c_custkey").alias("id"), line.alias("line"), F.col("c_mktsegment").alias("san"), F.lit(1).alias("more"))).alias("nodes")
    c.groupBy(F.col("n_name").alias("title")).agg(lines, nodes).write.option("maxRecordsPerFile", 1).json(path)
    b = tables.books(spark, path)
    n = b.select("title", F.explode("nodes").alias("n")).select("title", F.col("n.line").alias("line"), F.col("n.san").alias("san"))
    of = b.select("title", F.explode("lines").alias("l")).select("title", F.col("l.id").alias("line"), F.col("l.chapter").alias("chapter"))
    return n.join(of, ["title", "line"]).select("title", "chapter", "line", "san")


@query(r"""
WITH l AS (SELECT doc_id AS page, 2 * generate_subscripts(s, 1) AS n, unnest(s) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
a AS (SELECT page, n, t FROM l UNION ALL SELECT page, n + 1, CASE (page + n) % 5 WHEN 0 THEN CAST((page + n) % 300 AS VARCHAR) WHEN 1 THEN 'see Diagrams ' || (page % 90) || ' and exercise ' || (n % 70) || '.' || (page % 9 + 1) || ' again' ELSE '' END FROM l)
SELECT page, coalesce(string_agg(CASE WHEN regexp_matches(trim(t), '^(?:[0-9]{1,3}(?:\.[0-9]{1,3})?[a-d]?)$') THEN trim(t) END, ',' ORDER BY n), '') AS labels,
  coalesce(string_agg(nullif(array_to_string(regexp_extract_all(t, '(?i)\b(?:diagrams?|positions?|exercises?) +([0-9]{1,3}(?:\.[0-9]{1,3})?)', 1), ','), ''), ',' ORDER BY n), '') AS refs FROM a GROUP BY page
""")
def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages hold: labels that stand alone and references of the text, over whole documents with a line of either kind after some of their lines, written as an extractor's lines and read back."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    page, n = F.col("page"), F.col("line_no")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("page"), F.posexplode(F.split("text", "\n")).alias("k", "text")).select("page", (2 * (F.col("k") + 1)).alias("line_no"), "text")
    c = (page + n) % 5
    more = F.when(c == 0, ((page + n) % 300).cast("string")).when(c == 1, F.concat(F.lit("see Diagrams "), page % 90, F.lit(" and exercise "), n % 70, F.lit("."), page % 9 + 1, F.lit(" again"))).otherwise("")
    d.unionByName(d.select("page", (n + 1).alias("line_no"), more.alias("text"))).write.parquet(path)
    out = pages.inspected(pages.lines(spark, path))
    return out.select("page", F.array_join("labels", ",").alias("labels"), F.array_join("refs", ",").alias("refs"))
