"""Line dedup by a log-template tree, in DataFrame operations only.

A line goes down a tree of fixed depth: first by its number of tokens, then by its leading tokens,
where a token with a digit is a variable field `<*>`. Its leaf keeps templates of the line: the line
with its variable fields generalised, and, for lines of at least `wide` tokens, four more in which
one quarter of the tokens after the leading ones is a single variable field. Two lines of a leaf
that differ within one such quarter thus share a template. A template found in at least `least`
documents recurs, and its lines are dropped from every document but the first that has it (the one
with the smallest id), so that no passage is lost altogether.

The tree is a table: a node of each depth is a column (n, the number of tokens; lead, a hash of the leading tokens), and a
template is a row under them, known by a 64-bit hash. Templates are the same only where all three agree, so two that differ
are taken for one with a chance of about 2**-96 a pair. They are counted by (template, document) first and by template next, each with
partial sums before the shuffle. The few templates that hold a large share of all lines are broadcast to them, fewer than
2,000 by their share; the others are joined, with those lines only that fall on a residue of a recurring template's hash:
the residues, `RESIDUES` at most, are broadcast, so that most lines are not shuffled for the join. So a template in any share of the documents makes no large task.

Edge cases: a null text stays null and has no lines; an empty text has one line without tokens;
lines of fewer than `shortest` tokens are always kept, and so are lines without tokens or
of one or two tokens that are nothing but variable fields; a line repeated within one document counts
once; repeated rows are treated alike; rows without an id count as one document that comes before
the others; an empty table gives an empty result; other columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, written

#: Documents that make a template recurring, least tokens of a line that may go and of one with quarters, leading tokens of the tree.
LEAST, SHORTEST, WIDE, DEPTH, QUARTERS = 5, 1, 10, 2, 4
#: Residues of hashes that sieve lines before the join; they change no result.
RESIDUES = 1 << 22
#: A token that has a digit; it is looked for at the starts of tokens only.
_VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
#: Lines that never go, whatever their number: no tokens, or one or two variable fields alone.
ALWAYS_KEPT = ("", "<*>", "<*> <*>")


def template(line: Column) -> Column:
    """The line with single spaces between tokens and variable fields generalised; most lines need no regular expression."""
    uneven = line.contains("  ") | line.contains("\t") | line.contains("\r")
    even = F.trim(F.when(uneven, F.regexp_replace(line, r"[ \t\r]+", " ")).otherwise(line))
    return F.when(even.rlike("[0-9]"), F.regexp_replace(even, _VARIABLE, "<*>")).otherwise(even)


def _row(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """The id, and half a hash of the text for rows that share an id."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63))), F.shiftright(F.xxhash64(text), 32).cast("int")


def leaves(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, wide: int = WIDE) -> DataFrame:
    """A row for each template of each line: n, lead, h (its place in the tree and hash), doc, mark (of the text) and pos."""
    doc, mark = _row(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    lines = docs.select(doc.alias("doc"), mark.alias("mark"), F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("pos", "line")).select("doc", "mark", "pos", template(F.col("line")).alias("t"))
    lines = lines.select("*", (F.octet_length("t") - F.octet_length(F.replace("t", F.lit(" "))) + 1).alias("n"))

    def quarter(k: int) -> Column:
        a, b = (DEPTH + F.floor((F.col("n") - DEPTH) * j / QUARTERS).cast("int") for j in (k, k + 1))
        return F.xxhash64("n", F.lit(k + 1), F.call_function("substring_index", "t", F.lit(" "), a), F.call_function("substring_index", "t", F.lit(" "), b - F.col("n")))

    whole = F.xxhash64("n", F.lit(0), "t")
    # no filter on what is made here: it would be pushed down and make it twice
    every = F.when(F.col("n") >= max(wide, shortest), F.array(whole, *[quarter(k) for k in range(QUARTERS)])).when((F.col("n") >= shortest) & ~F.col("t").isin(*ALWAYS_KEPT), F.array(whole))
    lead = F.hash(F.call_function("substring_index", "t", F.lit(" "), F.lit(DEPTH)))
    return lines.select("n", lead.alias("lead"), F.explode(every).alias("h"), "doc", "mark", "pos")


def recurring(found: DataFrame, least: int = LEAST) -> DataFrame:
    """Templates in at least `least` documents: n, lead, h, the first document and in how many it is."""
    each = found.groupBy("n", "lead", "h", "doc").agg(F.count("*").alias("times"))
    return each.groupBy("n", "lead", "h").agg(F.count("doc").alias("docs"), F.min("doc").alias("first"), F.sum("times").alias("times")).where(F.col("docs") >= least).select(F.struct("n", "lead", "h").alias("leaf"), "first", "times")


def sieved(found: DataFrame, again: DataFrame) -> DataFrame:
    """The rows whose hash has a residue that a recurring template's has: all lines of these, and few others."""
    some = again.select(F.pmod("leaf.h", F.lit(RESIDUES)).alias("residue")).distinct()
    return found.withColumn("residue", F.pmod("h", F.lit(RESIDUES))).join(F.broadcast(some), "residue", "left_semi").drop("residue")


def drops(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, shortest: int = SHORTEST, wide: int = WIDE) -> DataFrame:
    """doc, mark and the positions (from 0) of the lines that go."""
    found = written(leaves(docs, doc_id, text, shortest, wide))
    again = written(recurring(found, least))
    rows = sieved(found, again).select(F.struct("n", "lead", "h").alias("leaf"), "doc", "mark", "pos")
    gone = hot_join(rows, again, "leaf", "times").where("doc <> first")
    return gone.groupBy("doc", "mark").agg(F.collect_set("pos").alias("gone"))


def _joined(docs: DataFrame, doc_id: str, text: str, **kw) -> DataFrame:
    """The rows with columns by place (_0, _1, ...) and `gone`, so that any names may stand beside each other."""
    gone = drops(docs, doc_id, text, **kw).select(F.col("doc").alias("gone_doc"), F.col("mark").alias("gone_mark"), "gone")
    rows = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])
    doc, mark = _row(*(F.col(f"_{docs.columns.index(c)}") for c in (doc_id, text)))
    return rows.join(gone, (doc == F.col("gone_doc")) & (mark == F.col("gone_mark")), "left")


def _rest(text: str) -> Column:
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    return F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents with recurring lines dropped; all columns stay."""
    return _joined(docs, doc_id, text, **kw).select(*[(_rest(f"_{k}") if c == text else F.col(f"_{k}")).alias(c) for k, c in enumerate(docs.columns)])


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, kept_sha256 of the remaining text."""
    kept = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = _joined(kept, "doc_id", "text", **kw)
    return rows.select(
        F.col("_0").alias("doc_id"),
        F.coalesce(F.octet_length("_1") - F.octet_length(F.replace("_1", F.lit("\n"))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(_rest("_1"), F.lit("")), 256).alias("kept_sha256"),
    )
