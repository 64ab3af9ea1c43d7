"""Numbers and brackets of whole texts: numbered runs and bracket depth with expiry, from windows over cells of a text.

A text is cut into slices by code points, each of which owns the tokens that start in it; a text of any length is so many rows, spread over tasks. What a token needs of those before it, the token before, sums
and least sums, comes from a window over its cell and from a summary with a row a cell, so a text of any share of all rows is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .materialise import cut

#: Code points of a slice, and of the larger pieces that are cut first, so that each code point of a text is passed over a few times only.
SLICE, PIECE = 1 << 12, 1 << 18
#: Digits of a number at most; how long a bracket stays open, in code points.
DIGITS, LIVES = 3, {"(": 600, "[": 3000, "{": 600}
#: Code points that a slice shows behind its own, enough to tell that digits are too many.
BEHIND = DIGITS + 1
CLOSES = {")": "(", "]": "[", "}": "{"}


def tokens(docs: DataFrame, doc: str, text: str, size: int = SLICE, piece: int = PIECE) -> DataFrame:
    """doc, cell, at (code points before it), raw, kind (number, open, close), value: the numbers of up to DIGITS digits and all brackets. Longer digit rows, null and empty texts have no tokens."""
    length = F.length(text)
    rows = docs.where(length > 0).select(F.col(doc).alias("doc"), F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0).cast("long"), (length - 1).cast("long"), F.lit(piece).cast("long"))).alias("_p"))
    # a piece and a slice begin one code point early, which tells whether digits go on from before
    early = lambda start: F.least(start, F.lit(1))
    cutout = lambda t, start, most: F.substring(t, (start - early(start) + 1).cast("int"), (early(start) + most + BEHIND).cast("int"))
    rows = rows.select("doc", "_p", early(F.col("_p")).alias("_e"), cutout(F.col("_t"), F.col("_p"), F.lit(piece)).alias("_t"))
    inner = F.length("_t") - F.col("_e")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.least(inner, F.lit(piece)) - 1, F.lit(0)).cast("long"), F.lit(size).cast("long"))
    rows = rows.select("doc", "_p", "_e", "_t", F.explode(starts).alias("_s"))
    begin = F.col("_s") + F.col("_e")
    rows = rows.select("doc", (F.col("_p") + F.col("_s")).alias("_at"), early(begin).alias("_e"), F.substring("_t", (begin - early(begin) + 1).cast("int"), (early(begin) + size + BEHIND).cast("int")).alias("_t"))
    parts = F.regexp_extract_all("_t", F.lit(r"([0-9]+|[()\[\]{}]|[^0-9()\[\]{}]+)"), 1)
    seen = F.posexplode(parts).alias("_k", "raw")
    rows = rows.select("doc", "_at", "_e", seen)
    offset = F.coalesce(F.sum(F.length("raw")).over(Window.partitionBy("doc", "_at").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_e")
    rows = rows.withColumn("_o", offset).where((F.col("_o") >= 0) & (F.col("_o") < size) & F.col("raw").rlike(rf"^([0-9]{{1,{DIGITS}}}|[()\[\]{{}}])$"))
    kind = F.when(F.col("raw").isin(*LIVES), "open").when(F.col("raw").isin(*CLOSES), "close").otherwise("number")
    return rows.select("doc", (F.col("_at") / size).cast("long").alias("cell"), (F.col("_at") + F.col("_o")).alias("at"), "raw", kind.alias("kind"), F.when(F.col("raw").rlike("^[0-9]"), F.col("raw").cast("int")).alias("value"))


def carried(rows: DataFrame, name: str, own: Column, summary: Column, before: Column, value: Column) -> DataFrame:
    """rows (doc, cell, at) with a column that goes on from cell to cell: `own` is a window expression within the cell, `summary` an aggregate of a cell, `before` an aggregate of the summaries `_s` of the
    text's cells before, and `value` what becomes of `_own` and `_before`."""
    cells = rows.groupBy("doc", "cell").agg(summary.alias("_s"))
    earlier = Window.partitionBy("doc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("doc").alias("_d"), F.col("cell").alias("_c"), before.over(earlier).alias("_before"))
    both = rows.withColumn("_own", own).join(cells, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("cell") == F.col("_c")))
    return both.select(*rows.columns, value.alias(name))


def _within() -> WindowSpec:
    return Window.partitionBy("doc", "cell").orderBy("at")


def _so_far() -> WindowSpec:
    return _within().rowsBetween(Window.unboundedPreceding, 0)


def summed(rows: DataFrame, name: str, x: Column) -> DataFrame:
    """The running sum of x along a text."""
    return carried(rows.withColumn("_x", x), name, F.sum("_x").over(_so_far()), F.sum("_x"), F.sum("_s"), F.coalesce("_before", F.lit(0)) + F.col("_own")).drop("_x")


def previous(rows: DataFrame, name: str, x: Column) -> DataFrame:
    """x of the token before along a text; x must not be null. Null for the first."""
    return carried(rows.withColumn("_x", x), name, F.lag("_x").over(_within()), F.max_by("_x", "at"), F.last("_s"), F.coalesce("_own", "_before")).drop("_x")


def depths(rows: DataFrame, size: int = SLICE, lives: dict[str, int] | None = None) -> DataFrame:
    """tokens with `depth`: the brackets that are open before each. A bracket is open until the close of its kind that matches it, or until it is older than its life; a close without an open is nothing.

    For one kind let w be the number of unmatched opens after each token: the running sum of +1 and -1, less its least value so far where that is negative. Of the brackets unmatched before a token, those are older than a life that
    were unmatched at the last token before that time and ever since: as many as the least w from there on. So the depth is w less the least w within the life, a window over a range of code points;
    a cell sees the end of the cells before it as far as a life reaches, and no text is one window."""
    out = rows.withColumn("depth", F.lit(0))
    for sign, life in (lives or LIVES).items():
        close = next(c for c, o in CLOSES.items() if o == sign)
        now = summed(out, "_sum", F.when(F.col("raw") == sign, 1).when(F.col("raw") == close, -1).otherwise(0))
        now = carried(now, "_least", F.min("_sum").over(_so_far()), F.min("_sum"), F.min("_s"), F.least(F.lit(0), "_before", "_own"))
        now = previous(now.select(*out.columns, (F.col("_sum") - F.col("_least")).alias("_w")), "_w0", F.col("_w"))
        now = now.select(*out.columns, F.coalesce("_w0", F.lit(0)).alias("_w0"))
        cells = F.explode(F.sequence(F.col("cell"), F.col("cell") + F.lit(-(-life // size)))).alias("_for")
        seen = now.select("*", cells).where((F.col("_for") == F.col("cell")) | (F.col("at") >= F.col("_for") * size - life))
        low = F.min("_w0").over(Window.partitionBy("doc", "_for").orderBy("at").rangeBetween(-life, 0))
        found = seen.withColumn("depth", (F.col("depth") + F.col("_w0") - low).cast("int")).where(F.col("_for") == F.col("cell"))
        out = cut(found.select(*out.columns))
    return out


def numbered_runs(docs: DataFrame, doc: str, text: str, size: int = SLICE, piece: int = PIECE) -> DataFrame:
    """doc, start, stop, first, last, numbers, depth: the maximal runs of numbers in each text. A number goes on with the run before it if no bracket stands between them and it repeats the number before or is one or two more
    (one may be missing from the text). start and stop: code points before the first and the last number; depth: brackets open before the run.

    Ids are unique (rows of one id would be one text); a null id is a text; null and empty texts and an empty table give no runs; a text of any length is spread over its slices."""
    rows = depths(cut(tokens(docs, doc, text, size, piece)), size)
    told = previous(rows, "_last", F.coalesce("value", F.lit(-10)))
    starts = ~F.coalesce((F.col("value") - F.col("_last")).between(0, 2), F.lit(False))
    run = summed(told, "_run", starts.cast("int")).where("kind = 'number'")
    return run.groupBy("doc", "_run").agg(F.min("at").alias("start"), F.max("at").alias("stop"), F.min_by("value", "at").alias("first"), F.max_by("value", "at").alias("last"), F.count("*").alias("numbers"), F.min_by("depth", "at").alias("depth")).drop("_run")
