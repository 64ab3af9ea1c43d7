"""Order-dependent operators: islands, merged ranges, runs within an array, conditions along paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Number the stretches of each group; `breaks` may use lag() over `window(by, order)` and starts a stretch where true."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_b", F.when(breaks, 1).otherwise(0)).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def gap_sessions(df: DataFrame, by: list[str], at: str, ties: list[str], gap_seconds: int, cell: Callable[[Column], Column], name: str = "island") -> DataFrame:
    """Number the stretches of each group that gaps of over `gap_seconds` divide. Windows span one cell of a group (a day, say); what passes
    from cell to cell, the last time and the number of gaps so far, goes along a summary with a row a cell, so a group of any share of the rows is spread over its cells."""
    rows = df.withColumn("_cell", cell(F.col(at)))
    over = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) > gap_seconds * 1_000_000
    along = Window.partitionBy(*by).orderBy("_cell")
    ends = rows.groupBy(*by, "_cell").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    opens = ends.select(*by, "_cell", F.coalesce(over(F.lag("_last").over(along), F.col("_first")), F.lit(False)).alias("_opens"))
    inside = Window.partitionBy(*by, "_cell").orderBy(at, *ties)
    broken = rows.join(opens, [*by, "_cell"]).withColumn("_b", F.when(F.lag(at).over(inside).isNull(), F.col("_opens")).otherwise(over(F.lag(at).over(inside), F.col(at))).cast("int"))
    local = broken.withColumn("_n", F.sum("_b").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    counts = local.groupBy(*by, "_cell").agg(F.sum("_b").alias("_s"))
    before = counts.select(*by, "_cell", F.coalesce(F.sum("_s").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(before, [*by, "_cell"]).select(*df.columns, (F.col("_before") + F.col("_n")).alias(name))


def window(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """All columns and each row's number (from 1) within its group."""
    return df.withColumn(name, F.row_number().over(window(by, order)))


def merged_ranges(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Closed integer ranges of each group, merged where they touch or overlap."""
    df = df.select(*by, start, end).distinct()  # equal ranges would have no order
    w = Window.partitionBy(*by).orderBy(start, end)
    top = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = df.withColumn("_new", F.when(F.col(start) <= top + 1, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def run_starts(numbers: Column) -> Column:
    """Places in an array of numbers where a run starts: the number neither repeats the one before nor follows it. Within the row: no shuffle."""
    at = F.sequence(F.lit(0), F.size(numbers) - 1)
    starts = F.filter(at, lambda i: (i == 0) | ~((F.get(numbers, i) == F.get(numbers, i - 1)) | (F.get(numbers, i) == F.get(numbers, i - 1) + 1)))
    return F.when(F.size(numbers) > 0, starts).otherwise(F.array().cast("array<int>"))


def renumbered(df: DataFrame, run: str, order: str, number: str, black: str) -> DataFrame:
    """Tokens of runs numbered anew from the first one's number and side: a ply each. Places come from one sort of all runs, so that no run is one task; the rows of a null run are one."""
    from .paths import placed_within

    numbered_rows = placed_within(df, [run], [order], "_place")
    firsts = df.groupBy(F.col(run).alias("_run")).agg(F.min_by(F.struct(F.col(number).alias("n"), F.col(black).alias("b")), order).alias("_f"))
    ply = 2 * (F.col("_f.n") - 1) + F.col("_f.b").cast("int") + F.col("_place") - 1
    return numbered_rows.join(firsts, F.col(run).eqNullSafe(F.col("_run"))).withColumns({"_ply": ply}).select(*[c for c in df.columns if c not in (number, black)], (F.floor(F.col("_ply") / 2) + 1).cast("int").alias(number), (F.col("_ply") % 2 == 1).alias(black))


def review_rank(df: DataFrame, by: list[str], page: str, kind: str, y: str, key: str) -> DataFrame:
    """Findings of each group in the order in which they are looked at: by page, kind of finding and height. One sort of all findings, so that no group is one task."""
    from .paths import placed_within

    return placed_within(df, by, [page, kind, y, key])


def resolve_ambiguous(values: Column) -> Column:
    """From an ordered array of arrays of possible values, one value each: that which follows the value before most closely, else the first."""

    def step(acc: Column, options: Column) -> Column:
        last = F.element_at(acc, -1)
        after = F.filter(options, lambda x: x > last)
        chosen = F.coalesce(F.when(F.size(acc) > 0, F.array_min(after)), F.get(options, 0))
        return F.concat(acc, F.array(chosen))

    return F.aggregate(values, F.array().cast("array<int>"), step)


def path_all(nodes: DataFrame, node: str, parent: str, ok: str, rounds: int = 40) -> DataFrame:
    """Whether a node and all its ancestors are ok. Ancestors double each round (pointer jumping), so a path of n nodes takes log2(n) joins."""
    from .materialise import handed_on

    now = nodes.select(F.col(node).alias("n"), F.col(parent).alias("up"), F.col(ok).alias("good"))
    for _ in range(rounds):
        up = now.select(F.col("n").alias("_n"), F.col("up").alias("_up"), F.col("good").alias("_good"))
        joined = now.join(up, now.up == up._n, "left")
        now = handed_on(joined.select("n", F.col("_up").alias("up"), (F.col("good") & F.coalesce("_good", F.lit(True))).alias("good")))
        if now.where("up is not null").isEmpty():
            return now.select(F.col("n").alias(node), F.col("good").alias("path_ok"))
    raise RuntimeError("a path is longer than the rounds allow, or has a cycle")


def kept_recent(df: DataFrame, by: list[str], at: list[Column], most: int) -> DataFrame:
    """The most recent rows of each group: eviction of the least recently used. A limit on a rank, which Spark applies in every task before rows are dealt by group: no group's rows meet, only `most` of each task's."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*at))).where(F.col("_rn") <= most).drop("_rn")
