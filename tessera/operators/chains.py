"""Greedy chains as successor pointers: each row points to the one that comes next if it is taken, and what is reached from a group's first row is found by jumping.

Nothing is walked in order: successors come from joins and windows over short keys, and pointers double each round, so a chain of n links takes
about log2(n) rounds and a group with any share of the rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialise import cut, handed_on
from .paths import placed


def same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    """Null-safe equality of columns of left and those of right named by it."""
    out = F.lit(True)
    for a, b in names.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def reached_from(starts: DataFrame, links: DataFrame, group: str, node: str, to: str, rounds: int = 64) -> DataFrame:
    """group and node of all that is reached from starts (group, node) along links (group, node, to; `to` null at an end).

    After k rounds the pointers are 2**k links long and what has been reached is all within 2**k links of a start. Raises if pointers go on for 2**rounds links (a cycle)."""
    found = cut(starts.select(group, node).distinct())
    jumps = cut(links.where(F.col(to).isNotNull()).select(F.col(group).alias("_g"), F.col(node).alias("_n"), F.col(to).alias("_t")))
    for _ in range(rounds):
        if jumps.isEmpty():
            return found
        more = found.join(jumps, found[group].eqNullSafe(jumps["_g"]) & (found[node] == jumps["_n"])).select(group, F.col("_t").alias(node))
        found = handed_on(found.unionByName(more).distinct())
        on = jumps.select(F.col("_g").alias("_h"), F.col("_n").alias("_m"), F.col("_t").alias("_u"))
        jumps = handed_on(jumps.join(on, jumps["_g"].eqNullSafe(on["_h"]) & (jumps["_t"] == on["_m"])).select("_g", "_n", F.col("_u").alias("_t")))
    raise RuntimeError("the links have a cycle")


def next_above(points: DataFrame, group: str, value: str, above: Column, width: float, name: str = "next") -> DataFrame:
    """points (group, value, distinct) and the smallest value of the group that is greater than `above`, a column of theirs.

    Values stand in cells of `width`. Within a cell a window looks up; where a cell has nothing greater, the least value of the next cell that has any does, from a
    summary with a row a cell."""
    cell = lambda c: F.floor(c / F.lit(width))
    at = F.struct(F.col(group).alias("g"), F.col(value).alias("v"))
    rows = points.select(F.col(group).alias("_g"), cell(F.col(value)).alias("_c"), F.col(value).alias("_v"), F.lit(1).alias("_k"), F.lit(None).cast(f"struct<g:{points.schema[group].dataType.simpleString()},v:{points.schema[value].dataType.simpleString()}>").alias("_of"))
    asks = points.select(F.col(group).alias("_g"), cell(above).alias("_c"), above.alias("_v"), F.lit(0).alias("_k"), at.alias("_of"))
    both = rows.unionByName(asks.withColumn("_v", F.col("_v").cast(points.schema[value].dataType)))
    within = Window.partitionBy("_g", "_c").orderBy(F.col("_v").desc(), "_k").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_up", F.last(F.when(F.col("_k") == 1, F.col("_v")), ignorenulls=True).over(within))
    cells = both.groupBy("_g", "_c").agg(F.min(F.when(F.col("_k") == 1, F.col("_v"))).alias("_low"))
    after = Window.partitionBy("_g").orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("_g").alias("_h"), F.col("_c").alias("_d"), F.last("_low", ignorenulls=True).over(after).alias("_later"))
    asked = both.where("_k = 0")
    found = asked.join(cells, asked["_g"].eqNullSafe(cells["_h"]) & (asked["_c"] == cells["_d"]))
    return found.select(F.col("_of.g").alias(group), F.col("_of.v").alias(value), F.coalesce("_up", "_later").alias(name))


def ranked_up(values: DataFrame, group: str, value: str, counts: Column, width: float, name: str) -> DataFrame:
    """values (group, value, ...) and the sum of `counts` over the group's values up to their own: within cells, and over a summary with a row a cell."""
    rows = values.withColumn("_c", F.floor(F.col(value) / F.lit(width))).withColumn("_x", counts)
    own = F.sum("_x").over(Window.partitionBy(group, "_c").orderBy(value))
    cells = rows.groupBy(F.col(group).alias("_h"), F.col("_c").alias("_d")).agg(F.sum("_x").alias("_s"))
    before = Window.partitionBy("_h").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_h", "_d", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    rows = rows.withColumn("_own", own)
    found = rows.join(cells, rows[group].eqNullSafe(cells["_h"]) & (rows["_c"] == cells["_d"]))
    return found.select(*values.columns, (F.col("_own") + F.col("_b")).alias(name))


def row_groups(df: DataFrame, by: str, y: str, gap: float) -> DataFrame:
    """All columns and `band` (from 0): a row joins a group's band if it is at most `gap` above the band's first row; the next one opens another.

    A value's successor is the first one beyond value + gap; those reached from the lowest open the bands, and a row's band is the number of openers up to it, less one.
    Rows without y (null or NaN) have no band; rows of a null group are a group; equal heights are one value, however many rows have it; an empty table gives an empty result."""
    v = F.col(y).cast("double")
    good = v.isNotNull() & ~F.isnan(v)
    values = cut(df.where(good).select(F.col(by).alias("_by"), (v + F.lit(0.0)).alias("_y")).distinct())
    width = gap if gap > 0 else 1.0
    links = next_above(values, "_by", "_y", F.col("_y") + F.lit(max(gap, 0.0)), width, "_to")
    firsts = values.groupBy("_by").agg(F.min("_y").alias("_y"))
    opens = reached_from(firsts, links, "_by", "_y", "_to").select(F.col("_by").alias("_ob"), F.col("_y").alias("_oy"))
    marked = values.join(opens, values["_by"].eqNullSafe(opens["_ob"]) & (values["_y"] == opens["_oy"]), "left")
    bands = ranked_up(marked.select("_by", "_y", F.col("_oy").isNotNull().cast("int").alias("_o")), "_by", "_y", F.col("_o"), width, "_n")
    bands = bands.select("_by", "_y", (F.col("_n") - 1).cast("int").alias("band"))
    own = df.withColumn("_v", F.when(good, v + F.lit(0.0)))
    return own.join(bands, own[by].eqNullSafe(bands["_by"]) & (own["_v"] == bands["_y"]), "left").select(*df.columns, "band")


#: Fixed values of a book's numbered series: it starts with 1 or 1.1; the furthest step to its next label; where the numbers of a further chapter may start.
SERIES_STARTS, SERIES_STEP, CHAPTER_STARTS = ((1,), (1, 1)), 12, (0, 1, 2)


def series_numbers(label: Column) -> Column:
    """The numbers of a label such as 14, 14a or 3.12; one zero if it has none."""
    found = F.transform(F.regexp_extract_all(label, F.lit("([0-9]+)"), 1), lambda x: x.cast("long"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0).cast("long")))


def main_series(df: DataFrame, by: str, page: list[str], label: str, ties: list[str]) -> DataFrame:
    """All columns and `main`: whether a label belongs to its group's main numbered series, in the order of pages and of the labels on a page.

    Places are numbered first, by one sort of all, so that what goes on are numbers and not the columns of the order. The labels that may come next after one are its own numbers with a greater label, up to SERIES_STEP
    further on, and, with chapters, the starts of the next chapter: they stand in its cell of numbers or in the next one, or in the next chapter's first. Each label that a
    group has among these is looked up at its first place behind, and the nearest of them is the successor; the series is what is reached from the first start.
    Rows that agree in all columns of the order have one place; labels without numbers, null ones too, count as 0 and never belong; an empty table gives an empty result."""
    rows = df.withColumn("_label", F.coalesce(F.col(label), F.lit("")))
    keys = [*page, "_label", *ties]
    names = {c: f"_key{k}" for k, c in enumerate(keys)}
    places = cut(rows.select(F.col(by).alias("_by"), *[F.col(c).alias(n) for c, n in names.items()]).distinct())
    told = names["_label"]
    order = ["_by", *[names[c] for c in page], "_numbers", told, *[names[c] for c in ties]]
    places = cut(placed(places.withColumn("_numbers", series_numbers(F.col(told))), order, "_at"))
    is_start = F.lit(False)
    for start in SERIES_STARTS:
        is_start = is_start | (F.col("_numbers") == F.array(*[F.lit(x).cast("long") for x in start]))
    starts = cut(places.where(is_start).groupBy(F.col("_by").alias("_sb")).agg(F.min("_at").alias("_start")))
    n, a, b = F.size("_numbers"), F.get("_numbers", F.lit(0)), F.coalesce(F.get("_numbers", F.lit(1)), F.lit(-1))
    width = SERIES_STEP + 1
    cell = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    whole = lambda x: F.floor(x / F.lit(width))
    rest = F.when(n > 2, F.slice("_numbers", 3, F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<long>"))
    behind_start = places.join(starts, same(places, starts, {"_by": "_sb"}) & (F.col("_at") >= F.col("_start")))  # all that a series can reach
    at = behind_start.select("_by", "_at", F.col(told).alias("_label"), n.alias("_s"), a.alias("_a"), b.alias("_b"), rest.alias("_rest"), F.when(n == 1, cell(whole(a), F.lit(-1))).otherwise(cell(a, whole(b))).alias("_c"))
    kinds = at.groupBy("_by", "_label").agg(*[F.first(c).alias(c) for c in ("_s", "_a", "_b", "_rest", "_c")]).select(*[F.col(c).alias(f"_k{c}") for c in ("_by", "_label", "_s", "_a", "_b", "_rest", "_c")])
    x, y = F.col("_c.x"), F.col("_c.y")
    last = -(-(max(CHAPTER_STARTS) + 1) // width)
    cells = F.when(F.col("_s") == 1, F.array(cell(x, y), cell(x + 1, y))).otherwise(F.array(cell(x, y), cell(x, y + 1), *[cell(x + 1, F.lit(k)) for k in range(last)]))
    wanted = at.select("_by", "_at", "_label", "_s", "_a", "_b", "_rest", F.explode(cells).alias("_w"))
    further = lambda c: F.col(f"_k{c}") - F.col(c)
    near = F.when(F.col("_s") == 1, further("_a").between(0, SERIES_STEP)).otherwise(((further("_a") == 0) & further("_b").between(0, SERIES_STEP)) | ((further("_a") == 1) & F.col("_k_b").isin(*CHAPTER_STARTS)))
    asks = wanted.join(kinds, wanted["_by"].eqNullSafe(kinds["_k_by"]) & (wanted["_s"] == kinds["_k_s"]) & (wanted["_w.x"] == kinds["_k_c.x"]) & (wanted["_w.y"] == kinds["_k_c.y"]))
    asks = asks.where(near & (F.struct("_k_a", "_k_b", "_k_rest", "_k_label") > F.struct("_a", "_b", "_rest", "_label"))).select("_by", F.col("_k_label").alias("_key"), "_at", F.lit(1).alias("_k"))
    found = at.select("_by", F.col("_label").alias("_key"), "_at", F.lit(0).alias("_k")).unionByName(asks)
    behind = Window.partitionBy("_by", "_key").orderBy(F.col("_at").desc(), "_k").rowsBetween(Window.unboundedPreceding, -1)
    looked = found.withColumn("_to", F.last(F.when(F.col("_k") == 0, F.col("_at")), ignorenulls=True).over(behind)).where("_k = 1")
    links = looked.groupBy("_at").agg(F.min("_to").alias("_to")).withColumn("_all", F.lit(0))
    main = reached_from(starts.select(F.lit(0).alias("_all"), F.col("_start").alias("_at")), links, "_all", "_at", "_to").select(F.col("_at").alias("_ma"))
    main = places.join(main, F.col("_at") == F.col("_ma")).select("_by", *names.values(), "_ma")
    return rows.join(main, same(rows, main, {by: "_by", **names}), "left").select(*df.columns, F.col("_ma").isNotNull().alias("main"))
