"""Joins that Spark has no operator for: as-of, tolerance, interval and nearest, each without a cross join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], ties: list[str], forward: bool = False, prefix: str = "prev_", cell: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the values of the last right row before it (or the next after it) in its group. Equal `on` values do not match; `ties` makes the order of rows unique.

    Both sides are unioned and carried along an ordered window. With `cell`, a monotone function of `on` (a day, say), windows
    span one cell of a group only, and what comes from other cells is carried over a summary with a row a cell: a group
    of any share of the rows is spread over its cells.
    """
    cells = [] if cell is None else ["_cell"]
    both = left.select(*left.columns, F.lit(False).alias("_r"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values]).unionByName(
        right.select(*by, on, F.lit(True).alias("_r"), *[F.col(v).alias(f"_{v}") for v in values], *[F.col(t) for t in ties if t not in (*by, on)]), allowMissingColumns=True
    )
    if cell is not None:
        both = both.withColumn("_cell", cell(F.col(on)))
    order = [F.col(on).desc() if forward else F.col(on)]
    span = Window.partitionBy(*by, *cells).orderBy(*order, F.col("_r"), *ties).rowsBetween(Window.unboundedPreceding, -1)
    packed = F.when(F.col("_r"), F.struct(F.col(on).alias("at"), *[F.col(f"_{v}").alias(v) for v in values]))
    found = both.withColumn("_m", F.last(packed, ignorenulls=True).over(span)).where(~F.col("_r"))
    if cell is not None:
        # the last right row of a cell in that order: latest, or earliest when looking forward, and of equal times the last tie
        place = F.struct(on, *ties)
        rows = right.withColumn("_cell", cell(F.col(on)))
        if forward:
            first = rows.groupBy(*by, "_cell").agg(F.min(on).alias("_t"))
            rows = rows.join(first, [*by, "_cell"]).where(F.col(on) == F.col("_t"))
        last = rows.groupBy(*by, "_cell").agg(F.max_by(F.struct(F.col(on).alias("at"), *values), place).alias("_best"))
        marks = last.unionByName(left.select(*by, cell(F.col(on)).alias("_cell")).distinct(), allowMissingColumns=True).groupBy(*by, "_cell").agg(F.first("_best", ignorenulls=True).alias("_best"))
        along = Window.partitionBy(*by).orderBy(F.col("_cell").desc() if forward else F.col("_cell")).rowsBetween(Window.unboundedPreceding, -1)
        carried = marks.select(*by, "_cell", F.last("_best", ignorenulls=True).over(along).alias("_carried"))
        found = found.join(carried, [*by, "_cell"], "left").withColumn("_m", F.coalesce("_m", "_carried"))
    return found.select(*left.columns, F.col("_m.at").alias(f"{prefix}{on}"), *[F.col(f"_m.{v}").alias(f"{prefix}{v}") for v in values])


def tolerance(left: DataFrame, right: DataFrame, by: list[str], point: list[str], within: float, rank: list[Column], keys: list[str]) -> DataFrame:
    """Each left row (with unique `keys`) with its best right row in the group at Chebyshev distance `within` or less.

    The first coordinate is cut into cells as wide as the tolerance and the right side stands in three
    of them, so the join is an equi join; `rank` orders candidates (columns of right are prefixed r_).
    """
    cell = F.floor(F.col(point[0]) / within)
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.explode(F.array(*[F.floor(F.col(point[0]) / within) + k for k in (-1, 0, 1)])).alias("_cell"))
    pairs = left.withColumn("_lcell", cell).join(r, [F.col(b) == F.col(f"r_{b}") for b in by] + [F.col("_lcell") == F.col("_cell")])
    near = F.greatest(*[F.abs(F.col(p) - F.col(f"r_{p}")) for p in point]) if len(point) > 1 else F.abs(F.col(point[0]) - F.col(f"r_{point[0]}"))
    best = Window.partitionBy(*keys).orderBy(*rank)
    return pairs.where(near <= within).withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn", "_cell", "_lcell")


def intervals(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points with every closed range that holds them. A range stands in the cells that it touches at the level (cells of `width`, doubled at each level) where these are three at most; a point asks
    its cell at each level that there is, so neither a long range nor a hot stretch makes many rows."""
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((F.col(end) - F.col(start)) / width, F.lit(1.0))))).cast("int")
    wide = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_l"))
    cells = ranges.withColumn("_l", level).withColumn("_c", F.explode(F.sequence(F.floor(F.col(start) / wide), F.floor(F.col(end) / wide))))
    levels = [r[0] for r in ranges.select(level).distinct().collect()]  # as many as there are doublings
    asked = points.withColumn("_pl", F.explode(F.array(*[F.lit(x) for x in levels]))) if levels else points.withColumn("_pl", F.lit(0))
    cell = F.floor(F.col(at) / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_pl"))))
    return asked.withColumn("_k", cell).join(cells, (F.col("_pl") == F.col("_l")) & (F.col("_k") == F.col("_c")) & F.col(at).between(F.col(start), F.col(end))).drop("_k", "_c", "_l", "_pl")


def nearest(rows: DataFrame, centres: list[tuple[int, list[float]]], vector: str) -> DataFrame:
    """Each row with the id of its nearest centre and the squared distance; centres are a short list, broadcast as one row of arrays."""
    if len(centres) > 1000:
        raise ValueError("over 1000 centres: give them as a table and rank pairs within cells")
    one = rows.sparkSession.createDataFrame([([(k, [float(x) for x in c]) for k, c in centres],)], "_centres array<struct<centre:int,v:array<double>>>")

    def squared(c: Column) -> Column:
        return F.aggregate(F.zip_with(F.col(vector), c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)

    best = F.array_min(F.transform("_centres", lambda c: F.struct(squared(c["v"]).alias("distance"), c["centre"].alias("centre"))))
    return rows.crossJoin(F.broadcast(one)).withColumn("_n", best).select(*rows.columns, F.col("_n.centre").alias("centre"), F.col("_n.distance").alias("distance"))  # one row


def compare(old: DataFrame, new: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Full outer comparison of two readings: gain, loss, moved, new, gone or same. `order` lists statuses from worst to best."""
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in order]), c)
    o, n = old.select(F.col(key).alias("_k"), F.col(status).alias("was"), F.struct("*").alias("_o")), new.select(F.col(key).alias(key), F.col(status).alias("now"), F.struct("*").alias("_n"))
    both = o.join(n, F.col("_k") == F.col(key), "full_outer")
    change = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(rank(F.col("now")) > rank(F.col("was")), "gain").when(rank(F.col("now")) < rank(F.col("was")), "loss").when(~F.col("_o").eqNullSafe(F.col("_n")), "moved").otherwise("same")
    )
    return both.select(F.coalesce(F.col(key), F.col("_k")).alias(key), "was", "now", change.alias("change"))
