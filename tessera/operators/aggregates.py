"""Aggregates beyond the built-in ones, made of partial sums that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialise import cut


def weighted_mode(df: DataFrame, by: list[str], value: str, weight: Column, tie: Column) -> DataFrame:
    """The value with the most weight in each group; the smaller tie column wins."""
    sums = df.groupBy(*by, value).agg(F.sum(weight).alias("weight"), F.min(tie).alias("_t"))
    return sums.groupBy(*by).agg(F.max_by(value, F.struct("weight", -F.col("_t"))).alias(value), F.max("weight").alias("weight"))


def coverage(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """Commonest values of each group up to a cumulative share; the value that crosses it is included. The window runs over counts, not rows."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    run = w.orderBy(F.col("n").desc(), value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("*", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("_b"), F.sum("n").over(w).alias("_all")).where(F.col("_b") < share * F.col("_all")).drop("_b", "_all")


def index_percentile(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """The element at floor(q * (n - 1)) of each group's sorted values: from counts of distinct values, so no group's rows meet in one list."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    placed = counts.select("*", F.sum("n").over(w.orderBy(value)).alias("_to"), F.floor(F.lit(q) * (F.sum("n").over(w) - 1)).alias("_at"))
    return placed.where(F.col("_to") > F.col("_at")).groupBy(*by).agg(F.min(value).alias(name))


def shares(df: DataFrame, by: list[str], value: str, least_share: float, least: int) -> DataFrame:
    """Values with enough uses and a large enough share of their group."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(*by))).where((F.col("n") >= least) & (F.col("n") >= least_share * F.col("total")))


def assign(df: DataFrame, left: str, right: str, support: str) -> DataFrame:
    """One-to-one pairs by falling support. Each round takes all pairs that are the best of both their sides; what touches them leaves.

    This gives what a greedy pass in order gives, as order (support, left, right) is total. Each round takes the best pair that is left at least, so it ends.
    """
    rest, out = df.select(left, right, support), None
    order = [F.col(support).desc(), F.col(left), F.col(right)]
    while True:
        ranked = rest.select("*", F.row_number().over(Window.partitionBy(left).orderBy(*order)).alias("_l"), F.row_number().over(Window.partitionBy(right).orderBy(*order)).alias("_r"))
        taken = cut(ranked.where("_l = 1 and _r = 1").drop("_l", "_r"))
        out = taken if out is None else out.unionByName(taken)
        left_over = rest.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti")
        rest = cut(left_over)
        if rest.isEmpty():
            return out


def learnt_code(seen: DataFrame, symbol: str, value: str, least_share: float, least: int) -> DataFrame:
    """symbol, value, n: what each symbol stands for, from rows of a symbol and what it was read as. Values with too few uses or too small a share of their symbol's go; of the rest each symbol and each value is used once, the best supported pairs first."""
    return assign(shares(seen, [symbol], value, least_share, least).select(symbol, value, "n"), symbol, value, "n")


def posterior(counts: DataFrame, by: str, value: str, n: str, values: int, kappa: float = 2.0, base: Column | None = None) -> DataFrame:
    """Probability of each value given its key: (c + kappa * base) / (n + kappa), with a uniform base unless given."""
    base = F.lit(1.0 / values) if base is None else base
    return counts.withColumn("p", (F.col(n) + kappa * base) / (F.sum(n).over(Window.partitionBy(by)) + kappa))


def backed_off(counts: DataFrame, by: str, value: str, n: str, kappa: float = 2.0, prior: float = 1.0) -> DataFrame:
    """Probability of each value given its key, backed off to how common the value is at all: (c + kappa * base) / (n + kappa), base = (total + prior) / (all + prior * values). The values' totals are a row each and broadcast."""
    base = counts.groupBy(value).agg(F.sum(n).alias("_t"))
    whole = base.agg(F.sum("_t").alias("_all"), F.count("*").alias("_values"))
    base = base.crossJoin(F.broadcast(whole)).select(value, ((F.col("_t") + prior) / (F.col("_all") + prior * F.col("_values"))).alias("_b"))  # one row
    return counts.join(base, value).withColumn("p", (F.col(n) + kappa * F.col("_b")) / (F.sum(n).over(Window.partitionBy(by)) + kappa)).drop("_b")


def mean_mask(df: DataFrame, by: list[str], vector: str, above: float = 0.5) -> DataFrame:
    """Per group and position whether the mean of the vectors is over a threshold: sums by position, so no group meets in a task."""
    each = df.select(*by, F.posexplode(vector).alias("pos", "_x")).groupBy(*by, "pos").agg(F.avg("_x").alias("mean"))
    return each.withColumn("mask", F.col("mean") > above)


def group_medians(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Exact medians of columns per group, each from counts of distinct values: the mean of the two middle ones."""
    out = None
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("n"))
        w = Window.partitionBy(*by)
        placed = counts.select("*", F.sum("n").over(w.orderBy(c)).alias("_to"), F.sum("n").over(w).alias("_all"))
        low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
        one = placed.groupBy(*by).agg(((F.min(F.when(F.col("_to") > low, F.col(c))) + F.min(F.when(F.col("_to") > high, F.col(c)))) / 2).alias(c))
        out = one if out is None else out.join(one, by, "full_outer")
    return out


def otsu(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The threshold that separates each group's values best into two classes: running sums over counts of distinct values."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    run = w.orderBy(value)
    v = F.col(value).cast("double")
    sums = counts.select("*", F.sum("n").over(run).alias("n0"), F.sum(v * F.col("n")).over(run).alias("s0"), F.sum("n").over(w).alias("nt"), F.sum(v * F.col("n")).over(w).alias("st")).where("n0 < nt")
    between = F.col("n0") * (F.col("nt") - F.col("n0")) * F.pow(F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / (F.col("nt") - F.col("n0")), 2)
    return sums.withColumn("_b", F.round(between, 3)).groupBy(*by).agg(F.max_by(value, F.struct(F.col("_b"), -F.col(value))).alias("threshold"))


def votes(df: DataFrame, group: str, value: str, choices: int, odds: float = 4.0) -> DataFrame:
    """The value with the most votes of each group and its confidence: odds multiplied by `odds` with each vote, over all choices."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.max_by(value, F.struct("n", value)).alias(value), F.max("n").alias("votes"), F.sum("n").alias("total"), F.count("*").alias("named"), F.collect_list("n").alias("_all"))
    weight = F.aggregate("_all", F.lit(0.0), lambda s, n: s + F.pow(F.lit(odds), n - F.col("votes")))
    rest = (F.lit(choices) - F.col("named")) * F.pow(F.lit(odds), -F.col("votes"))
    return best.select(group, value, "votes", "total", (1 / (weight + rest)).alias("confidence"))
