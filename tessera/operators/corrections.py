"""Keyed corrections and incremental maintenance: what a correction touches is derived again, the rest stays, and the result equals a fresh build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialise import cut

#: The parts of a correction set.
PARTS = ("diagrams", "moves", "unattached", "glyphs", "connect", "disconnect", "gaps", "added", "declined")
KEY = r"^[0-9]+:-?[0-9]+,-?[0-9]+:.+$"


def canonical(fixes: DataFrame, strict: bool = False) -> DataFrame:
    """part, key, value, auto, seq: unknown parts, malformed keys and empty values go (or raise); of equal keys the last entry counts, and a reader's entry beats an automatic one."""
    good = F.col("part").isin(*PARTS) & F.when(F.col("part") == "diagrams", F.col("key").isNotNull()).otherwise(F.col("key").rlike(KEY)) & (F.col("value").isNotNull() | (F.col("part") == "declined"))
    kept = fixes.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("impossible correction: "), F.coalesce("key", F.lit("no key")))).cast("boolean") if strict else F.lit(False)))
    return kept.groupBy("part", "key").agg(F.max_by(F.struct("value", "auto", "seq"), F.struct((~F.col("auto")).cast("int"), "seq")).alias("v")).select("part", "key", "v.*")


def declined(fixes: DataFrame, key: str, part: str) -> DataFrame:
    """Remove an automatic entry and remember it, so that it is not made again."""
    gone = (F.col("part") == part) & (F.col("key") == key) & F.col("auto")
    return fixes.where(~gone).unionByName(fixes.where(gone).select(F.lit("declined").alias("part"), "key", F.lit(None).cast("string").alias("value"), F.lit(False).alias("auto"), "seq"))


def applied(base: DataFrame, fixes: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Base rows with the columns that parts name replaced: columns is part to column."""
    out = base
    for part, column in columns.items():
        own = fixes.where(F.col("part") == part).select(F.col("key").alias("_k"), F.col("value").alias("_v"))
        out = out.join(own, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce(F.col("_v").cast(base.schema[column].dataType), F.col(column))).drop("_k", "_v")
    return out


def signature(df: DataFrame, by: str) -> DataFrame:
    """An order-free signature of each group's rows."""
    return df.groupBy(by).agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("signature"), F.count("*").alias("rows"))


def touched(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Groups whose rows differ between two versions."""
    a, b = signature(old, by), signature(new, by)
    same = a.join(b, [by, "signature", "rows"], "left_semi")
    return a.select(by).union(b.select(by)).distinct().join(same.select(by), by, "left_anti")


def maintained(stored: DataFrame, old: DataFrame, new: DataFrame, by: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The derived view after a change: derive touched groups from the new rows, keep the others as stored."""
    hit = touched(old, new, by)
    return stored.join(hit, by, "left_anti").unionByName(derive(new.join(hit, by, "left_semi")))


def patch(old: DataFrame, new: DataFrame, id: str, key: str | None = None, path: str | None = None) -> DataFrame:
    """What changed between two views: rows by id that are added, removed or changed, and for removed ones `renamed`: the added id with the same key or, where a row has none, with the same path."""
    o, n = old.select(F.col(id).alias("_ok"), F.struct("*").alias("_o")), new.select(F.col(id).alias("_nk"), F.struct("*").alias("_n"))
    both = o.join(n, F.col("_ok") == F.col("_nk"), "full_outer")
    kind = F.when(F.col("_ok").isNull(), "added").when(F.col("_nk").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    out = both.withColumn("change", kind).where("change is not null").select(F.coalesce("_nk", "_ok").alias(id), "change", "_o")
    to = F.lit(None).cast(new.schema[id].dataType)
    for k, by in enumerate(c for c in (key, path) if c):
        has = F.col(f"_o.{by}").isNotNull() & (F.lit(k == 0) | F.col(f"_o.{key}").isNull())
        own = new.where(F.col(by).isNotNull() & (F.lit(k == 0) | F.col(key).isNull())).groupBy(F.col(by).alias(f"_by{k}")).agg(F.min(id).alias(f"_to{k}"))
        out = out.join(own, has & (F.col("change") == "removed") & (F.col(f"_o.{by}") == F.col(f"_by{k}")), "left")
        to = F.coalesce(to, F.col(f"_to{k}"))
    return out.select(id, "change", *([to.alias("renamed")] if key or path else []))


def recounted(counts: DataFrame, old: DataFrame, new: DataFrame, by: str, measures: dict[str, Column]) -> DataFrame:
    """Counts by group after a change: only groups whose rows differ are counted again. A group that is gone leaves."""
    count = lambda rows: rows.groupBy(by).agg(*[c.alias(name) for name, c in measures.items()])
    return maintained(counts, old, new, by, count)


def what_if(base: DataFrame, fixes: DataFrame, extra: DataFrame, key: str, columns: dict[str, str], by: str, status: Column) -> DataFrame:
    """What further corrections would change: for each group that they touch the rows by status before and after. Nothing is stored."""
    before = applied(base, canonical(fixes), key, columns)
    after = applied(base, canonical(fixes.unionByName(extra)), key, columns)
    hit = touched(before, after, by)
    count = lambda rows, name: rows.join(hit, by, "left_semi").groupBy(by, status.alias("status")).agg(F.count("*").alias(name))
    both = count(before, "before").join(count(after, "after"), [by, "status"], "full_outer")
    return both.select(by, "status", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def selected(pages: DataFrame, page: str, ranges: DataFrame, width: int = 64) -> DataFrame:
    """Pages in none of the excluded closed ranges (start, end): ranges stand in cells, so no cross join."""
    cells = ranges.withColumn("_c", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    return pages.withColumn("_k", F.floor(F.col(page) / width)).join(cells, (F.col("_k") == F.col("_c")) & F.col(page).between(F.col("start"), F.col("end")), "left_anti").drop("_k")


def diagram_selected(kind: Column, included: Column, excluded: Column) -> Column:
    """Explicit include over exclude over the default of its kind."""
    return F.when(included, True).when(excluded, False).otherwise(~kind.isin("decoration", "cover"))


def settled(fixes: DataFrame, holds: Callable[..., DataFrame], rounds: int = 3, beside: bool = False) -> DataFrame:
    """Drop automatic corrections that no longer hold, until none does or the rounds are over. holds(automatic entries) returns those that do; with `beside` it is given all entries of the round too. The lineage is cut each round."""
    now = cut(fixes)
    left = now.count()
    for _ in range(rounds):
        now = cut(now.where("not auto").unionByName(holds(now.where("auto"), *([now] if beside else []))))
        left, before = now.count(), left
        if left == before:
            break
    return now


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
