"""Quality queries over a move tree: success rate, breaks, reasons, hot pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import path_all

#: Statuses and how good each is.
RANK = {"ok": 4, "guessed": 3, "ambiguous": 2, "waiting": 1, "failed": 1, "unattached": 0}


def rank(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), status), F.lit(0))


def success_rate(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Tokens, those read, those wrong, and the rate: a token counts where it and all before it on its path agree. nodes: id, parent, status, agrees. Groups without tokens rate 100."""
    paths = path_all(nodes, "id", "parent", "agrees")
    scored = nodes.join(paths, "id")
    out = scored.groupBy(*by).agg(F.count("*").alias("tokens"), F.count_if((F.col("status") == "ok") & F.col("path_ok")).alias("read"), F.count_if((F.col("status") == "ok") & ~F.col("agrees")).alias("wrong"))
    return out.withColumn("rate", F.when(F.col("tokens") == 0, 100.0).otherwise(F.round(100.0 * F.col("read") / F.col("tokens"), 6)))


def why(nodes: DataFrame) -> DataFrame:
    """Tokens by the reason that they don't count, with digits masked."""
    reason = F.when(F.col("placed") == F.lit(False), F.regexp_replace(F.coalesce("reason", F.lit("")), "[0-9]+", "N")).when(F.col("status") != "ok", F.col("status")).when(~F.col("agrees"), "wrong").otherwise("broken earlier")
    return nodes.where("not path_ok or status <> 'ok'").groupBy(reason.alias("reason")).count()


def hot(df: DataFrame, by: str, most: int = 40) -> DataFrame:
    """The groups with the most rows: a top-k report."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by).limit(most)


def first_breaks(df: DataFrame, line: str, order: Column, bad: Column) -> DataFrame:
    """The first bad row of each line."""
    return df.where(bad).groupBy(line).agg(F.min_by(F.struct(*[c for c in df.columns if c != line]), order).alias("first")).select(line, "first.*")


def jumps(nodes: DataFrame, most: int = 1) -> DataFrame:
    """Moves whose page is further from their parent's than it should be: a self join on the parent."""
    up = nodes.select(F.col("id").alias("_id"), F.col("page").alias("_page"))
    return nodes.join(up, F.col("parent") == F.col("_id")).where(F.abs(F.col("page") - F.col("_page")) > most).select(*nodes.columns, F.col("_page").alias("parent_page"))


def scan(nodes: DataFrame, lines: DataFrame, diagrams: DataFrame, short: int = 12) -> dict[str, DataFrame]:
    """Independent findings. nodes: id, line, parent, page, ply, main, status, san, raw; lines: id, chapter, kind, title; diagrams: id, page, status."""
    main = nodes.where("main")
    size = main.groupBy("line").agg(F.count("*").alias("moves"))
    return {
        "breaks": first_breaks(main.select("line", "id", "page", "ply", "status"), "line", F.struct("ply", "id"), F.col("status") != "ok"),
        "silent": main.where("status = 'ok' and san is not null and lower(substring(san, -2, 2)) <> lower(substring(regexp_replace(raw, '[+#!?]+$', ''), -2, 2))").select("id", "page", "san", "raw"),
        "jumps": jumps(nodes),
        "diagrams": diagrams.groupBy("status").agg(F.count("*").alias("n")),
        "unplaced": nodes.where("status in ('waiting', 'unattached', 'failed')").groupBy("status").agg(F.count("*").alias("n")),
        "hot_pages": hot(nodes.where("status <> 'ok'"), "page"),
        "short_games": lines.where("kind = 'game'").join(size, lines.id == size.line).where(F.col("moves") < short).select("id", "title", "moves"),
        "chapters": lines.join(size, lines.id == size.line, "left").groupBy("chapter").agg(F.count("*").alias("lines"), F.sum(F.coalesce("moves", F.lit(0))).alias("moves")),
    }
