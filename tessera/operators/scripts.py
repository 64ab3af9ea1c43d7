"""Edit scripts over lines: splits, joins, moves, additions and removals, folded in order onto intervals of base rows.

A script is small beside the rows: it alone is walked, by book, and gives the intervals of base rows that each derived line is made of. Rows then find their interval by a join, so a line of any length is spread, and a
book without entries is not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions before the first and behind the last row of a line.
FIRST, LAST = 0, 1 << 60


@dataclass(frozen=True)
class Interval:
    """Base rows of a line from lo to hi (excluded), or an added row."""

    line: str
    lo: int
    hi: int
    added: str | None = None


def _cut(row: list[Interval], line: str, pos: int) -> int | None:
    """Where in a line's intervals base position (line, pos) stands, after cutting one there; None if it is not there."""
    for k, x in enumerate(row):
        if x.added is None and x.line == line and x.lo <= pos < x.hi:
            if pos > x.lo:
                row[k : k + 1] = [replace(x, hi=pos), replace(x, lo=pos)]
                return k + 1
            return k
    return None


def folded(lines: list[str], entries: list[dict]) -> list[tuple[str, int, Interval]]:
    """line, order and interval of the derived lines of a book whose base lines are given. entries, in order: op and its fields:

    split (line, at, to): what stands in a line from base position at (of base line `of`) on becomes the line `to`; join (line, to): all of a line goes behind the line `to`;
    move (of, at, until, line, before_of, before): base rows at .. until (excluded) of base line `of` go before a base position, or to the end of a line if that is null; remove (of, at, until); add (line, before_of, before, row): a row of its own.
    An entry whose line or place is no longer there does nothing. What several entries say of one row is what the last of them says."""
    now = {line: [Interval(line, FIRST, LAST)] for line in lines}
    holders = {line: {line} for line in lines}  # by base line, the lines that may hold rows of it, so that an entry looks at no other

    def held(line: str, intervals: list[Interval]) -> None:
        for x in intervals:
            if x.added is None:
                holders[x.line].add(line)

    def taken(of: str, at: int, until: int) -> list[Interval]:
        out = []
        for line in list(holders.get(of, ())):
            if line not in now:  # split empty, then joined to another
                holders[of].discard(line)
                continue
            row = now[line]
            for edge in (at, until):
                _cut(row, of, edge)
            out += [x for x in row if x.added is None and x.line == of and at <= x.lo < until]
            now[line] = [x for x in row if not (x.added is None and x.line == of and at <= x.lo < until)]
            if not any(x.added is None and x.line == of for x in now[line]):
                holders[of].discard(line)
        return sorted(out, key=lambda x: x.lo)

    def put(line: str, of: str | None, before: int | None, new: list[Interval]) -> bool:
        if line not in now:
            return False
        k = len(now[line]) if before is None else _cut(now[line], of, before)
        if k is None:
            return False
        now[line][k:k] = new
        held(line, new)
        return True

    for e in entries:
        if e["op"] == "split" and e["line"] in now and e["to"] not in now:
            k = _cut(now[e["line"]], e["of"], e["at"])
            if k is not None:
                now[e["to"]] = now[e["line"]][k:]
                del now[e["line"]][k:]
                held(e["to"], now[e["to"]])
        elif e["op"] == "join" and e["line"] in now and e["to"] in now and e["line"] != e["to"]:
            gone = now.pop(e["line"])
            now[e["to"]] += gone
            held(e["to"], gone)
            for lines_of in [holders[x.line] for x in gone if x.added is None]:
                lines_of.discard(e["line"])
        elif e["op"] == "move" and e["line"] in now:
            before = {line: list(now[line]) for line in holders.get(e["of"], ()) if line in now}
            if not put(e["line"], e["before_of"], e["before"], taken(e["of"], e["at"], e["until"])):
                now.update(before)  # its place is among what is moved, or gone
                holders.get(e["of"], set()).update(before)
        elif e["op"] == "remove":
            taken(e["of"], e["at"], e["until"])
        elif e["op"] == "add":
            put(e["line"], e["before_of"], e["before"], [Interval(e["line"], 0, 0, e["row"])])
    return [(line, k, x) for line, row in now.items() for k, x in enumerate(row)]


ENTRY = ("op", "line", "to", "of", "at", "until", "before_of", "before", "row")


def derived(base: DataFrame, script: DataFrame, book: str = "book") -> DataFrame:
    """book, line, place (from 1), of, pos, row: the derived lines. base: book, line, pos (1, 2, ... within a base line); of and pos are a row's base line and position, and row is an added row's text.

    script: book, seq and the columns of ENTRY (strings, positions long; null where an op does not use them); entries of one book are folded in order of seq, in one task; books without entries pass by. Of an interval
    the join keeps the rows between its ends, which are dealt by base line and interval; places are offsets of intervals, sums over a row an interval, and distances within them. Null books or lines are dropped; an
    empty script gives the base lines."""
    rows = base.select(F.col(book).alias("book"), F.col("line").cast("string").alias("line"), F.col("pos").cast("long").alias("pos")).where("book is not null and line is not null and pos is not null")
    kind = rows.schema["book"].dataType.simpleString()
    said = script.select(F.col(book).alias("book"), "seq", *ENTRY).where("book is not null")
    hit = said.select("book").distinct()
    named = rows.join(hit, "book", "left_semi").select("book", "line").distinct().select("book", F.lit(None).cast("long").alias("seq"), F.lit("line").alias("op"), "line", *[F.lit(None).cast(said.schema[c].dataType).alias(c) for c in ENTRY[2:]])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        entries = pdf[pdf.op != "line"].sort_values("seq", kind="stable")
        none = lambda v: None if v is None or v != v else v
        plain = [{c: int(none(r[c])) if c in ("at", "until", "before") and none(r[c]) is not None else none(r[c]) for c in ENTRY} for r in entries.to_dict("records")]
        out = folded(sorted(pdf[pdf.op == "line"].line), plain)
        return pd.DataFrame([(pdf.book.iloc[0], line, k, x.line, x.lo, x.hi, x.added) for line, k, x in out], columns=["book", "to", "k", "of", "lo", "hi", "row"])

    pieces = named.unionByName(said).groupBy("book").applyInPandas(fold, f"book {kind}, to string, k long, of string, lo long, hi long, row string")
    from .materialise import cut

    pieces = cut(pieces)
    touched = rows.join(hit, "book", "left_semi")
    own = touched.alias("r").join(pieces.where("row is null").alias("p"), (F.col("r.book") == F.col("p.book")) & (F.col("r.line") == F.col("p.of")) & (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
    own = own.select("r.book", F.col("to").alias("line"), "k", F.col("of"), "pos", F.lit(None).cast("string").alias("row"))
    more = pieces.where("row is not null").select("book", F.col("to").alias("line"), "k", F.lit(None).cast("string").alias("of"), F.lit(None).cast("long").alias("pos"), "row")
    found = own.unionByName(more)
    sizes = found.groupBy("book", "line", "k").agg(F.count("*").alias("n"), F.min("pos").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("book", "line").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row an interval
    placed = found.join(sizes.select("book", "line", "k", "low", before.alias("before")), ["book", "line", "k"])
    changed = placed.select("book", "line", (F.col("before") + F.coalesce(F.col("pos") - F.col("low"), F.lit(0)) + 1).alias("place"), "of", "pos", "row")
    same = rows.join(hit, "book", "left_anti").select("book", "line", F.col("pos").alias("place"), F.col("line").alias("of"), "pos", F.lit(None).cast("string").alias("row"))
    return changed.unionByName(same)
