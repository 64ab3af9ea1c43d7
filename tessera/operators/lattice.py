"""Beam search over a lattice: readings are gathered by key, and each key's positions are folded in Spark's own array functions, with a beam of ways as the state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialise import cut

#: Up to so many states that have moves, the moves are an array of all pairs in the plan; beyond that each reading gets those that lead to it by a join.
MOST_STATES = 64


def beam(steps: DataFrame, moves: DataFrame, width: int, old: int | None = None, age: int = 12, most_states: int = MOST_STATES) -> DataFrame:
    """The best readings of each key: key, place (from 1), cost, way (array of states).

    steps: key, pos (1, 2, ... without a gap), state, cost, the readings of each position; moves: before, after, cost, for each pair of states that may follow one another.
    A way costs what its steps and moves do; a position extends each hypothesis by its readings and the moves to them. At most `width` ways a key go on, the cheapest ones, equal
    costs by their states in order. Of these at most `old` (if given and below width) are ways that parted from the best one more than `age` positions ago, so that
    two readings that never meet again don't fill the beam; the cap acts only where there are more ways than the width. Ways are told apart by hashes of their beginnings, of which the last `age` + 1 are kept.

    The readings are shuffled once, by key, and a key's are one row: what goes from position to position stays in its task, and neither jobs nor written rows grow with the number of positions. A task holds one
    key's readings and width x states ways. Rows with a null key, position or state are dropped; repeated readings of a position keep the cheapest; a key whose ways all come to an end before its last
    position has no row; an empty table gives an empty result."""
    follow = cut(moves.where("before is not null and after is not null").groupBy("before", "after").agg(F.min(F.col("cost").cast("long")).alias("move")))
    lattice = steps.where("key is not null and pos >= 1 and state is not null").select("key", "pos", "state", F.col("cost").cast("long").alias("cost")).repartition("key")
    lattice = lattice.groupBy("key", "pos", "state").agg(F.min("cost").alias("own"))
    states = follow.select(F.col("before").alias("_state")).union(follow.select("after")).distinct()
    known = [r[0] for r in states.limit(most_states + 1).collect()]
    if len(known) <= most_states:
        at = {s: k for k, s in enumerate(known)}
        costs = {(at[r.before], at[r.after]): r.move for r in follow.collect()}  # most_states squared at most
        table = F.array(*[F.lit(costs.get((a, b))).cast("long") for a in range(len(known)) for b in range(len(known))]).cast("array<long>")
        codes = F.array(*[F.lit(s) for s in known]).cast(f"array<{follow.schema['before'].dataType.simpleString()}>")
        lattice = lattice.withColumn("to", F.array_position(codes, F.col("state")).cast("int") - 1)
        move = lambda h, s: F.when((h["at"] >= 0) & (s["to"] >= 0), F.get(table, h["at"] * len(known) + s["to"]))
        reached = lambda s: s["to"]
    else:
        into = follow.groupBy(F.col("after").alias("_after")).agg(F.collect_list(F.struct("before", "move")).alias("to"))
        lattice = lattice.join(into, F.col("state") == F.col("_after"), "left").drop("_after").repartition("key")
        move = lambda h, s: F.get(F.filter(s["to"], lambda m: m["before"] == h["at"]), F.lit(0))["move"]
        reached = lambda s: s["state"]
    readings = lattice.groupBy("key", "pos").agg(F.sort_array(F.collect_list(F.struct("state", "own", "to"))).alias("readings"))
    lines = readings.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "readings"))).alias("line"))
    state = steps.schema["state"].dataType.simpleString()
    none = f"array<struct<cost:bigint,place:int,way:array<{state}>,at:{'int' if len(known) <= most_states else state},begun:array<bigint>>>"
    begin = F.array(F.struct(F.lit(0).alias("cost"), F.lit(1).alias("place"), F.array().alias("way"), F.lit(None).alias("at"), F.array().alias("begun"))).cast(none)

    def grow(ways: Column, step: Column) -> Column:
        more = F.flatten(F.transform(ways, lambda h, k: _extended(h, k, step["readings"], move, age)))
        kept = _let(F.sort_array(F.filter(more, lambda c: c["led"])), lambda found: _pruned(found, width, old))
        on = _let(kept, lambda best: _carried(best, ways, step["readings"], reached, age))
        return F.when(step["pos"] == F.size(F.get(ways, F.lit(0))["way"]) + 1, on).otherwise(F.array().cast(none)).cast(none)

    found = lines.select("key", F.posexplode(F.aggregate("line", begin, grow)).alias("_k", "_w"))
    return found.select("key", (F.col("_k") + 1).alias("place"), "_w.cost", "_w.way")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _extended(way: Column, k: Column, readings: Column, move: Callable, age: int) -> Column:
    """What a way may go on with, in numbers alone: they sort by cost and states, since `place` is the way's among all by states and readings stand by state.
    `far` is the hash of the beginning `age` positions ago, null as long as there is none."""
    size = F.size(way["begun"])

    def next_one(s: Column, r: Column) -> Column:
        far = F.get(way["begun"], size - age) if age else F.xxhash64(F.get(way["begun"], size - 1), s["state"])
        step = F.when(size == 0, F.lit(0)).otherwise(move(way, s))
        return F.struct((way["cost"] + step + s["own"]).alias("cost"), way["place"].alias("place"), r.alias("r"), k.alias("k"), far.alias("far"), step.isNotNull().alias("led"))

    return F.transform(readings, next_one)


def _pruned(found: Column, width: int, old: int | None) -> Column:
    """The first `width` of sorted ways, at most `old` of them parted from the first one long ago."""
    if old is None or old >= width:
        return F.slice(found, 1, width)
    best = F.get(found, F.lit(0))["far"]
    parted = lambda c: F.coalesce(c["far"] != best, F.lit(False))
    capped = F.sort_array(F.concat(F.filter(found, lambda c: ~parted(c)), F.slice(F.filter(found, parted), 1, old)))
    return F.slice(F.when((F.size(found) > width) & best.isNotNull(), capped).otherwise(found), 1, width)


def _carried(best: Column, ways: Column, readings: Column, reached: Callable, age: int) -> Column:
    """The ways that go on, one state longer, with the hashes of their last age + 1 beginnings."""
    by_states = F.sort_array(F.transform(best, lambda c: F.struct(c["place"], c["r"])))

    def longer(c: Column, order: Column) -> Column:
        way, s = F.get(ways, c["k"]), F.get(readings, c["r"])
        size, begun = F.size(way["begun"]), way["begun"]
        begun = F.slice(F.concat(begun, F.array(F.xxhash64(F.get(begun, size - 1), s["state"]))), F.greatest(size + 1 - age, F.lit(1)), age + 1)
        place = F.array_position(order, F.struct(c["place"], c["r"])).cast("int")
        return F.struct(c["cost"].alias("cost"), place.alias("place"), F.concat(way["way"], F.array(s["state"])).alias("way"), reached(s).alias("at"), begun.alias("begun"))

    return _let(by_states, lambda order: F.transform(best, lambda c: longer(c, order)))


def move_costs(rows: DataFrame, by: str, at: list[str], state: str, unit: int = 1000) -> DataFrame:
    """before, after, cost: what a step from one state to the next costs, from how often it is taken: unit x (1 - share of all steps from `before`), rounded down. Pairs that never occur have no row."""
    pairs = rows.select(F.lag(state).over(Window.partitionBy(by).orderBy(*at)).alias("before"), F.col(state).alias("after")).where("before is not null and after is not null")
    counts = pairs.groupBy("before", "after").agg(F.count("*").alias("n"))
    of = F.sum("n").over(Window.partitionBy("before"))
    return counts.withColumn("_of", of).select("before", "after", F.expr(f"({unit} * (_of - n)) div _of").alias("cost"))
