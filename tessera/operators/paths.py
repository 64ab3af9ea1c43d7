"""Trees and graphs by doubling and by frontiers: listings in path order, places in a sorted table, shortest ways by meeting in the middle."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .materialise import cut, handed_on, shared_folder


def listed(nodes: DataFrame, node: str, parent: str, ordinal: str, rounds: int = 64) -> DataFrame:
    """All columns, and root, key (array of longs) and depth: sorted by (root, key), a tree reads as a line of moves with its variations is printed. A node's first child (ordinal 0) goes
    on with its line; its other children are variations, each of which stands, with all that follows it, right after the first child that it could replace.

    A line is a chain of first children. A node's place in its chain, and the chain's head, come from pointers that double; a chain's key is that of the chain it leaves, the
    place where it leaves it and its ordinal, found by doubling over chains. So a key has two numbers for each variation around the node, not one for each move, and depth is how many these are.

    A node whose parent is null or missing is a root; variations without a first child beside them stand where it would; of children with one ordinal the order is not defined. Rows without
    a node are dropped. An empty table gives an empty result; a cycle raises."""
    n, p, k = F.col(node), F.col(parent), F.col(ordinal)
    own = nodes.where(n.isNotNull())
    here = own.select(n.alias("_up"))
    known = own.select(n.alias("_n"), p.alias("_p"), k.cast("long").alias("_k")).join(here, F.col("_p") == F.col("_up"), "left")
    first = F.col("_up").isNotNull() & (F.col("_k") == 0)
    base = cut(known.select("_n", F.col("_up").alias("_p"), "_k", F.when(first, F.col("_up")).alias("_to")))
    chains = _doubled(base.select("_n", "_to"), rounds)
    # a chain leaves another where the parent of its head stands: behind that, with the head's ordinal
    of = chains.select(F.col("_n").alias("_pn"), F.col("_h").alias("_ph"), F.col("_i").alias("_pi"))
    left = base.where("_to is null and _p is not null").join(of, F.col("_p") == F.col("_pn")).select(F.col("_n").alias("_l"), F.col("_ph").alias("_a"), F.array(F.col("_pi") + 1, "_k").alias("_e"))
    heads = chains.where("_n = _h").select(F.col("_n").alias("_c")).join(left, F.col("_c") == F.col("_l"), "left")
    now = cut(heads.select("_c", "_a", F.coalesce("_a", "_c").alias("_r"), F.coalesce("_e", F.array().cast("array<long>")).alias("_e")))
    for _ in range(rounds):
        if now.where("_a is not null").isEmpty():
            break
        up = now.select(F.col("_c").alias("_c2"), F.col("_a").alias("_a2"), F.col("_r").alias("_r2"), F.col("_e").alias("_e2"))
        going = now.where("_a is not null").join(up, F.col("_a") == F.col("_c2")).select("_c", F.col("_a2").alias("_a"), F.col("_r2").alias("_r"), F.concat("_e2", "_e").alias("_e"))
        now = handed_on(now.where("_a is null").unionByName(going))
    else:
        raise RuntimeError("the variations have a cycle")
    placed = chains.join(now, F.col("_h") == F.col("_c")).select("_n", F.col("_r").alias("root"), F.concat("_e", F.array(F.col("_i"), F.lit(0).cast("long"))).alias("key"))
    placed = placed.withColumn("depth", (F.size("key") / 2 - 1).cast("int"))
    return own.join(placed, n == F.col("_n")).select(*nodes.columns, "root", "key", "depth")


def _doubled(links: DataFrame, rounds: int) -> DataFrame:
    """_n, _h, _i: the end of the pointers (_n, _to) from each node, and how many lead there. Nodes that have reached an end take no further part."""
    now = cut(links.select("_n", "_to", F.coalesce("_to", "_n").alias("_h"), F.col("_to").isNotNull().cast("long").alias("_i")))
    for _ in range(rounds):
        if now.where("_to is not null").isEmpty():
            return now.drop("_to")
        up = now.select(F.col("_n").alias("_m"), F.col("_to").alias("_on"), F.col("_h").alias("_g"), F.col("_i").alias("_j"))
        going = now.where("_to is not null").join(up, F.col("_to") == F.col("_m")).select("_n", F.col("_on").alias("_to"), F.col("_g").alias("_h"), (F.col("_i") + F.col("_j")).alias("_i"))
        now = handed_on(now.where("_to is null").unionByName(going))
    raise RuntimeError("the pointers have a cycle")


def placed(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """All columns and each row's place (from 1) in the whole table's order: one sort by ranges, written once; the rows of the parts before a part are counted and added, so no task sees more than its part.
    Ties in `order` have no defined order among them."""
    path = f"{shared_folder(df.sparkSession)}/sorted-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = df.sparkSession.read.parquet(path)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    offsets = counts.select(F.col("_part").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_l", local).join(offsets, F.col("_part") == F.col("_q")).select(*df.columns, (F.col("_b") + F.col("_l")).alias(name))


def placed_within(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """All columns and each row's place (from 1) in its group: the place in the whole table by group and order, less that of the group's first row. No group is one task."""
    found = placed(df, [*by, *order], "_place")
    firsts = found.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min("_place").alias("_first"))
    match = F.lit(True)
    for c in by:
        match = match & found[c].eqNullSafe(firsts[f"_by_{c}"])
    return found.join(firsts, match).select(*df.columns, (F.col("_place") - F.col("_first") + 1).alias(name))


def shortest(edges: DataFrame, pairs: DataFrame, most: int) -> tuple[DataFrame, int]:
    """source, target, steps and way (an array of nodes) for each pair (source, target), and the rows of the largest frontier. edges: a, b, walked both ways.

    Two frontiers, from sources and from targets, grow in turn, the smaller one first, each by a join with the edges. A pair is done when its frontiers meet in a node, so each side goes half of the way:
    of d neighbours a node and six steps some d**3 nodes a side are seen and not d**6. A frontier's row is two numbers, a pair and a node; one aggregate tells what is new (a neighbour of the last level stands in
    the two levels before or is new), what is met and what is neither. Ways are made at the end and for found pairs alone, from the levels' nodes that lie on a shortest way. Nodes are numbered in their own order, so that the
    least numbers are the least nodes.
    The way is the least of the shortest ones. A pair further than `most` steps apart, or with a node that no edge has, has null steps and way (0 steps if both are the same node);
    pairs with a null are dropped, as are null ends of edges; repeated pairs and edges count once."""
    both = edges.where("a is not null and b is not null")
    named = cut(both.select(F.col("a").alias("_x"), F.col("b").alias("_y")).union(both.select("b", "a")).where("_x <> _y").distinct())
    names = cut(placed(named.select("_x").distinct(), ["_x"], "_id"))
    of = lambda name, number: names.select(F.col("_x").alias(name), F.col("_id").alias(number))
    links = cut(named.join(of("_x", "_from"), "_x").join(of("_y", "_to"), "_y").select("_from", "_to"))
    wanted = cut(pairs.where("source is not null and target is not null").select("source", "target").distinct().withColumn("_pair", F.monotonically_increasing_id()))
    asked = cut(wanted.where("source <> target").join(of("source", "_s"), "source").join(of("target", "_t"), "target").select("_pair", "_s", "_t"))
    levels = {end: [asked.select("_pair", F.col(number).alias("_node"))] for end, number in (("source", "_s"), ("target", "_t"))}
    front = {end: rows[0] for end, rows in levels.items()}
    sizes = dict.fromkeys(levels, asked.count())
    found, largest = [], max(1, *sizes.values())
    for gone in range(1, most + 1):
        if not min(sizes.values()):
            break
        end = min(sizes, key=lambda e: (sizes[e], e))
        other = "target" if end == "source" else "source"
        told = front[end].join(links, F.col("_node") == F.col("_from")).select("_pair", F.col("_to").alias("_node"), F.lit(1).alias("_is"))
        for rows, bit in [(front[other], 4), *[(rows, 2) for rows in levels[end][-2:]]]:
            told = told.unionByName(rows.select("_pair", "_node", F.lit(bit).alias("_is")))
        told = told.groupBy("_pair", "_node").agg(F.bit_or("_is").alias("_is")).where(F.col("_is").isin(1, 5) if gone < most else F.col("_is") == 5)
        told = cut(told)
        levels[end].append(told.select("_pair", "_node"))
        front[end] = levels[end][-1]
        met = told.where("_is = 5").select("_pair", "_node", F.lit(len(levels["source"]) - 1).alias("_a"), F.lit(len(levels["target"]) - 1).alias("_b"))
        done = cut(met.select("_pair").distinct())
        if (n := done.count()) > 0:
            found.append(met)
            front = {e: rows.join(F.broadcast(done) if n <= MOST_DONE else done, "_pair", "left_anti") for e, rows in front.items()}
        sizes = {e: rows.count() for e, rows in front.items()}
        largest = max(largest, *sizes.values())
    ways = wanted.where("source = target").select("_pair", F.lit(0).alias("steps"), F.array("source").alias("way"))
    if found:
        ways = ways.unionByName(_ways(reduce(DataFrame.unionByName, found), levels, links, asked, names))
    return wanted.join(ways, "_pair", "left").select("source", "target", "steps", "way"), largest


#: Pairs that are done in a round and go to all tasks; more of them leave the frontiers by a shuffle.
MOST_DONE = 1_000_000


def _ways(met: DataFrame, levels: dict[str, list[DataFrame]], links: DataFrame, asked: DataFrame, names: DataFrame) -> DataFrame:
    """_pair, steps, way of met pairs (_pair, _node, and the steps _a and _b to the node from source and target): back from where they met, the levels' nodes that lie on a shortest way; then forward, the least way to each."""
    met = cut(met)
    pairs = cut(met.select("_pair", (F.col("_a") + F.col("_b")).alias("_d")).distinct())
    nexts = lambda rows: rows.join(links, F.col("_node") == F.col("_from"))
    on = []
    for end, steps in (("source", "_a"), ("target", "_b")):
        here = None
        for k in range(len(levels[end]) - 1, -1, -1):
            starts = met.where(F.col(steps) == k).select("_pair", "_node")
            back = here and nexts(here).select("_pair", F.col("_to").alias("_node")).distinct().join(levels[end][k], ["_pair", "_node"], "left_semi")
            here = cut(starts.unionByName(back).distinct() if back else starts)
            on.append(here.join(pairs, "_pair").select("_pair", "_node", (F.lit(k) if end == "source" else F.col("_d") - k).alias("_k")))
    on = cut(reduce(DataFrame.unionByName, on).distinct())
    now, out = asked.join(pairs, "_pair").select("_pair", F.col("_s").alias("_node"), F.array("_s").alias("_way"), "_d"), []
    for k in range(1, sum(len(rows) - 1 for rows in levels.values()) + 1):
        grown = nexts(now.where(F.col("_d") >= k)).select("_pair", F.col("_to").alias("_node"), F.concat("_way", F.array("_to")).alias("_way"), "_d")
        grown = grown.join(on.where(F.col("_k") == k), ["_pair", "_node"], "left_semi")
        now = cut(grown.groupBy("_pair", "_node").agg(F.min("_way").alias("_way"), F.first("_d").alias("_d")))
        out.append(now.where(F.col("_d") == k).select("_pair", "_d", "_way"))
    told = reduce(DataFrame.unionByName, out).select("_pair", "_d", F.posexplode("_way").alias("_k", "_id")).join(names, "_id")
    return told.groupBy("_pair").agg(F.first("_d").alias("steps"), F.transform(F.array_sort(F.collect_list(F.struct("_k", "_x"))), lambda x: x["_x"]).alias("way"))
