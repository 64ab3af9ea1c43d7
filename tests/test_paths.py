"""Operators without an ordered walk against plain versions that walk: chains, bands, series, runs and depth, beams, listings, shortest ways."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from tessera.operators import chains, lattice, paths, runs, windows


def plain_bands(rows, gap):
    out = {}
    for g in {r[0] for r in rows}:
        band, first = -1, None
        for y in sorted(r[2] for r in rows if r[0] == g and r[2] is not None and r[2] == r[2]):
            if first is None or y > first + gap:
                band, first = band + 1, y
            out[g, y] = band
    return [(g, i, y, out.get((g, y))) for g, i, y in rows]


@pytest.mark.parametrize("gap", [0.0, 1.5, 40.0])
def test_bands(spark, gap):
    rng = random.Random(1)
    rows = [("hot" if k % 10 else rng.choice(["a", None]), k, rng.choice([round(rng.uniform(-50, 400), 1), 7.0])) for k in range(500)]
    rows += [("a", 900, None), ("a", 901, float("nan")), ("one", 902, -0.0), ("one", 903, 0.0)]
    got = [tuple(r) for r in chains.row_groups(spark.createDataFrame(rows, "g string, id int, y double"), "g", "y", gap).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_bands(rows, gap)))


def test_bands_of_an_empty_table_and_no_python(spark, capsys):
    df = spark.createDataFrame([], "g int, y double")
    assert chains.row_groups(df, "g", "y", 1.0).collect() == []
    assert "Python" not in chains.row_groups(spark.range(20).selectExpr("id % 2 g", "id * 1.0D y"), "g", "y", 1.0)._jdf.queryExecution().toString()


def test_a_cycle_raises(spark):
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "g int, n int, t int")
    with pytest.raises(RuntimeError):
        chains.reached_from(links.select("g", "n"), links, "g", "n", "t", rounds=4)


def plain_series(rows):
    """Rows (group, page, label, id) in the main series."""
    out = set()
    key = lambda x: (tuple(int(n) for n in re.findall(r"[0-9]+", x or "")) or (0,), x or "")
    for g in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], *key(r[2]), r[3])):
            now = key(r[2])
            if last is None:
                ok = now[0] in ((1,), (1, 1))
            elif len(now[0]) != len(last[0]) or now <= last:
                ok = False
            elif len(now[0]) == 1:
                ok = now[0][0] <= last[0][0] + 12
            else:
                ok = now[0][1] <= last[0][1] + 12 if now[0][0] == last[0][0] else now[0][0] == last[0][0] + 1 and now[0][1] <= 2
            if ok:
                last = now
                out.add(r)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_main_series(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in ("hot", "b", None):
        chapter = rng.random() < 0.5
        for k in range(150 if g == "hot" else 25):
            n = k // 3 + rng.randrange(1, 4)
            label = f"{1 + k // 20}.{k % 20 + rng.randrange(3)}" if chapter or rng.random() < 0.1 else f"{n}{rng.choice(['', '', 'a', 'b'])}"
            rows.append((g, k // 7, rng.choice([label, label, str(rng.randrange(1, 15)), None if k % 11 == 0 else label, "1.2.3"]), k))
    got = {tuple(r)[:4] for r in chains.main_series(spark.createDataFrame(rows, "g string, page int, label string, id int"), "g", ["page"], "label", ["id"]).collect() if r.main}
    assert got == plain_series(rows) and len(got) > 5


def test_links_of_a_series_are_numbers(spark, monkeypatch):
    """What a series' links and jumps are written as has no columns of the order, and none of a group without a start; steps go over cells of numbers and from chapter to chapter."""
    written, cut = [], chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: written.append(cut(df)) or written[-1])
    rng = random.Random(7)
    rows = [(f"g{k % 2}", k // 9, f"{1 + k // 60}.{(k % 60) // 2 + rng.randrange(14)}", k) for k in range(240)] + [("g2", k // 5, str(k + rng.randrange(15)), 1000 + k) for k in range(60)]
    rows += [("g0", 0, "1.1", 2000), ("g1", 0, "1", 2001), ("g2", 0, "1", 2002)] + [("no", k, str(k + 2), 3000 + k) for k in range(300)]
    got = {tuple(r)[:4] for r in chains.main_series(spark.createDataFrame(rows, "g string, page int, label string, id int"), "g", ["page"], "label", ["id"]).collect() if r.main}
    assert got == plain_series(rows) and len(got) > 12
    links = [df for df in written if "_t" in df.columns]
    assert links and all(dict(df.dtypes)["_n"] == "bigint" for df in links) and max(df.count() for df in links) < 300


def plain_tokens(text):
    out = [(m.start(), m.group()) for m in re.finditer(r"[0-9]+|[()\[\]{}]", text or "")]
    return [(at, raw) for at, raw in out if len(raw) <= 3]


def plain_runs(rows):
    out = []
    for doc, text in rows:
        stacks, last, run = {k: [] for k in runs.LIVES}, None, None
        for at, raw in plain_tokens(text):
            depth = sum(len([b for b in s if at - b <= runs.LIVES[k]]) for k, s in stacks.items())
            if raw in runs.LIVES:
                stacks[raw].append(at)
            elif raw in runs.CLOSES:
                stacks[runs.CLOSES[raw]] = stacks[runs.CLOSES[raw]][:-1]
            else:
                v = int(raw)
                if run is None or not 0 <= v - last <= 2:
                    run = [doc, at, at, v, v, 0, depth]
                    out.append(run)
                run[2], run[4], run[5], last = at, v, run[5] + 1, v
                continue
            run = None
    return [tuple(r) for r in out]


@pytest.mark.parametrize("size,piece", [(64, 256), (1000, 4096), (runs.SLICE, runs.PIECE)])
def test_numbered_runs(spark, size, piece):
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice(["(", ")", "[", "]", "{", "}", " ", "é𝄞x ", "12345 ", "wörds go on here ", f"{rng.randrange(9)}", f" {k // 9}. ", " ", "x" * 90]) for k in range(n))
    rows = [(1, say(900)), (2, say(40)), (3, None), (4, ""), (None, "7 8 10 (11) 12"), (5, "1" * 70 + " 2"), (6, "(" * 30 + "x" * 590 + " 4 5 " + "x" * 50 + "6" + ")" * 40 + "7")]
    got = runs.numbered_runs(spark.createDataFrame(rows, "d long, t string"), "d", "t", size, piece)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_runs(rows), key=str)


def test_a_long_text_is_many_cells(spark):
    text = "".join(f"{k % 900} ({'word ' * 3}) " for k in range(60_000))
    df = spark.createDataFrame([(1, text)], "d long, t string")
    cells = runs.tokens(df, "d", "t").groupBy("cell").count()
    assert cells.count() == -(-len(text) // runs.SLICE) and cells.agg(F.max("count")).first()[0] < 2_000
    assert runs.numbered_runs(df, "d", "t").count() == 60_000
    assert runs.numbered_runs(df.limit(0), "d", "t").collect() == []


def plain_ways(steps, moves):
    """All ways of each key and their costs."""
    out = {}
    for key in {s[0] for s in steps if s[0] is not None}:
        at = {}
        for k, pos, state, cost in steps:
            if k == key and state is not None:
                at.setdefault(pos, {})[state] = min(cost, at.get(pos, {}).get(state, cost))
        ways = []
        for way in itertools.product(*[sorted(at[p]) for p in sorted(at)]):
            pairs = list(itertools.pairwise(way))
            if all(p in moves for p in pairs):
                ways.append((sum(at[p + 1][s] for p, s in enumerate(way)) + sum(moves[p] for p in pairs), list(way)))
        out[key] = sorted(ways)
    return out


def some_lattice(seed):
    rng = random.Random(seed)
    states = "abcd"
    moves = {(x, y): rng.randrange(30) for x in states for y in states if rng.random() < 0.8}
    steps = [(k, p, s, rng.randrange(20)) for k in range(12) for p in range(1, rng.randrange(2, 7)) for s in rng.sample(states, rng.randrange(1, 5))]
    return [*steps, steps[0], (None, 1, "a", 0), (3, 1, None, 0)], moves


@pytest.mark.parametrize("seed", range(3))
def test_an_unlimited_beam_finds_all_ways(spark, seed):
    steps, moves = some_lattice(seed)
    got = lattice.beam(spark.createDataFrame(steps, "key int, pos int, state string, cost int"), spark.createDataFrame([(*p, c) for p, c in moves.items()], "before string, after string, cost int"), 100_000).collect()
    ways = plain_ways(steps, moves)
    assert {(r.key, r.place, r.cost, tuple(r.way)) for r in got} == {(k, n + 1, c, tuple(w)) for k, found in ways.items() for n, (c, w) in enumerate(found)}


def test_the_cap_on_old_branches_leaves_room(spark):
    """Two early readings that never meet again, each with many late ones, fill the beam; with the cap a late alternative of the best one, dearer at first, is there when it wins."""
    steps = [(1, 1, "a", 0), (1, 1, "b", 1)] + [(1, p, "m", 0) for p in range(2, 6)] + [(1, 6, "x", 0), (1, 6, "y", 5), (1, 7, "x", 100), (1, 7, "y", 0)]
    moves = [(p, q, 0) for p, q in [("a", "m"), ("b", "m"), ("m", "m"), ("m", "x"), ("m", "y"), ("x", "x"), ("y", "y")]]
    df, mv = spark.createDataFrame(steps, "key int, pos int, state string, cost int"), spark.createDataFrame(moves, "before string, after string, cost int")
    plain = lattice.beam(df, mv, 2, age=3).orderBy("place").collect()
    capped = lattice.beam(df, mv, 2, old=0, age=3).orderBy("place").collect()
    assert plain[0].cost == 100 and capped[0].cost == 5 and capped[0].way[-1] == "y"
    assert lattice.beam(df.limit(0), mv, 2).collect() == []


def plain_beam(steps, moves, width, old, age):
    out = {}
    for key in {s[0] for s in steps if s[0] is not None}:
        at = {}
        for k, pos, state, cost in steps:
            if k == key and state is not None:
                at.setdefault(pos, {})[state] = min(cost, at.get(pos, {}).get(state, cost))
        ways = [(0, [])]
        for pos in range(1, max(at) + 1):
            ways = sorted((c + (moves[w[-1], s] if w else 0) + own, [*w, s]) for c, w in ways for s, own in at.get(pos, {}).items() if not w or (w[-1], s) in moves)
            if len(ways) > width:
                far = [pos > age and w[: pos - age] != ways[0][1][: pos - age] for _, w in ways]
                ways = [w for k, w in enumerate(ways) if not far[k] or sum(far[: k + 1]) <= old][:width]
        out[key] = ways
    return out


@pytest.mark.parametrize("most_states", [64, 1])
def test_a_long_beam_is_one_fold(spark, most_states):
    """Moves by array and by join give the same ways as a walk; keys of forty positions take no more jobs than short ones."""
    rng, states = random.Random(most_states), "abcde"
    moves = {(x, y): rng.randrange(9) for x in states for y in states if rng.random() < 0.9}
    steps = [(k, p, s, rng.randrange(9)) for k in range(8) for p in range(1, rng.choice([3, 20, 40]) + 1) for s in rng.sample(states, rng.randrange(2, 6))]
    steps = [*steps, (3, 2, "z", 0), (90, 1, "a", 1), (90, 3, "a", 1), (91, 1, "z", 4), (92, 0, "a", 1)]  # a gap, states without moves, a position before the first
    moves_df = spark.createDataFrame([(*p, c) for p, c in moves.items()], "before string, after string, cost int")
    for old, age in ((1, 2), (0, 0), (None, 3)):
        spark.sparkContext.setJobGroup(f"beam-{most_states}-{old}", "")
        got = lattice.beam(spark.createDataFrame(steps, "key int, pos int, state string, cost int"), moves_df, 4, old=old, age=age, most_states=most_states).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"beam-{most_states}-{old}")
        assert 0 < len(jobs) <= 16
        ways = plain_beam([s for s in steps if s[1] > 0], moves, 4, 99 if old is None else old, age)
        assert {(r.key, r.place, r.cost, tuple(r.way)) for r in got} == {(k, n + 1, c, tuple(w)) for k, found in ways.items() for n, (c, w) in enumerate(found)}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def plain_listing(nodes):
    """Ids in the order in which trees of (id, parent, ordinal) are printed."""
    ids = {n for n, _, _ in nodes}
    kids = {}
    for n, p, k in nodes:
        kids.setdefault(p if p in ids else None, []).append((k if p in ids else 0, n))
    out = []

    def walk(n, depth):
        out.append((n, depth))
        go(n, depth)

    def go(n, depth):
        below = sorted(kids.get(n, []))
        first = [c for k, c in below if k == 0]
        out.extend((c, depth) for c in first)
        for k, c in below:
            if k:
                walk(c, depth + 1)
        for c in first:
            go(c, depth)

    for _, root in sorted(kids.get(None, [])):
        walk(root, 0)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_listing(spark, seed):
    rng = random.Random(seed)
    nodes, free = [(0, None, 0)], {0: 0}
    for n in range(1, 160):
        p = n - 1 if rng.random() < 0.6 and free[n - 1] == 0 else rng.randrange(n)
        nodes.append((n, p, free[p]))
        free[p], free[n] = free[p] + 1, 0
    nodes += [(500, 499, 3), (501, 500, 1)]  # a missing parent is a root; a variation without a first child
    got = paths.placed(paths.listed(spark.createDataFrame(nodes, "id int, parent int, k int"), "id", "parent", "k"), ["root", "key"]).orderBy("place").collect()
    assert [(r.id, r.depth) for r in got] == plain_listing(nodes) and [r.place for r in got] == list(range(1, len(nodes) + 1))


def test_listing_of_a_long_line_has_short_keys(spark):
    nodes = spark.range(3000).selectExpr("id", "id - 1 parent", "0 k")
    got = paths.listed(nodes, "id", "parent", "k").agg(F.max(F.size("key")), F.count("*")).first()
    assert tuple(got) == (2, 3000)
    assert paths.listed(nodes.limit(0), "id", "parent", "k").collect() == []
    with pytest.raises(RuntimeError):
        paths.listed(spark.createDataFrame([(1, 2, 0), (2, 1, 0)], "id int, parent int, k int"), "id", "parent", "k", rounds=5)


def plain_shortest(edges, pairs, most):
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for s, t in {p for p in pairs if None not in p}:
        ways = [[s]]
        for steps in range(most + 1):
            hit = sorted(w for w in ways if w[-1] == t)
            if hit:
                out.append((s, t, steps, tuple(hit[0])))
                break
            ways = list({w[-1] + "|" + v: [*w, v] for w in sorted(ways, reverse=True) for v in near.get(w[-1], ()) if v not in w}.values()) if steps < most else []
            best = {}
            for w in sorted(ways):
                best.setdefault(w[-1], w)
            ways = list(best.values())
        else:
            out.append((s, t, None, None))
    return out


@pytest.mark.parametrize("seed,most", [(0, 6), (1, 6), (2, 3), (3, 1)])
def test_shortest_ways(spark, seed, most):
    rng = random.Random(seed)
    edges = [(f"s{rng.randrange(30)}", f"o{rng.randrange(40)}") for _ in range(55)] + [(None, "o1"), ("s1", None), ("s2", "s2")]
    pairs = [(f"s{rng.randrange(30)}", f"s{rng.randrange(30)}") for _ in range(40)] + [("s1", "nowhere"), (None, "s1"), ("s3", "s3")]
    got, largest = paths.shortest(spark.createDataFrame([*edges, edges[0]], "a string, b string"), spark.createDataFrame([*pairs, pairs[0]], "source string, target string"), most)
    got = {(r.source, r.target, r.steps, r.way and tuple(r.way)) for r in got.collect()}
    assert got == set(plain_shortest(edges, pairs, most)) and largest >= 1


def test_frontiers_of_shortest_ways_are_numbers(spark, monkeypatch):
    """What is written by the size of the frontiers has no names and no ways, and the ways are the same."""
    written, cut = [], paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: written.append(cut(df)) or written[-1])
    rng = random.Random(5)
    edges = [(f"s{rng.randrange(60)}", f"o{rng.randrange(80)}") for _ in range(160)]
    pairs = [(f"s{k}", f"s{(7 * k + 3) % 60}") for k in range(60)]
    for most in (4, 6):
        got, largest = paths.shortest(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame(pairs, "source string, target string"), most)
        assert {(r.source, r.target, r.steps, r.way and tuple(r.way)) for r in got.collect()} == set(plain_shortest(edges, pairs, most))
    assert largest > 2 * len(edges)
    for df in written:
        if any(f.dataType.typeName() in ("string", "array") for f in df.schema):
            assert df.count() <= 2 * len(edges)


def test_estimates_of_doubled_pointers_stay_small(spark):
    """Pointers that double join their own rounds; the plan's estimate of their size does not double its digits each time."""
    bits = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    links = spark.range(100).select(F.lit(1).alias("g"), F.col("id").alias("n"), F.when(F.col("id") < 99, F.col("id") + 1).alias("t"))
    reached = chains.reached_from(links.where("n = 0").select("g", "n"), links, "g", "n", "t")
    assert bits(reached) <= 1024 and reached.count() == 100
    ok = windows.path_all(links.select("n", (F.col("n") - 1).alias("up"), F.lit(True).alias("ok")), "n", "up", "ok")
    assert bits(ok) <= 1024 and ok.where("path_ok").count() == 100
    # each variation leaves the one before it
    nodes = spark.range(1, 60).select(F.explode(F.array(F.struct(F.col("id"), (F.col("id") - 1).alias("parent"), F.lit(1).alias("k")), F.struct((F.col("id") + 1000).alias("id"), (F.col("id") - 1).alias("parent"), F.lit(0).alias("k")))).alias("r")).select("r.*")
    listed = paths.listed(nodes, "id", "parent", "k")
    assert bits(listed) <= 1024 and listed.agg(F.count("*"), F.max("depth")).first() == (118, 58)
