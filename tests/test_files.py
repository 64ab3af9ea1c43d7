"""Game files by ranges, step events, edit scripts, recursive cuts and leaders against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import aggregates, clusters, layout, paths, scripts
from tessera.sources import gamefiles, tables
from tessera.streaming import steps, streams


def some_games(n, seed=0, end="\n"):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        tags = f'[Event "e{k}"]{end}[White "Müller {k}"]{end}' + (f'[Round "{k}"]{end}' if k % 3 else "")
        moves = " ".join(f"{m}.e4 e5 {{[Event in text}}" for m in range(1, rng.randrange(1, 60)))
        out.append(tags + end + (moves if k % 5 else "") + end * rng.randrange(1, 3))
    return out


@pytest.mark.parametrize("split,piece", [(50, 64), (777, 100), (4096, 1 << 20), (1 << 30, 7)])
def test_any_ranges_give_each_game_once(tmp_path, split, piece):
    for name, end in (("a", "\n"), ("b", "\r\n")):
        text = "no game here\n" + "".join(some_games(40, end=end))
        (tmp_path / name).write_bytes(text.encode())
        size = (tmp_path / name).stat().st_size
        got = [g for r in gamefiles.ranges({str(tmp_path / name): size}, split) for g in gamefiles.games(r, piece)]
        whole = [m.start() for m in re.finditer(rb"(?m)^\[Event ", text.encode())]
        assert [at for at, _ in got] == whole
        assert b"".join(raw for _, raw in got) == text.encode()[whole[0] :]


def test_game_source_equals_the_whole_file_reader(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"g{k}.pgn").write_text("".join(some_games(30, k)))
    (tmp_path / "_left_out").write_text(some_games(1)[0])
    (tmp_path / "empty.pgn").write_text("")
    path = f"file://{tmp_path}"
    got = gamefiles.read(spark, path, split=500)
    assert got.rdd.getNumPartitions() > 20
    plain = tables.games(spark, f"{path}/g*.pgn")
    clean = lambda df: sorted(map(str, df.select(F.map_entries("tags").alias("t"), F.trim(F.regexp_replace("moves", r"\s+", " ")).alias("m")).collect()))
    assert clean(got) == clean(plain) and got.count() == 90
    assert gamefiles.read(spark, path, "moves string").columns == ["moves"]
    (tmp_path / "none").mkdir()
    assert gamefiles.read(spark, f"{path}/none").count() == 0
    with pytest.raises(Exception, match="have the columns"):
        gamefiles.read(spark, path, "elo string").count()


def test_a_large_file_is_many_tasks(spark, tmp_path):
    game = some_games(1, 3)[0]
    with open(tmp_path / "big.pgn", "w") as f:
        for k in range(60_000):
            f.write(f'[Event "{k}"]\n\n1.e4 e5 {k}\n\n')
        f.write(game)
    df = gamefiles.read(spark, f"file://{tmp_path}", "tags map<string,string>, offset long", split=100_000)
    parts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 60_001 and len(parts) > 10 and max(r["count"] for r in parts) < 7_000


def test_games_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pgn").write_text("".join(some_games(5)))
    run = lambda: gamefiles.stream(spark, f"file://{tmp_path}/in", "offset long, moves string", 200).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/p").format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    with open(tmp_path / "in/a.pgn", "a") as f:  # appended games, and a new file
        f.write("".join(some_games(3, 1)))
    (tmp_path / "in/b.pgn").write_text("".join(some_games(4, 2)))
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 12


def test_step_events_come_in_order_and_change_nothing(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10 + k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start = lambda name: lambda s: s.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}-p").format("parquet").option("path", f"{tmp_path}/{name}").start()
    told = list(steps.stepped(streams.files(spark, f"{tmp_path}/in"), "step", {"n": F.count("*"), "top": F.max("id")}, start("heard")))
    assert told == [{"step": k, "n": 10 + k, "top": 10 * k + 9 + k} for k in range(3)]
    start("plain")(streams.files(spark, f"{tmp_path}/in")).awaitTermination()
    ids = lambda name: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
    assert ids("heard") == ids("plain")


def test_a_failing_stream_tells_its_steps_first(spark, tmp_path):
    for k in range(3):
        spark.range(k, k + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def sink(df, batch):
        assert df.count() and batch < 2

    heard = steps.stepped(streams.files(spark, f"{tmp_path}/in"), "s", {"n": F.count("*")}, lambda s: s.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/p").foreachBatch(sink).start())
    assert [next(heard)["step"], next(heard)["step"]] == [0, 1]
    with pytest.raises(RuntimeError, match="after step 1"):
        next(heard)


def test_a_build_by_parts_tells_each_part_and_builds_what_is_asked_for(spark, tmp_path):
    df = spark.range(30).withColumn("part", F.col("id") % 3)
    built = steps.built(streams.by_parts(df, "part", [2, 0, 1], lambda d: d), {"n": F.count("*"), "low": F.min("id")}, lambda p, rows: rows.write.parquet(f"{tmp_path}/{p}"))
    assert [next(built), next(built)] == [{"step": 0, "part": 2, "n": 10, "low": 2}, {"step": 1, "part": 0, "n": 10, "low": 0}]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0", "2"]


ENTRIES = "book string, seq int, op string, line string, to string, of string, at long, until long, before_of string, before long, row string"


def replayed(base, entries):
    """The script replayed row by row."""
    now = {}
    for book, line, pos in sorted(base):
        now.setdefault(book, {}).setdefault(line, []).append((line, pos, None))
    for book, _, op, line, to, of, at, until, before_of, before, row in sorted(entries, key=lambda e: (e[0], e[1])):
        lines = now.get(book, {})
        inside = lambda r: r[2] is None and r[0] == of and at <= r[1] < until
        place = lambda rows, o, p: next((k for k, r in enumerate(rows) if r[2] is None and r[0] == o and r[1] == p), None)
        if op == "split" and line in lines and to not in lines:
            k = place(lines[line], of, at)
            if k is not None:
                lines[to], lines[line] = lines[line][k:], lines[line][:k]
        elif op == "join" and line in lines and to in lines and line != to:
            lines[to] += lines.pop(line)
        elif op == "remove":
            for x in lines:
                lines[x] = [r for r in lines[x] if not inside(r)]
        elif op == "move" and line in lines:
            moved = sorted(r for rows in lines.values() for r in rows if inside(r))
            rest = {x: [r for r in rows if not inside(r)] for x, rows in lines.items()}
            k = len(rest[line]) if before is None else place(rest[line], before_of, before)
            if k is not None:
                rest[line][k:k] = moved
                now[book] = rest
        elif op == "add" and line in lines:
            k = len(lines[line]) if before is None else place(lines[line], before_of, before)
            if k is not None:
                lines[line].insert(k, (None, None, row))
    return sorted(((b, line, k + 1, *r) for b, lines in now.items() for line, rows in lines.items() for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed", range(5))
def test_scripts_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    base = [(b, f"l{n}", p) for b in "abc" for n in range(4) for p in range(1, rng.randrange(3, 9))]
    length = {(b, n): max(p for x, m, p in base if (x, m) == (b, n)) for b, n, _ in base}
    entries = []
    for k in range(40):
        b = rng.choice("ab")
        of, line, to = (f"l{rng.randrange(4)}" for _ in range(3))
        at = rng.randrange(1, length[b, of] + 1)
        before_of = rng.choice([None, f"l{rng.randrange(4)}"])
        before = before_of and rng.randrange(1, length[b, before_of] + 1)
        op = rng.choice(["split", "join", "move", "remove", "add", "move"])
        line = rng.choice([line, f"n{rng.randrange(k + 1)}"])
        entries.append((b, k, op, line, f"n{k}" if op == "split" else to, of, at, min(at + rng.randrange(1, 3), length[b, of] + 1), before_of, before, f"new {k}"))
    got = scripts.derived(spark.createDataFrame([*base, (None, "l0", 1)], "book string, line string, pos int"), spark.createDataFrame(entries, ENTRIES)).select("book", "line", "place", "of", "pos", "row").collect()
    assert sorted(map(tuple, got), key=str) == replayed(base, entries)


def test_an_empty_script_gives_the_base(spark):
    df = spark.createDataFrame([("a", "l", 1), ("a", "l", 2)], "book string, line string, pos int")
    got = scripts.derived(df, spark.createDataFrame([], ENTRIES)).collect()
    assert sorted((r.line, r.place, r.of) for r in got) == [("l", 1, "l"), ("l", 2, "l")]


def plain_cuts(boxes, down, across, axis=0, tried=False):
    """Ids in the order of recursive cuts. boxes: id, x0, y0, x1, y1."""
    low, high, gap = ((2, 4, down), (1, 3, across))[axis]
    parts, top = [], None
    for b in sorted(boxes, key=lambda b: (b[low], b[0])):
        if top is None or b[low] > top + gap:
            parts.append([])
        parts[-1].append(b)
        top = b[high] if top is None else max(top, b[high])
    if len(parts) == 1:
        return [b[0] for b in sorted(boxes, key=lambda b: (b[2], b[1], b[0]))] if tried else plain_cuts(boxes, down, across, 1 - axis, True)
    return [i for p in parts for i in plain_cuts(p, down, across, 1 - axis)]


def test_recursive_cuts(spark):
    rng = random.Random(7)
    pages = {}
    for page in range(12):
        boxes = []
        for k in range(rng.randrange(1, 25)):
            x, y = rng.choice([0, 0, 60, 120]) + rng.random() * 5, rng.randrange(0, 300)
            boxes.append((k, x, float(y), x + rng.choice([45, 45, 45, 110]), float(y + rng.randrange(5, 25))))
        pages[page] = boxes
    rows = [(p, *b) for p, boxes in pages.items() for b in boxes] + [(0, 99, None, 1.0, 2.0, 3.0)]
    got = layout.cut_order(spark.createDataFrame(rows, "page int, id int, x0 double, y0 double, x1 double, y1 double"), "page", "id", across=2.0, down=1.0).orderBy("page", "place").collect()
    for page, boxes in pages.items():
        assert [r.id for r in got if r.page == page] == plain_cuts(boxes, 1.0, 2.0)


def plain_leaders(rows, within):
    """The definition, row by row: (order, vector) of a group."""
    x = np.array([v for _, v in sorted(rows)], float)
    centres, sizes = [], []
    for v in x:
        d = [float(((v - c) ** 2).sum()) for c in centres]
        k = int(np.argmin(d)) if d else -1
        if k >= 0 and d[k] <= within**2:
            sizes[k] += 1
            centres[k] = centres[k] + (v - centres[k]) / sizes[k]
        else:
            centres.append(v.copy())
            sizes.append(1)
    c = np.array(centres)
    label = np.array([int(np.argmin(((c - v) ** 2).sum(1))) for v in x])
    c = np.array([x[label == k].mean(0) if (label == k).any() else c[k] for k in range(len(c))])
    root = list(range(len(c)))
    for a in range(len(c)):
        for b in range(a):
            if ((c[a] - c[b]) ** 2).sum() <= within**2:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    names = {r: k for k, r in enumerate(dict.fromkeys(root[k] for k in label))}
    return [names[root[k]] for k in label]


@pytest.mark.parametrize("most", [1 << 26, 600])
def test_leaders_equal_the_definition(spark, monkeypatch, most):
    monkeypatch.setattr(clusters, "CENTRES", most)
    monkeypatch.setattr(clusters, "BLOCK", 64)
    monkeypatch.setattr(clusters.nearest, "__defaults__", (most,))
    rng = np.random.default_rng(4)
    rows = []
    for g, n, wide in (("hot", 700, 3.0), ("b", 60, 0.5), (None, 30, 2.0)):
        spots = rng.normal(size=(8, 3)) * wide
        rows += [(g, k, (spots[rng.integers(8)] + rng.normal(size=3) * 0.6).tolist()) for k in range(n)]
    df = spark.createDataFrame([*rows, ("b", 900, None)], "g string, k int, v array<double>").repartition(5)
    got = {(r.g, r.k): r.cluster for r in clusters.leaders(df, "g", "k", "v", 1.5).collect()}
    for g in ("hot", "b", None):
        own = [(k, v) for x, k, v in rows if x == g]
        assert [got[g, k] for k, _ in sorted(own)] == plain_leaders(own, 1.5)
    assert got["b", 900] is None and len(set(got.values())) > 4
    assert clusters.leaders(df.limit(0), "g", "k", "v", 1.5).collect() == []


def test_learnt_code_is_shares_then_one_to_one(spark):
    seen = [("x", "a")] * 10 + [("x", "b")] * 9 + [("y", "a")] * 8 + [("y", "c")] * 3 + [("z", "b")] * 2
    got = aggregates.learnt_code(spark.createDataFrame(seen, "s string, v string"), "s", "v", 0.2, 3).collect()
    assert sorted((r.s, r.v, r.n) for r in got) == [("x", "a", 10), ("y", "c", 3)]


def test_places_within_groups(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(50), k) for k in range(400)]
    got = paths.placed_within(spark.createDataFrame(rows, "g string, x int, k int"), ["g"], ["x", "k"]).collect()
    for g in ("hot", "a", None):
        own = sorted((x, k) for h, x, k in rows if h == g)
        assert [(r.x, r.k, r.place) for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == [(*o, n + 1) for n, o in enumerate(own)]
    assert sorted(r.place for r in got if r.g is None) == list(range(1, sum(r[0] is None for r in rows) + 1))
