"""Operators on small golden tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from tessera.functions import scalars
from tessera.operators import aggregates, chains, clusters, corrections, joins, quality, records, windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_assign_equals_greedy(spark):
    rng = random.Random(3)
    pairs = [(a, b, rng.randrange(6)) for a in range(6) for b in range(6)]
    taken, left, right = [], set(), set()
    for a, b, n in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            taken.append((a, b, n))
            left.add(a)
            right.add(b)
    assert rows(aggregates.assign(spark.createDataFrame(pairs, "a int, b int, n int"), "a", "b", "n")) == sorted(taken, key=str)


def test_otsu(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 1, 2, 2, 9, 9, 10)], "g int, v int")
    assert rows(aggregates.otsu(df, ["g"], "v")) == [(1, 2)]


def test_percentile_is_by_index(spark):
    df = spark.createDataFrame([(1, v) for v in (5, 1, 3, 3, None)], "g int, v int")
    assert rows(aggregates.index_percentile(df, ["g"], "v", 0.9, "p")) == [(1, 3)]


def test_votes_follow_odds(spark):
    df = spark.createDataFrame([(1, "K"), (1, "K")], "g int, v string")
    assert rows(aggregates.votes(df, "g", "v", 5))[0][4] == pytest.approx(0.8)


def test_upsert_ties(spark):
    s = spark.createDataFrame([(1, 10, 1, "a"), (2, 10, 1, "b")], "k int, t int, i int, v string")
    n = spark.createDataFrame([(1, 10, 2, "c"), (1, 10, 3, "d"), (2, 9, 2, "e"), (3, 1, 1, "f")], "k int, t int, i int, v string")
    assert [(r.k, r.v) for r in records.upsert(s, n, ["k"], "t", "i").orderBy("k").collect()] == [(1, "d"), (2, "b"), (3, "f")]


def test_merged_ranges(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 4, 5), (1, 4, 5), (1, 8, 9), (1, 2, 2)], "g int, a int, b int")
    assert rows(windows.merged_ranges(df, ["g"], "a", "b")) == [(1, 1, 5), (1, 8, 9)]


def test_main_series_is_walked_by_page_and_number(spark):
    """A series starts at 1, goes on by at most twelve, and chapter-numbered labels start the next chapter near 1."""
    labels = [(1, 1, "5"), (1, 1, "1"), (1, 2, "2"), (1, 2, "40"), (1, 3, "14a"), (1, 3, "15"), (1, 3, "3"), (2, 1, "1.1"), (2, 1, "1.9"), (2, 2, "2.3"), (2, 2, "2.1"), (2, 3, "2.4"), (2, 3, "7"), (3, 1, "2"), (3, 1, "x")]
    df = spark.createDataFrame([(g, p, x, k) for k, (g, p, x) in enumerate(labels)], "book int, page int, label string, k int")
    main = {(r.book, r.label) for r in chains.main_series(df, "book", ["page"], "label", ["k"]).collect() if r.main}
    assert main == {(1, "1"), (1, "5"), (1, "14a"), (1, "15"), (2, "1.1"), (2, "1.9"), (2, "2.1"), (2, "2.3"), (2, "2.4")}


def test_assignment_of_a_chain_ends(spark):
    """Supports that rise along a chain of pairs leave one pair a round."""
    pairs = [(k, k, 2 * k) for k in range(12)] + [(k, k + 1, 2 * k + 1) for k in range(11)]
    got = {(r.a, r.b) for r in aggregates.assign(spark.createDataFrame(pairs, "a int, b int, n int"), "a", "b", "n").collect()}
    assert got == {(k, k) for k in range(12)}


def test_patches_find_rows_again(spark):
    old = spark.createDataFrame([(1, "a", "p1", 1), (2, None, "p2", 1), (3, "c", "p3", 1), (4, None, "p9", 1)], "id int, key string, path string, v int")
    new = spark.createDataFrame([(11, "a", "p1", 1), (12, None, "p2", 1), (3, "c", "p3", 2)], "id int, key string, path string, v int")
    assert rows(corrections.patch(old, new, "id", "key", "path")) == sorted([(1, "removed", 11), (2, "removed", 12), (3, "changed", None), (4, "removed", None), (11, "added", None), (12, "added", None)], key=str)


def test_path_all(spark):
    n = spark.createDataFrame([(1, None, True), (2, 1, False), (3, 2, True), (4, 1, True), (5, 4, True)], "id int, parent int, ok boolean")
    assert rows(windows.path_all(n, "id", "parent", "ok")) == [(1, True), (2, False), (3, False), (4, True), (5, True)]


def test_success_rate_and_why(spark):
    n = spark.createDataFrame([(1, None, "ok", True, "a"), (2, 1, "ok", False, "a"), (3, 2, "ok", True, "a")], "id int, parent int, status string, agrees boolean, book string")
    assert rows(quality.success_rate(n, ["book"])) == [("a", 3, 1, 1, round(100 / 3, 6))]


def test_resolve_ambiguous(spark):
    df = spark.createDataFrame([([[5, 8], [8, 5], [9]],)], "v array<array<int>>")
    assert df.select(windows.resolve_ambiguous(F.col("v")).alias("r")).first().r == [5, 8, 9]


def test_asof_ignores_equal_times(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    left = spark.createDataFrame([(1, 1, t[1])], "id int, g int, at timestamp")
    right = spark.createDataFrame([(7, 1, t[0], "x"), (8, 1, t[1], "y"), (9, 1, t[2], "z")], "id int, g int, at timestamp, v string")
    assert joins.asof(left, right, ["g"], "at", ["v"], ["id"]).first().prev_v == "x"
    assert joins.asof(left, right, ["g"], "at", ["v"], ["id"], forward=True, prefix="next_").first().next_v == "z"


@pytest.mark.parametrize("hours", [1, 30])
def test_ordered_operators_do_not_depend_on_cells(spark, hours):
    """Sessions and as-of joins over cells give what plain windows give, gaps longer than a cell included."""
    rng = random.Random(hours)
    base = dt.datetime(2024, 1, 1)
    rows = [(k, rng.randrange(2), base + dt.timedelta(minutes=rng.randrange(20_000)), rng.choice("ab"), k * 1.0) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, g int, at timestamp, kind string, v double")
    last, island, want = {}, {}, []
    for i, g, at, *_ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if g in last and (at - last[g]).total_seconds() > hours * 3600:
            island[g] = island.get(g, 0) + 1
        last[g] = at
        want.append((i, island.get(g, 0)))
    got = windows.gap_sessions(df.select("id", "g", "at"), ["g"], "at", ["id"], hours * 3600, F.to_date)
    assert sorted((r.id, r.island) for r in got.collect()) == sorted(want)
    left, right = df.where("kind = 'a'").select("id", "g", "at"), df.where("kind = 'b'")
    for forward in (False, True):
        a = joins.asof(left, right, ["g"], "at", ["v"], ["id"], forward=forward, prefix="p_")
        b = joins.asof(left, right, ["g"], "at", ["v"], ["id"], forward=forward, prefix="p_", cell=F.to_date)
        assert rows_of(a) == rows_of(b)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_tolerance_prefers_equal_text(spark):
    left = spark.createDataFrame([(1, 1, 10.0, 10.0, "Nf3")], "k int, page int, x double, y double, raw string")
    right = spark.createDataFrame([(1, 1, 10.2, 10.0, "Nf8"), (2, 1, 12.0, 11.0, "Nf3"), (3, 1, 12.6, 10.0, "Nf3"), (4, 2, 10.0, 10.0, "Nf3")], "k int, page int, x double, y double, raw string")
    rank = [(F.col("raw") != F.col("r_raw")), F.greatest(F.abs(F.col("x") - F.col("r_x")), F.abs(F.col("y") - F.col("r_y")))]
    assert joins.tolerance(left, right, ["page"], ["x", "y"], 2.5, rank, ["k"]).first().r_k == 2


def test_leaders_depend_on_order(spark):
    a = spark.createDataFrame([(1, k, [v]) for k, v in enumerate([0.0, 1.0, 2.0, 10.0])], "g int, k int, v array<double>")
    assert [r.cluster for r in clusters.leaders(a, "g", "k", "v", 1.2).orderBy("k").collect()][-1] == max(r.cluster for r in clusters.leaders(a, "g", "k", "v", 1.2).collect())


def test_incremental_equals_full(spark):
    base = spark.createDataFrame([(f"{k % 3}:1,2:x{k}", k % 3, k) for k in range(30)], "key string, g int, v int")
    derive = lambda d: d.groupBy("g").agg(F.sum("v").alias("s"))
    for seed in range(3):
        rng = random.Random(seed)
        fixes = spark.createDataFrame([("moves", f"{k % 3}:1,2:x{k}", str(rng.randrange(99)), False, k) for k in rng.sample(range(30), 2)], "part string, key string, value string, auto boolean, seq int")
        new = corrections.applied(base, corrections.canonical(fixes, strict=True), "key", {"moves": "v"})
        assert rows(corrections.maintained(derive(base), base, new, "g", derive)) == rows(derive(new))


def test_canonical_rejects(spark):
    bad = spark.createDataFrame([("moves", "nonsense", "e4", False, 1)], "part string, key string, value string, auto boolean, seq int")
    assert corrections.canonical(bad).count() == 0
    with pytest.raises(Exception, match="impossible"):
        corrections.canonical(bad, strict=True).collect()


def test_patch_and_settled(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(corrections.patch(old, new, "k")) == [(1, "removed"), (2, "changed"), (3, "added")]
    f = spark.createDataFrame([("moves", "a", True), ("moves", "b", False)], "part string, key string, auto boolean")
    assert rows(corrections.settled(f, lambda d: d.where("false"))) == [("moves", "b", False)]


def test_scalars(spark):
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    after = "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1"
    r = (
        spark.range(1)
        .select(
            scalars.square_diff(F.lit(start), F.lit(after)).alias("d"), scalars.castling(F.lit(start)).alias("c"), scalars.legal_shape(F.lit(start)).alias("l"), scalars.legal_shape(F.lit("8/8/8/8/8/8/8/K7")).alias("n"), scalars.number_values(F.lit("S")).alias("s"),
            scalars.strip_real(F.lit(" \n\x1dx\t\xa0")).alias("x"), scalars.title_case(F.lit("THE END OF THE GAME")).alias("t"), scalars.engine_score(F.lit(-80), F.lit(None).cast("int")).alias("e"), scalars.chapter_heading(F.lit("Chapter IV: Pins")).alias("h"), scalars.parse_token_key(F.lit("3:10,-2:N:f3")).alias("k"),
            scalars.nag(F.lit("!?")).alias("nag"), scalars.clean_comment(F.lit("a {b}\x01  c")).alias("cc"), scalars.result(F.lit(" ½-½ ")).alias("res"),
        )
        .first()
    )
    assert [(x.square, x["first"], x["second"]) for x in r.d] == [("e4", ".", "P"), ("e2", "P", ".")]
    assert (r.c, r.l, r.n, r.s, r.x, r.t, r.e) == ("KQkq", True, False, [8, 5], "\x1dx\t", "The End of the Game", "-0.8")
    assert (r.h.kind, r.h.number, r.h.title, r.k.raw, r.nag, r.cc, r.res) == ("chapter", 4, "Pins", "N:f3", 5, "a b c", "1/2-1/2")


def test_an_entry_of_a_script_looks_at_lines_with_its_rows_alone(monkeypatch):
    """The work of a fold grows with the script and not with the script times the book's lines; lines that are joined, emptied or put back are found."""
    from tessera.operators import scripts

    calls, cut = [], scripts._cut
    monkeypatch.setattr(scripts, "_cut", lambda *a: calls.append(1) or cut(*a))
    lines = [f"l{k:03}" for k in range(200)]
    entry = {c: None for c in scripts.ENTRY}
    moves = [entry | {"op": "move", "of": x, "at": 1, "until": 2, "line": x} for x in lines]
    folded = scripts.folded(lines, moves)
    assert len(calls) <= 4 * len(lines)
    assert [(line, x.lo) for line, _, x in folded[:3]] == [("l000", 0), ("l000", 2), ("l000", 1)]
    odd = [
        entry | {"op": "split", "line": "a", "of": "a", "at": 3, "to": "n"},
        entry | {"op": "join", "line": "n", "to": "b"},
        entry | {"op": "move", "of": "a", "at": 3, "until": 5, "line": "b", "before_of": "a", "before": 4},  # among what is moved: put back
        entry | {"op": "remove", "of": "a", "at": 4, "until": 5},
        entry | {"op": "move", "of": "a", "at": 5, "until": 6, "line": "a"},
    ]
    got = [(line, x.line, x.lo, x.hi) for line, _, x in scripts.folded(["a", "b"], odd) if x.hi > x.lo]
    assert got == [("a", "a", 0, 3), ("a", "a", 5, 6), ("b", "b", 0, scripts.LAST), ("b", "a", 3, 4), ("b", "a", 6, scripts.LAST)]
