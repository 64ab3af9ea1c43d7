"""Repairs and inference."""

from __future__ import annotations

import random

from tessera.functions import board, repair
from tessera.functions.decoder import Decoder
from tessera.operators import inference, quality, reading


def test_a_missing_move_is_filled_only_if_decided():
    d = Decoder()
    p = board.read_fen(board.START)
    for s in ("e4", "e5"):
        p = board.play(p, board.read_san(p, s))
    assert repair.fill(d, board.write_fen(p), ["Nc6", "Bxc6", "dxc6", "Bd5"]) is None
    assert repair.fill(d, "4k3/8/8/8/8/8/P3P3/4K2R w K - 0 1", ["Kd7", "a5", "Kc6", "a6", "Kb5", "a7"]) == ["a4"]


def test_a_misread_square_is_found():
    rng = random.Random(4)
    p = board.read_fen(board.START)
    for _ in range(8):
        p = board.play(p, rng.choice(board.legal(p)))
    true = board.write_fen(p)
    names, q = [], p
    for _ in range(14):
        m = rng.choice(board.legal(q))
        names.append(board.san(q, m))
        q = board.play(q, m)
    assert repair.square(Decoder(), true, names) == true
    k = p.squares.index("n")
    wrong = board.write_fen(p._replace(squares=(*p.squares[:k], ".", *p.squares[k + 1 :])))
    assert repair.square(Decoder(), wrong, names) in (None, true, wrong)


def test_the_other_side_reads():
    fen = "4k3/8/8/8/8/8/4P3/4K3 b - - 0 1"
    rows, changed = repair.region(Decoder(), fen, ["e4", "Kd7"])
    assert changed
    assert [r["san"] for r in rows] == ["e4", "Kd7"]


def test_path_is_shortest():
    p = board.read_fen(board.START)
    for s in ("e4", "e5", "Nf3"):
        p = board.play(p, board.read_san(p, s))
    assert len(repair.path(board.START, board.placement(p), 4)) == 3
    assert repair.path(board.START, "8/8/8/8/8/8/8/K6k", 2) is None


def test_votes_spread_to_like_groups(spark):
    rows = [("b", 1, [0.0, 0.0], {"K": 3}), ("b", 2, [0.1, 0.0], {}), ("b", 3, [9.0, 9.0], {"N": 2})]
    got = {r.group: r.name for r in inference.smoothed_votes(spark.createDataFrame(rows, "book string, group int, centre array<double>, votes map<string,int>"), "book", 1.0).collect()}
    assert got == {1: "K", 2: "K", 3: "N"}


def test_boards_constrain_names(spark):
    like_king = {"K": 1.0, "Q": 1.2, "k": 9.0}
    rows = [("b", 1, 1, {"K": 0.5, "Q": 3.0, "k": 9.0}), ("b", 1, 2, like_king), ("b", 1, 3, {"k": 0.0, "K": 5.0, "Q": 9.0})]
    got = {r.group: r.name for r in inference.constrained_names(spark.createDataFrame(rows, "book string, board int, group int, costs map<string,double>"), "book").collect()}
    assert got == {1: "K", 2: "Q", 3: "k"}


def test_what_follows_a_branch(spark):
    ends = spark.createDataFrame([("b", 1, 100, 1, 10)], "book string, line int, offset int, page int, ply int")
    printed = spark.createDataFrame([("b", 1, 120, 1, 10, ["x"]), ("b", 2, 150, 2, 30, ["far"]), ("b", 2, 200, 3, 12, ["e4"]), ("b", 2, 250, 3, 10, ["later"]), ("b", 3, 300, 9, 10, ["no"])], "book string, line int, offset int, page int, ply int, moves array<string>")
    assert [tuple(r) for r in reading.suggestions(ends, printed).collect()] == [("b", 1, 2, 200, 2, ["e4"])]


def test_small_inference(spark):
    sq = spark.createDataFrame([(1, 0.0, 7.0), (1, 0.0, 6.0), (2, 0.0, 5.0)], "board int, as_is double, around double")
    assert {r.board: r.turned for r in inference.turned(sq, "board").collect()} == {1: True, 2: False}
    pairs = spark.createDataFrame([(1, "a", 1.0, 0.9), (1, "b", 0.5, 0.6), (2, "a", 3.0, 0.9)], "d int, g string, distance double, iou double")
    assert [tuple(r) for r in inference.attached(pairs, "d", "g", 1.0).collect()] == [(1, "a")]
    close = spark.createDataFrame([(1, "K", "K", 1.0), (1, "Q", "K", 4.0)], "d int, name string, own string, distance double")
    assert inference.closeness(close, "d").first().closeness == 0.75


def test_scan_and_listing(spark):
    n = spark.createDataFrame(
        [(1, 1, None, 1, 0, True, "ok", "e4", "e4"), (2, 1, 1, 4, 1, True, "guessed", "e5", "c5"), (3, 1, 2, 4, 2, True, "failed", None, "??"), (4, 2, None, 2, 0, True, "ok", "d4", "d5")],
        "id int, line int, parent int, page int, ply int, main boolean, status string, san string, raw string",
    )
    lines = spark.createDataFrame([(1, "A", "game", "x"), (2, "A", "fragment", "y")], "id int, chapter string, kind string, title string")
    got = quality.scan(n, lines, spark.createDataFrame([(1, 1, "read")], "id int, page int, status string"))
    assert [(r.line, r.id) for r in got["breaks"].collect()] == [(1, 2)]
    assert [r.id for r in got["silent"].collect()] == [4]
    assert [(r.id, r.parent_page) for r in got["jumps"].collect()] == [(2, 1)]
    assert [(r.id, r.moves) for r in got["short_games"].collect()] == [(1, 3)]
    assert [tuple(r) for r in got["chapters"].collect()] == [("A", 2, 4)]
    assert {k: d.count() for k, d in got.items()}["hot_pages"] == 1
    shown = reading.listings(spark.createDataFrame([(1, "1.e4 e5 (1...c5 2.Nf3) 2.d4")], "k int, t string"), "k", "t").orderBy("place").collect()
    assert [(r.depth, r.shown.split()[1]) for r in shown] == [(0, "e4"), (0, "e5"), (1, "c5"), (1, "Nf3"), (0, "d4")]


def test_start_is_chosen_by_what_reads(spark):
    other = "4k3/8/8/8/8/8/4P3/4K2R w K - 0 1"
    rows = [(1, 0, board.START, ["e4", "e5"]), (1, 1, other, ["e4", "e5"]), (2, 0, board.START, ["Rh7", "Kd8", "Rg7", "Kc8"]), (2, 1, other, ["Rh7", "Kd8", "Rg7", "Kc8"])]
    got = reading.choose_start(spark.createDataFrame(rows, "run int, ord int, start string, moves array<string>"), "run", "ord", "start", "moves").collect()
    assert {r.run: (r.ord, r.failed) for r in got} == {1: (0, 0), 2: (1, 0)}


def test_sinks_and_parts(spark, tmp_path):
    import json

    from tessera.sources import sinks
    from tessera.sources.tables import books, stored

    lines = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (2, "c", None)], "chapter int, id string, title string")
    sinks.write_book(lines, "chapter", str(tmp_path / "book"))
    got = {r.chapter: json.loads(r.value) for r in spark.read.text(str(tmp_path / "book")).collect()}
    assert got[1] == {"chapter": 1, "lines": [{"id": "a"}, {"id": "b", "title": "x"}]}
    assert sinks.chapter_data(lines, "chapter", 2, ["id"]).first().value == '{"id":"c"}'
    for version, v in ((1, "old"), (2, "new")):
        sinks.write_part(spark.createDataFrame([(v,)], "v string"), 1, version, str(tmp_path / "parts"))
    assert [r.v for r in stored(spark, str(tmp_path / "parts")).collect()] == ["new"]
    (tmp_path / "one.json").write_text('{"title": "T",\n "lines": [{"id": "g1", "page": 3}]}')
    b = books(spark, str(tmp_path / "one.json")).first()
    assert (b.title, b.lines[0].page) == ("T", 3)
