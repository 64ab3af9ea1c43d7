"""Rules, notation, decoding and assembly."""

from __future__ import annotations

import random

import pytest
from tessera.functions import board, notation, tree
from tessera.functions.decoder import Decoder, NoiseModel
from tessera.operators import reading


@pytest.mark.parametrize(
    ("fen", "counts"),
    [
        (board.START, [20, 400, 8902]),
        ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", [48, 2039]),
        ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", [14, 191, 2812]),
        ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", [44, 1486]),
    ],
)
def test_moves_are_the_known_number(fen, counts):
    assert [board.perft(board.read_fen(fen), d + 1) for d in range(len(counts))] == counts
    assert board.write_fen(board.read_fen(fen)) == fen


def test_tokens_and_runs():
    t = "1.e4 e5 2.Nf3 Nc6 (2...d6 3.d4) 3.Bb5 a6 1-0 The end."
    runs = notation.runs(notation.tokenize(t))
    assert [(r.first_number, r.black_first, r.depth, len(r.tokens)) for r in runs] == [(1, False, 0, 4), (2, True, 1, 2), (3, False, 0, 2)]
    assert notation.tokenize(t)[-3].kind == "result"


def test_control_characters_are_data():
    assert [x.raw for x in notation.tokenize("1.e4 e5 2.J\x1d:f3 d6") if x.kind == "move"] == ["e4", "e5", "J\x1d:f3", "d6"]


@pytest.mark.parametrize("value", [("12", [12]), ("l2", [12]), ("S", [8, 5]), ("012", []), ("1234", [])])
def test_number_values(value):
    assert notation.number_values(value[0]) == value[1]


def test_clean_text_is_read_exactly():
    rng = random.Random(5)
    game = board.random_game(rng, 60)
    text = " ".join((f"{k // 2 + 1}." if k % 2 == 0 else "") + s for k, s in enumerate(game))
    raws = [t.raw for r in notation.runs(notation.tokenize(text, exact=True)) for t in r.tokens]
    read = Decoder().run(board.START, raws)
    assert [r["san"] for r in read] == game
    assert {r["status"] for r in read} == {"ok"}


@pytest.mark.parametrize("junk", [False, True])
def test_second_pass_reads_medium_noise(junk):
    """At least 97 % of places of twenty games at medium noise in the second pass."""
    games = []
    for s in range(20):
        rng = random.Random(s)
        g = board.random_game(rng, 40)
        games.append((g, [t.raw for r in notation.runs(notation.tokenize(notation.printed(g, "medium", rng, junk))) for t in r.tokens]))
    model = NoiseModel()
    for _ in range(2):
        read = [Decoder(model).run(board.START, raws) for _, raws in games]
        model = NoiseModel()
        for r in read:
            model.learn(r)
    right = sum(a == b["san"] for (g, _), r in zip(games, read, strict=True) for a, b in zip(g, r, strict=False))
    assert right >= 0.97 * sum(len(g) for g, _ in games)


def test_variations_and_gaps():
    lines = tree.assemble("A game.\n\n1.e4 e5 2.Nf3 (2.f4 exf4 3.Nf3) 2...Nc6 3.Bb5 a6 6.O-O 1-0", Decoder())
    assert len(lines) == 1
    line = lines[0]
    assert [n.san for n in line.nodes if n.main and n.san] == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6"]
    assert [n.san for n in line.nodes if not n.main] == ["f4", "exf4", "Nf3"]
    assert [n.status for n in line.nodes].count("gap") == 1
    assert line.result == "1-0"
    text = tree.game_text(line)
    assert "(2. f4 exf4 3. Nf3)" in text
    assert tree.main_moves(text) == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6"]


def test_a_diagram_starts_a_line():
    text = "See the diagram. 24.Rh7 Kd8 25.Rg7 Kc8 and White is better."
    fen = "4k3/8/8/8/8/8/4P3/4K2R w K - 0 1"
    lines = tree.assemble(text, Decoder(), diagrams=[(10, fen)])
    assert [n.san for n in lines[0].nodes] == ["Rh7", "Kd8", "Rg7", "Kc8"]
    assert lines[0].start_fen.endswith(" 24")
    assert not tree.assemble(text, Decoder())[0].nodes
    assert "[FEN " in tree.game_text(lines[0])


def test_diagram():
    rows = ["r n b q k b n r", "pppppppp", *["........"] * 4, "PPPPPPPP", "RNBQKBNR"]
    assert tree.find_diagram(rows) == "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR"
    assert tree.find_diagram(rows[:7] + ["RNBQ.BNR"]) is None


def test_equal_runs_are_decoded_once_and_games_read_back(spark):
    df = spark.createDataFrame([(1, board.START, ["e4", "e5"]), (2, board.START, ["e4", "e5"]), (3, board.START, [])], "k int, s string, m array<string>")
    out = {r.k: [d.san for d in r.decoded] for r in reading.decode(df, "s", "m").collect()}
    assert out == {1: ["e4", "e5"], 2: ["e4", "e5"], 3: []}
    lines = reading.validated(reading.assembled(spark.createDataFrame([(1, "1.d4 d5 2.c4 e6 1/2-1/2"), (2, "no moves"), (3, None)], "k int, t string"), "k", "t"))
    assert [(r.k, r.valid, r.status) for r in lines.collect()] == [(1, True, "ok")]


def test_written_games_are_read(spark, tmp_path):
    from tessera.sources.tables import games

    lines = reading.assembled(spark.createDataFrame([(1, "1.d4 d5 2.c4 e6 1-0")], "chapter int, t string"), "chapter", "t")
    reading.write_games(lines, str(tmp_path / "pgn"), "chapter")
    got = games(spark, str(tmp_path / "pgn/*/*.txt")).collect()
    assert [(r.tags["Result"], tree.main_moves("\n\n" + r.moves)) for r in got] == [("1-0", ["d4", "d5", "c4", "e6"])]


def test_misprints_happen_at_their_rates():
    """Over many moves each kind of misprint has about the share that its level states, and nothing else changes."""
    rng = random.Random(3)
    moves = [m for k in range(60) for m in board.random_game(random.Random(k), 60)]
    rates = notation.V.LEVELS["medium"] | {"always": 1.0}
    made = [(m, notation.misprinted(m, "move", rates, rng, False)) for m in moves]
    pieces = [(m, x) for m, x in made if m[0] in "KQRBN"]
    takes = [(m, x) for m, x in made if "x" in m]
    checks = [(m, x) for m, x in made if m[-1] in "+#"]
    files = [(m, x) for m, x in made if m.rstrip("+#")[-2] == "f" and "=" not in m and "O" not in m]
    for pairs, name, odd in ((pieces, "drop", lambda x: x[0] not in "KQRBN"), (takes, "xdrop", lambda x: "x" not in x), (checks, "chkdrop", lambda x: x[-1] not in "+#"), (files, "f_pound", lambda x: "£" in x)):
        share = sum(odd(x) for _, x in pairs) / len(pairs)
        want = rates[name] * (0.8 if name == "f_pound" else 1)
        assert abs(share - want) < 4 * (want / len(pairs)) ** 0.5 + 0.005
    clean = dict.fromkeys(rates, 0.0)
    assert all(notation.misprinted(m, "move", clean, rng, False) == m for m in moves)


def test_numbers_without_dots():
    t = "1 e4 c5 2 Nf3 d6 3 d4 cxd4 and after 3 days 4 Nxd4"
    assert [(r.first_number, [x.raw for x in r.tokens]) for r in notation.runs(notation.tokenize(t, dotless=True))] == [(1, ["e4", "c5", "Nf3", "d6", "d4", "cxd4"]), (4, ["Nxd4"])]
    assert not notation.runs(notation.tokenize(t))


def test_a_misread_number_is_mended():
    """11 for 17 between 16 and 18 goes on; where the numbers after it disagree, it opens a run of its own."""
    assert [(r.first_number, len(r.tokens)) for r in notation.runs(notation.tokenize("16.e4 e5 11.Nf3 Nc6 18.Bb5 a6"))] == [(16, 6)]
    assert [(r.first_number, len(r.tokens)) for r in notation.runs(notation.tokenize("16.e4 e5 11.Nf3 Nc6 12.Bb5 a6"))] == [(16, 2), (11, 4)]
    assert notation.slipped("11.", 17)
    assert not notation.slipped("12.", 17)


def test_unseen_symbols_back_off_to_their_characters():
    """A symbol never seen reads as the piece whose symbols have its characters; a lone file letter does not."""
    m = NoiseModel()
    for symbol in ("tLl", "ti)", "lt)"):
        m.add(symbol, "N", 5)
    for symbol in ("YlY", "Wf"):
        m.add(symbol, "Q", 5)
    p = {x: m.probability("tL)", x) for x in "KQRBNP"}
    assert max(p, key=p.get) == "N"
    assert abs(sum(p.values()) - 1) < 1e-9
    assert m.probability("h", "B") == NoiseModel().probability("h", "B")


def test_held_lines_go_on_where_they_read():
    d = Decoder()
    text = "1.e4 e5 2.Nf3 Nc6\n\nTITLE\n\n3.Bb5 a6 *"
    (line,) = tree.assemble(text, d, headings=[text.index("TITLE")])
    assert [n.san for n in line.nodes] == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6"]
    text = "1.e4 e5 2.Nf3 Nc6\n\nTITLE\n\n3.Ra5 Qxh2 *"  # does not read: it waits
    (line,) = tree.assemble(text, d, headings=[text.index("TITLE")])
    assert [n.san for n in line.nodes] == ["e4", "e5", "Nf3", "Nc6"]
    assert line.waiting
    other = "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/3P1N2/PPP2PPP/RNBQKB1R b KQkq - 0 3"
    text = "1.e4 e5 2.Nf3 Nc6 [] 3...Nf6 4.Be2 *"
    lines = tree.assemble(text, d, diagrams=[(text.index("[]"), other)])
    assert [n.san for n in lines[-1].nodes] == ["Nf6", "Be2"]
    assert lines[-1].start_fen.split(" ")[0] == other.split(" ")[0]


def test_noise_is_measured(spark):
    moves = ["e4", "e5", "f3", "Nc6", "Bb5", "a6", "B:c6"]
    d = reading.decode(spark.createDataFrame([(board.START, moves)], "start string, moves array<string>"), "start", "moves")
    r = reading.noise_rates(d).first()
    assert (r.moves, r.failed, r.vanished_of, r.mark_of, r.mark) == (7, 0, 3, 1, 0)
    assert r.file == r.rank == 0


def test_rows_of_texts_are_handed_on_in_pieces(monkeypatch):
    """A task holds the rows of a text and a piece, not those of a whole batch of texts."""
    import pandas as pd
    from pyspark.sql.types import IntegerType, StringType, StructType
    from tessera.operators import reading

    class Frame:
        schema = StructType().add("k", IntegerType()).add("t", StringType())

        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            return run

    monkeypatch.setattr(reading, "ROWS", 10, raising=False)
    seen = []
    run = reading._each(Frame(), "k", "t", lambda t: seen.append(t) or [(i, t) for i in range(4)], "i int, x string")
    frames = run(iter([pd.DataFrame({"k": range(50), "t": [str(k) for k in range(50)]}), pd.DataFrame({"k": [], "t": []})]))
    first = next(frames)
    assert len(first) == 10 and len(seen) <= 3
    rows = [tuple(r) for f in [first, *frames] for r in f.itertuples(index=False)]
    assert rows == [(k, i, str(k)) for k in range(50) for i in range(4)]


def test_long_rows_of_texts_are_handed_on_by_their_texts(monkeypatch):
    """Few rows that are as long as their texts are handed on before a batch is through."""
    import pandas as pd
    from pyspark.sql.types import IntegerType, StringType, StructType
    from tessera.operators import reading

    class Frame:
        schema = StructType().add("k", IntegerType()).add("t", StringType())

        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            return run

    monkeypatch.setattr(reading, "CHARS", 100, raising=False)
    seen = []
    run = reading._each(Frame(), "k", "t", lambda t: seen.append(t) or ([(0, t)] if t else []), "i int, x string")
    frames = run(iter([pd.DataFrame({"k": range(20), "t": ["x" * 40 if k % 4 else None for k in range(20)]}), pd.DataFrame({"k": [], "t": []})]))
    first = next(frames)
    assert len(first) == 3 and len(seen) == 4
    assert [r.k for f in [first, *frames] for r in f.itertuples(index=False)] == [k for k in range(20) if k % 4]


def test_books_are_read_in_the_same_jobs(spark, monkeypatch):
    """Books with a model each are read and learnt together, a job a pass, with the rows that each gives alone; an unnamed book counts as one."""
    books = {"a": (3, True), "b": (4, False), None: (5, True)}
    games = [(name, k, board.START, [t.raw for r in notation.runs(notation.tokenize(notation.printed(board.random_game(rng, 12), "high", rng, junk))) for t in r.tokens]) for name, (seed, junk) in books.items() for k in range(3) for rng in [random.Random(seed * 10 + k)]]
    schema = "book string, game int, start string, moves array<string>"
    want = {}
    for name in books:
        alone = spark.createDataFrame([g for g in games if g[0] == name], schema)
        want |= {(r.book, r.game): r.decoded for r in reading.read_passes(alone, "start", "moves", passes=2).collect()}
    decode, calls = reading.decode, []
    monkeypatch.setattr(reading, "decode", lambda *a: calls.append(a) or decode(*a))
    read = reading.read_passes(spark.createDataFrame(games, schema), "start", "moves", passes=2, by=["book"])
    assert read.columns == ["book", "game", "start", "moves", "decoded"]
    assert {(r.book, r.game): r.decoded for r in read.collect()} == want
    assert len(calls) == 2 and len(want) == 9


def test_a_run_is_priced_once_by_symbol_and_piece(monkeypatch):
    """What a symbol costs for a piece doesn't depend on the position: a run asks the model once for it, however many positions and moves it is tried on."""
    rng = random.Random(7)
    raws = [t.raw for r in notation.runs(notation.tokenize(notation.printed(board.random_game(rng, 30), "medium", rng, True))) for t in r.tokens]
    plain, asked = NoiseModel.cost, []
    monkeypatch.setattr(NoiseModel, "cost", lambda self, symbol, piece: asked.append((symbol, piece)) or plain(self, symbol, piece))
    d = Decoder()
    first = d.run(board.START, raws)
    assert len(asked) == len(set(asked))
    d.model.learn(first)  # prices are the model's as it is when a run begins
    assert d.run(board.START, raws) == Decoder(d.model).run(board.START, raws)


def test_moves_that_keep_the_king_safe():
    """Pins, checks and pawns taken in passing: as by playing each move."""
    fens = ["4k3/8/8/KPp4r/8/8/8/8 w - c6 0 1", "4r2k/8/8/8/8/8/4N3/4K3 w - - 0 1", "4r2k/8/8/8/7b/8/3P1R2/4K3 w - - 0 1", "7k/8/8/3q4/8/8/3R4/3K3r w - - 0 1", "8/8/8/8/8/8/8/R7 w - - 0 1", "r3k2r/8/8/8/8/8/4Q3/R3K2R b KQkq - 0 1"]
    positions = [board.read_fen(f) for f in fens]
    for seed in range(10):
        p, rng = board.read_fen(board.START), random.Random(seed)
        for _ in range(60):
            moves = board.legal(p)
            if not moves:
                break
            p = board.play(p, rng.choice(moves))
            positions.append(p)
    for p in positions:
        assert list(board.kept(p, board.pseudo(p))) == [m for m in board.pseudo(p) if board.safe(p, m)] == list(board.legal(p))
