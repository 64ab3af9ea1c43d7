"""Reading printed games with Spark: tokens, runs, decoding with a learnt noise model, assembly and game text.

Each text is read in one task row by row, since a run's meaning depends on the one before; texts are independent.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator, Sequence
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import board, notation, repair, tree
from ..functions import notation_values as V
from ..functions.decoder import Decoder, NoiseModel

TOKEN = "kind string, raw string, start int, end int, number int, black boolean"


#: Rows that a task of `_each` holds before it hands them on; a text's own rows stay together until they are made.
ROWS = 4096
#: Characters of texts whose rows a task of `_each` holds: rows may be as long as their texts.
CHARS = 1 << 20


def _each(df: DataFrame, key: str, text: str, make, schema: str) -> DataFrame:
    """Rows made of each text, with its key; handed on in pieces of ROWS, or of what CHARS of texts give, so that a task holds a batch of texts and the rows of one text, however many or long rows the batch gives."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *[c.strip().split(" ")[0] for c in _columns(schema)]]
        for pdf in frames:
            piece, chars = [], 0
            for k, t in zip(pdf[key], pdf[text], strict=True):
                for r in make(t or ""):
                    piece.append((k, *r))
                    if len(piece) == ROWS:
                        yield pd.DataFrame(piece, columns=names).astype(object)
                        piece, chars = [], 0
                chars += len(t or "")
                if piece and chars >= CHARS:
                    yield pd.DataFrame(piece, columns=names).astype(object)
                    piece, chars = [], 0
            if piece:
                yield pd.DataFrame(piece, columns=names).astype(object)

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {schema}")


def _columns(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[at:k])
            at = k + 1
    return [*out, schema[at:]]


def tokens(df: DataFrame, key: str, text: str, exact: bool = False) -> DataFrame:
    """A row for each token of each text."""
    return _each(df, key, text, lambda t: [(k, x.kind, x.raw, x.start, x.end, x.number, x.black) for k, x in enumerate(notation.tokenize(t, exact))], f"pos int, {TOKEN}")


def runs(df: DataFrame, key: str, text: str, exact: bool = False) -> DataFrame:
    """A row for each numbered run: first number and side, depth, place and the printed moves."""
    return _each(
        df, key, text, lambda t: [(k, r.first_number, r.black_first, r.depth, r.start, r.end, [x.raw for x in r.tokens]) for k, r in enumerate(notation.runs(notation.tokenize(t, exact)))], "run int, first_number int, black_first boolean, depth int, start int, end int, moves array<string>"
    )


#: Tasks of `decode` for each shuffle partition: runs are dear and some dearer than others, so that no core waits long for the last.
DEALT = 4


def _book(by: Sequence[str]) -> Column:
    """The name of a row's book: the values that tell the books, as text."""
    return F.to_json(F.struct(*by)) if by else F.lit("")


def decode(df: DataFrame, start: str, moves: str, model: NoiseModel | dict[str, NoiseModel] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """All columns and `decoded`, an array of what each printed move reads as. Equal (position, moves) pairs of a book are decoded once: distinct pairs are read and joined back. by: what tells the books, if each has a model of its own; a book without one is read with an empty model."""
    shared = df.sparkSession.sparkContext.broadcast(model if isinstance(model, dict) else {"": model or NoiseModel()})
    row = "ply int, raw string, san string, uci string, status string, cost double, alternatives array<string>, symbol string, printed string, fen string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, Decoder] = {}
        names = ["_s", "_m", "_b", "decoded"]
        for pdf in frames:
            piece, held = [], 0
            for s, m, b in zip(pdf["_s"], pdf["_m"], pdf["_b"], strict=True):
                if b not in own:
                    own[b] = Decoder(shared.value.get(b))
                piece.append((s, m, b, own[b].run(s, list(m))))
                held += len(m)
                if held >= ROWS:
                    yield pd.DataFrame(piece, columns=names)
                    piece, held = [], 0
            if piece:
                yield pd.DataFrame(piece, columns=names)

    asked = df.select(F.col(start).alias("_s"), F.col(moves).alias("_m"), _book(by).alias("_b")).distinct()
    asked = asked.repartition(DEALT * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_m", "_b")  # dear by row: spread over all tasks, however few rows
    read = asked.mapInPandas(run, f"_s string, _m array<string>, _b string, decoded array<struct<{row.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' array', ':array')}>>")
    return df.join(read, (df[start] == read["_s"]) & (df[moves] == read["_m"]) & (_book([df[c] for c in by]) == read["_b"]), "left").drop("_s", "_m", "_b")


def learn(decoded: DataFrame) -> NoiseModel:
    """What symbols and printed squares stood for, in moves read without doubt: all of it, summed first, so that the driver gets a row for each distinct symbol (a few characters) and what it stood for, however many moves show it."""
    return learn_each(decoded, ()).get("", NoiseModel())


def learn_each(decoded: DataFrame, by: Sequence[str]) -> dict[str, NoiseModel]:
    """The model of each book, all learnt by one job."""
    d = decoded.select(_book(by).alias("_b"), F.explode("decoded").alias("d")).select("_b", "d.*").where("san is not null and cost <= 2.5 and san not like 'O%'")
    to = lambda k: F.regexp_extract("san", "([a-h])([1-8])(?:=[QRBN])?[+#]?$", k)
    fact = lambda kind, char, value, when: F.when(when, F.struct(F.lit(kind).alias("kind"), char.alias("char"), value.alias("value")))
    piece = F.when(F.substring("san", 1, 1).isin(*"KQRBN"), F.substring("san", 1, 1)).otherwise("P")
    at, ok = lambda k: F.substring("printed", k, 1), F.col("status") == "ok"
    every = F.array(
        fact("file", at(1), to(1), at(1) != "-"), fact("rank", at(2), to(2), at(2) != "-"), fact("symbol", F.col("symbol"), piece, ok), fact("mark", F.col("symbol"), F.when(F.col("san").contains("x"), "x").otherwise("-"), ok & (F.col("symbol") != "") & (at(3) == "-"))
    )
    facts = d.select("_b", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("f")).select("_b", "f.*")
    models: dict[str, NoiseModel] = {}
    for r in facts.groupBy("_b", "kind", "char", "value").count().collect():
        models.setdefault(r["_b"], NoiseModel()).count(r["kind"], r["char"], r["value"], r["count"])
    return models


def read_passes(df: DataFrame, start: str, moves: str, passes: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Decode, learn from what was read, decode again; all books (told by `by`, each with a model of its own) in the same jobs."""
    models: dict[str, NoiseModel] = {}
    for k in range(passes):
        out = decode(df, start, moves, models, by)
        if k + 1 < passes:
            models = learn_each(out, by)
    return out


def printed_games(keys: DataFrame, key: str, level: str, junk: bool, seed: int = 20261003, least: int = 30, most: int = 80) -> DataFrame:
    """A game of random legal moves for each key, and its text as a bad print has it; the same for equal seeds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k in pdf[key]:
                rng = random.Random(f"{seed}:{k}")
                sans = board.random_game(rng, rng.randint(least, most))
                rows.append((k, sans, notation.printed(sans, level, rng, junk)))
            yield pd.DataFrame(rows, columns=[key, "truth", "text"])

    return keys.select(key).mapInPandas(run, f"{key} {keys.schema[key].dataType.simpleString()}, truth array<string>, text string")


def printed_boards(df: DataFrame, key: str, plies: int) -> DataFrame:
    """All columns and `board`: eight lines of the position after a game of random legal moves, the same for equal keys."""

    def make(k: object) -> tuple:
        p, rng = board.read_fen(board.START), random.Random(str(k))
        for _ in range(plies):
            p = board.play(p, rng.choice(board.legal(p)))
        return ("\n".join("".join(p.squares[8 * r : 8 * r + 8]) for r in range(7, -1, -1)),)

    return _rows(df, [key], make, "board string")


def position_counts(df: DataFrame, fen: str, depth: str) -> DataFrame:
    """All columns and `nodes`: how many positions so many plies of legal moves lead to."""
    return _rows(df, [fen, depth], lambda f, d: (board.perft(board.read_fen(f), int(d)),), "nodes long")


def main_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """The printed moves of each text's main runs, one after the other, from the initial position."""
    found = runs(df, key, text).where("depth = 0")
    return found.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "moves"))), lambda x: x["moves"])).alias("moves")).withColumn("start", F.lit(board.START))


def accuracy(decoded: DataFrame, truth: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Moves read rightly by place, and games read without a mistake."""
    pairs = truth.join(decoded.select(key, F.transform("decoded", lambda d: d["san"]).alias("read")), key, "left")
    right = F.size(F.filter(F.sequence(F.lit(0), F.size("truth") - 1), lambda i: F.get("truth", i) == F.get("read", i)))
    scored = pairs.select(*by, F.size("truth").alias("moves"), F.coalesce(right, F.lit(0)).alias("right"))
    return scored.groupBy(*by).agg(F.count("*").alias("games"), F.sum("moves").alias("moves"), F.sum("right").alias("right"), F.count_if(F.col("moves") == F.col("right")).alias("exact_games"), F.round(F.sum("right") / F.sum("moves"), 6).alias("accuracy"))


LINE = "line int, start_fen string, title string, result string, status string, nodes string, waiting string, pgn string"


def assembled(df: DataFrame, key: str, text: str, model: NoiseModel | None = None, exact: bool = False) -> DataFrame:
    """Lines of each text: tree (as JSON), what waits and why, worst status of its main moves, and the game text."""
    shared = df.sparkSession.sparkContext.broadcast(model or NoiseModel())

    def make(t: str) -> list[tuple]:
        out = []
        for line in tree.assemble(t, Decoder(shared.value), exact=exact):
            ranks = {"ok": 0, "guessed": 1, "ambiguous": 2, "failed": 3}
            main = [n.status for n in line.nodes if n.main and n.status in ranks]
            status = max(main, key=ranks.__getitem__) if main else "waiting" if not line.start_fen else "failed"
            out.append((line.id, line.start_fen, line.title, line.result, status, json.dumps([asdict(n) for n in line.nodes]), json.dumps(line.waiting), tree.game_text(line) if line.nodes else ""))
        return out

    return _each(df, key, text, make, LINE)


NODE = "array<struct<id:int,parent:int,line:int,main:boolean,ply:int,san:string,raw:string,status:string,fen:string,start:int,end:int,comment:string>>"


def nodes(lines: DataFrame) -> DataFrame:
    """The tree of each line as rows."""
    return lines.select(*[c for c in lines.columns if c not in ("nodes", "waiting", "pgn", "line", "start_fen", "title", "result", "status")], F.explode(F.from_json("nodes", NODE)).alias("n")).select("*", "n.*").drop("n")


def validated(lines: DataFrame) -> DataFrame:
    """Each line's game text read back: whether its main moves are those of the tree, in order."""
    main = F.transform(F.filter(F.from_json("nodes", NODE), lambda n: n["main"] & n["san"].isNotNull()), lambda n: n["san"])

    @F.pandas_udf("array<string>")
    def back(text: pd.Series) -> pd.Series:
        return text.map(tree.main_moves)

    return lines.withColumn("valid", back("pgn") == main)


def write_games(lines: DataFrame, path: str, by: str) -> None:
    """One folder a chapter, a game after the other in each file; lines that only wait are left out."""
    lines.where("pgn <> ''").select(by, F.col("pgn").alias("value")).repartition(by).sortWithinPartitions(by).write.partitionBy(by).text(path)


def diagrams(lines: DataFrame, page: str, order: str, text: str) -> DataFrame:
    """Text diagrams: eight lines of a page that follow each other and form a legal placement. Each line looks ahead in a window of its page."""
    from pyspark.sql import Window

    ahead = Window.partitionBy(page).orderBy(order).rowsBetween(0, 7)

    @F.pandas_udf("string")
    def board_of(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: tree.find_diagram([str(x) for x in r]))

    shaped = lines.withColumn("_board", F.col(text).rlike(r"^[pnbrqkPNBRQK.\-+*_ ·□■♔-♟]{8,15}$"))
    full = shaped.withColumns({"_rows": F.collect_list(text).over(ahead), "_ok": F.bool_and("_board").over(ahead)}).where(F.col("_ok") & (F.size("_rows") == 8))
    return full.select(page, order, board_of("_rows").alias("placement")).where("placement is not null")


def suggestions(ends: DataFrame, printed: DataFrame, most_plies: int = 4, most_pages: int = 2) -> DataFrame:
    """For each branch end (book, line, offset, page, ply: the next one) the next printed run of another line after it, 0 to 4 plies ahead and at most two pages on.

    Runs are as-of joined by page cells: a branch end meets the runs of its own page and the next two only.
    """
    r = printed.select(F.col("book").alias("_b"), F.col("line").alias("_l"), F.col("offset").alias("_o"), F.col("page").alias("_p"), F.col("ply").alias("_y"), "moves")
    reach = r.withColumn("_k", F.explode(F.sequence(F.col("_p") - most_pages, F.col("_p"))))
    pairs = ends.join(reach, (F.col("book") == F.col("_b")) & (F.col("page") == F.col("_k"))).where((F.col("_o") > F.col("offset")) & (F.col("_l") != F.col("line")) & (F.col("_y") - F.col("ply")).between(0, most_plies))
    return pairs.groupBy("book", "line").agg(F.min_by(F.struct(F.col("_l").alias("from_line"), F.col("_o").alias("at"), (F.col("_y") - F.col("ply")).alias("gap"), "moves"), "_o").alias("s")).select("book", "line", "s.*")


def numbering(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """How texts of a group number their moves: pairs of consecutive numbers around plain moves without dots and with them, and whether numbers without dots are to be read."""
    flat = F.regexp_replace(F.col(text), r"\s+", " ")
    pairs = lambda shape: F.size(F.filter(F.arrays_zip(F.regexp_extract_all(flat, F.lit(shape), 1).alias("a"), F.regexp_extract_all(flat, F.lit(shape), 2).alias("b")), lambda x: x["b"].cast("int") == x["a"].cast("int") + 1))
    counts = df.select(*by, pairs(notation.DOTLESS_PAIR).alias("dotless"), pairs(notation.DOTTED_PAIR).alias("dotted")).groupBy(*by).agg(F.sum("dotless").alias("dotless"), F.sum("dotted").alias("dotted"))
    return counts.withColumn("reads_dotless", (F.col("dotless") >= V.DOTLESS_LEAST) & (F.col("dotless") >= V.DOTLESS_SHARE * F.col("dotted")))


def noise_rates(decoded: DataFrame) -> DataFrame:
    """How often moves that were read show each kind of misprint: one row of counts and rates. Failed moves and castling tell nothing of squares."""
    d = decoded.select(F.explode("decoded").alias("d")).select("d.*")
    to = lambda k: F.regexp_extract("san", "([a-h])([1-8])(?:=[QRBN])?[+#]?$", k)
    told = F.col("san").isNotNull() & ~F.col("san").startswith("O")
    piece, takes, check = told & F.col("san").rlike("^[KQRBN]"), told & F.col("san").contains("x"), told & F.col("san").rlike("[+#]$")
    at = lambda k: F.substring("printed", k, 1)
    kinds = {
        "vanished": (piece, F.col("symbol") == ""), "file": (told, at(1) != to(1)), "rank": (told, at(2) != to(2)),
        "mark": (takes, at(3) != "x"), "sign": (check, ~F.col("raw").rlike("[+#†‡t][!?]*$")),
    }
    counts = d.agg(F.count("*").alias("moves"), F.count_if(F.col("status") == "failed").alias("failed"), *[x for name, (among, odd) in kinds.items() for x in (F.count_if(among).alias(f"{name}_of"), F.count_if(among & odd).alias(name))])
    return counts.select("*", *[F.round(F.col(name) / F.greatest(F.col(f"{name}_of"), F.lit(1)), 6).alias(f"{name}_rate") for name in kinds])


def _rows(df: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """All columns and what make() gives for those named; positions are read in Python, a row at a time in Arrow batches."""
    names = [c.strip().split(" ")[0] for c in _columns(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [make(*(list(x) if isinstance(x, np.ndarray) else x for x in row)) for row in zip(*(pdf[c] for c in columns), strict=True)]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{own}, {schema}")


def filled(df: DataFrame, fen: str, following: str, missing: str) -> DataFrame:
    """The missing moves before printed ones, where they are decided."""
    return _rows(df, [fen, following, missing], lambda f, m, n: (repair.fill(Decoder(), f, m, int(n)),), "filled array<string>")


def paths(df: DataFrame, start: str, placement: str, plies: str) -> DataFrame:
    """Moves from a position to a placement in at most so many plies."""
    return _rows(df, [start, placement, plies], lambda s, p, n: (repair.path(s, p, int(n)),), "path array<string>")


def repaired(df: DataFrame, fen: str, moves: str) -> DataFrame:
    """The position with the one square changed that makes all moves read."""
    return _rows(df, [fen, moves], lambda f, m: (repair.square(Decoder(), f, m),), "repaired string")


def regions(df: DataFrame, fen: str, moves: str) -> DataFrame:
    """Moves of a region read with the side that the position names or the other, and whether it was changed."""

    def make(f: str, m: list[str]) -> tuple:
        rows, changed = repair.region(Decoder(), f, m)
        return [r["san"] for r in rows], changed

    return _rows(df, [fen, moves], make, "read array<string>, changed boolean")


def read_on(df: DataFrame, fen: str, ply: str, runs: str, declined: str) -> DataFrame:
    """Lines read on by themselves from their last position: steps made (as text), moves gained and the reason to stop. runs: array of structs ply, key, moves."""

    def make(f: str, p: int, found: list, skip: list) -> tuple:
        made, why = repair.read_on(Decoder(), f, int(p), [(int(r["ply"]), r["key"], list(r["moves"])) for r in found], frozenset(skip))
        return [" ".join([x["how"], x["key"], *x["filled"], "|", *x["moves"]]) for x in made], sum(len(x["filled"]) + len(x["moves"]) for x in made), why

    return _rows(df, [fen, ply, runs, declined], make, "steps array<string>, gained int, stop string")


def assembled_chapters(df: DataFrame, book: str, chapter: str, text: str) -> DataFrame:
    """Lines of each chapter, where the first run of a chapter may go on from the line before. A chapter needs the one before it, so a book's chapters are streamed in order."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (book, chapter)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, before = None, None
        for pdf in frames:
            out = []
            for b, c, t in zip(pdf[book], pdf[chapter], pdf[text], strict=True):
                before = before if b == now else None
                now = b
                lines = tree.assemble(t or "", Decoder(), before=before)
                before = next((x for x in reversed(lines) if x.nodes), None)
                out += [(b, c, x.id, x.joins, x.title, x.result, [f"{n.ply} {n.san} {n.status}" for n in x.nodes if n.main], len(x.waiting)) for x in lines]
            yield pd.DataFrame(out, columns=[book, chapter, "line", "joins", "title", "result", "moves", "waiting"]).astype(object)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(book, chapter, text).repartition(n, book).sortWithinPartitions(book, chapter)
    return rows.mapInPandas(run, f"{book} {kinds[book]}, {chapter} {kinds[chapter]}, line int, joins int, title string, result string, moves array<string>, waiting int")


def listings(df: DataFrame, key: str, text: str, model: NoiseModel | None = None) -> DataFrame:
    """Each text's lines as listings: line, place, depth and text, variations nested."""
    shared = df.sparkSession.sparkContext.broadcast(model or NoiseModel())
    return _each(df, key, text, lambda t: [(line.id, *row) for line in tree.assemble(t, Decoder(shared.value)) for row in tree.listing(line)], "line int, place int, depth int, shown string")


def choose_start(candidates: DataFrame, run: str, order: str, start: str, moves: str, model: NoiseModel | None = None) -> DataFrame:
    """The start position of each run: candidates (the default has order 0) are decoded, equal ones once, and scored by clean moves before the first failure, failures and mean cost.

    A rival beats the default if it is clean where the default fails and reads further, or if it reads three moves further, fails less and costs at most 0.5 more.
    """
    read = decode(candidates, start, moves, model)
    bad = F.transform("decoded", lambda d: (d["status"] == "failed").cast("int"))
    clean = F.coalesce(F.array_position(bad, 1) - 1, F.lit(0))
    scored = read.select(
        run, order, start, moves, F.when(F.array_contains(bad, 1), clean).otherwise(F.size("decoded")).cast("int").alias("read"), F.aggregate(bad, F.lit(0), lambda s, x: s + x).alias("failed"),
        F.coalesce(F.aggregate(F.filter("decoded", lambda d: d["status"] != "failed"), F.lit(0.0), lambda s, d: s + d["cost"]) / F.greatest(F.size(F.filter("decoded", lambda d: d["status"] != "failed")), F.lit(1)), F.lit(0.0)).alias("mean"),
    )
    first = scored.where(F.col(order) == 0).select(F.col(run).alias("_run"), F.col("read").alias("_read"), F.col("failed").alias("_failed"), F.col("mean").alias("_mean"))
    both = scored.join(first, F.col(run) == F.col("_run"), "left")
    beats = F.col("_run").isNull() | ((F.col("failed") == 0) & (F.col("mean") <= 1.0) & (F.col("_failed") > 0) & (F.col("read") > F.col("_read"))) | ((F.col("read") >= F.col("_read") + 3) & (F.col("failed") < F.col("_failed")) & (F.col("mean") <= F.col("_mean") + 0.5))
    allowed = both.where((F.col(order) == 0) | beats)
    best = F.max_by(F.struct(order, start, "read", "failed", "mean"), F.struct(beats.cast("int"), "read", -F.col("failed"), -F.col("mean"), -F.col(order)))
    return allowed.groupBy(run).agg(best.alias("b")).select(run, "b.*")
