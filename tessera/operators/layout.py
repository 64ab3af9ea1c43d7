"""Layout analytics over page lines: font profiles and roles, line roles, chapters, reading order, labels of pictures.

Lines come already extracted: page, line_no, x0, y0, x1, y1, text, font, size (and whatever else they carry).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One size within this share, share of moves of a move font, share of coordinate spans, how much larger a heading is.
SAME_SIZE, MOVE_SHARE, COORDINATE_SHARE, HEADING_RATIO, CAPITALS_SHARE = 0.04, 0.35, 0.5, 1.25, 0.5
#: What a move, a coordinate and a game's heading look like as words.
MOVE_WORD, COORDINATE_WORD, GAME_HEADER = r"^(?:[0-9]{1,3}\.(?:\.\.)?)?(?:[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?|O-O(?:-O)?)[+#!?]*$", "^(?:[a-h]|[1-8])$", r"^\S.* [-–] \S.*$"


def _words(text: str = "text") -> Column:
    return F.filter(F.split(F.col(text), " "), lambda w: w != "")


def _count(pattern: str) -> Column:
    return F.size(F.filter(_words(), lambda w: w.rlike(pattern)))


def font_profiles(lines: DataFrame) -> DataFrame:
    """Characters, pages, lines, words of moves and coordinates and lines of capitals for each font and size; sizes within a share of each other are one."""
    grid = F.round(F.exp(F.round(F.log("size") / F.log(F.lit(1 + SAME_SIZE))) * F.log(F.lit(1 + SAME_SIZE))), 1)
    capitals = (F.col("text") == F.upper("text")) & F.col("text").rlike("[A-Z]{2}")
    facts = lines.select("font", grid.alias("size"), "page", F.length("text").alias("chars"), F.size(_words()).alias("words"), _count(MOVE_WORD).alias("moves"), _count(COORDINATE_WORD).alias("coordinates"), capitals.cast("int").alias("capitals"))
    return facts.groupBy("font", "size").agg(
        F.sum("chars").alias("chars"), F.count_distinct("page").alias("pages"), F.count("*").alias("lines"), F.sum("words").alias("words"), F.sum("moves").alias("moves"), F.sum("coordinates").alias("coordinates"), F.sum("capitals").alias("capitals")
    )


def font_roles(profiles: DataFrame) -> DataFrame:
    """Roles of fonts: body (most characters, the smaller size on ties), moves, coordinates, heading, other. The one row of the body is found by an aggregate."""
    body = profiles.agg(F.max_by(F.struct("font", "size", "moves", "words"), F.struct("chars", -F.col("size"))).alias("b"), F.sum("moves").alias("all_moves"))
    p = profiles.crossJoin(F.broadcast(body))  # one row
    ratio, own = F.col("moves") / F.greatest(F.col("words"), F.lit(1)), (F.col("font") == F.col("b.font")) & (F.col("size") == F.col("b.size"))
    body_ratio = F.col("b.moves") / F.greatest(F.col("b.words"), F.lit(1))
    moves = (F.col("moves") >= F.greatest(F.lit(5), 0.03 * F.col("all_moves"))) & (ratio >= MOVE_SHARE) & (ratio >= 2 * body_ratio) & (F.col("coordinates") < COORDINATE_SHARE * F.col("words"))
    coordinates = F.col("coordinates") >= F.greatest(F.lit(5), COORDINATE_SHARE * F.col("words"))
    heading = (F.col("size") >= HEADING_RATIO * F.col("b.size")) | ((F.col("lines") >= 2) & (F.col("capitals") >= CAPITALS_SHARE * F.col("lines")))
    role = F.when(own, "body").when(coordinates, "coord").when(moves, "moves").when(heading, "heading").otherwise("other")
    return p.select(*profiles.columns, role.alias("role"))


#: What a picture's label looks like; how far a label is from its picture above and beside it; how far a caption, and its words at most.
LABEL, LABEL_GAP, LABEL_SIDE, CAPTION_GAP, CAPTION_WORDS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3})?[a-d]?)$", 90.0, 25.0, 14.0, 8


def beside_pictures(lines: DataFrame, pictures: DataFrame) -> DataFrame:
    """page, line_no, _label and _caption: whether a line stands where the label, or a caption, of a picture (page, x0, y0, x1, y1) of its page does: above it within a gap, or within a third of that below, its centre beside the picture no further
    than a little. Pictures of a page are few; lines without any have no row."""
    p = pictures.select(F.col("page").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    centre = (F.col("x0") + F.col("x1")) / 2
    near = lines.select("page", "line_no", "x0", "y0", "x1", "y1").join(p, F.col("page") == F.col("_p")).where(centre.between(F.col("_x0") - LABEL_SIDE, F.col("_x1") + LABEL_SIDE))
    above, below = F.col("_y0") - F.col("y1"), F.col("y0") - F.col("_y1")
    within = lambda gap: above.between(-2.0, gap) | below.between(-2.0, gap / 3)
    return near.groupBy("page", "line_no").agg(F.bool_or(within(LABEL_GAP)).alias("_label"), F.bool_or(above.between(-2.0, CAPTION_GAP) | below.between(-2.0, CAPTION_GAP)).alias("_caption"))


#: Rows of fonts up to which they are broadcast; they are counted first, and more are joined as Spark sees fit.
FONTS = 20_000


def with_fonts(rows: DataFrame, fonts: DataFrame, on: Column) -> DataFrame:
    """Rows left joined with a table of fonts. A book has few fonts and most of its rows are in one of them, so rows are not dealt out by their font unless the fonts are many. fonts: counted here, so materialised."""
    return rows.join(F.broadcast(fonts) if fonts.count() <= FONTS else fonts, on, "left")


def line_roles(lines: DataFrame, roles: DataFrame, head: float, foot: float, pictures: DataFrame | None = None) -> DataFrame:
    """The first role that fits each line: head (outside the page's text band), blank, label and caption (of pictures, where these are given), coord, game_header, heading, moves, text; a header inside a sentence is text again. page and line_no tell lines apart."""
    grid = F.round(F.exp(F.round(F.log("size") / F.log(F.lit(1 + SAME_SIZE))) * F.log(F.lit(1 + SAME_SIZE))), 1)
    from .materialise import cut

    fonts = cut(roles.select(F.col("font").alias("_f"), F.col("size").alias("_s"), F.col("role").alias("font_role")))
    known = with_fonts(lines.withColumn("_g", grid), fonts, (F.col("font") == F.col("_f")) & (F.col("_g") == F.col("_s"))).drop("_f", "_s", "_g")
    n = F.size(_words())
    label = caption = F.lit(False)
    if pictures is not None:
        known = known.join(beside_pictures(lines, pictures), ["page", "line_no"], "left").select(*lines.columns, "font_role", "_label", "_caption")
        label = F.coalesce("_label", F.lit(False)) & F.trim("text").rlike(LABEL)
        caption = F.coalesce("_caption", F.lit(False)) & (n <= CAPTION_WORDS) & (_count(MOVE_WORD) == 0) & (_count(COORDINATE_WORD) < n)
    role = (
        F.when((F.col("y1") <= head) | (F.col("y0") >= foot), "head")
        .when(F.trim("text") == "", "blank")
        .when(label, "label")
        .when(caption, "caption")
        .when(_count(COORDINATE_WORD) == n, "coord")
        .when(F.col("text").rlike(GAME_HEADER) & (n <= 12) & (_count(MOVE_WORD) == 0), "game_header")
        .when(F.col("font_role") == "heading", "heading")
        .when(_count(MOVE_WORD) > 0.5 * n, "moves")
        .otherwise("text")
    )
    first = known.withColumn("role", role).drop("_label", "_caption")
    w = Window.partitionBy("page").orderBy("line_no")
    inside = (F.col("role") == "game_header") & F.col("text").rlike("^[a-z]") & (F.lag("role").over(w) == "text")
    return first.withColumn("role", F.when(inside, "text").otherwise(F.col("role")))


def chapters(lines: DataFrame, last_page: int, book: str | None = None) -> DataFrame:
    """Chapters from headings among the first six lines of a page: the style on most pages (larger size on ties), one a page; each ends before the next starts. With `book`, a column, each book by itself."""
    by, lines = [book or "_one"], lines if book else lines.withColumn("_one", F.lit(0))
    w = Window.partitionBy(*by, "page").orderBy("line_no")
    top = lines.where("role not in ('head', 'blank')").withColumn("_n", F.row_number().over(w)).where("_n <= 6 and role = 'heading'")
    style = top.groupBy(*by, "font", "size").agg(F.count_distinct("page").alias("pages")).where("pages >= 2").groupBy(*by).agg(F.max_by(F.struct("font", "size"), F.struct("pages", "size")).alias("s"))
    own = top.join(style, by).where("font = s.font and size = s.size")
    starts = own.groupBy(*by, "page").agg(F.min_by(F.trim("text"), "line_no").alias("title"))
    after = F.lead("page").over(Window.partitionBy(*by).orderBy("page"))  # a row a chapter
    return starts.select(*([book] if book else []), "title", F.col("page").alias("start"), F.coalesce(after - 1, F.lit(last_page)).alias("end"))


def reading_order(lines: DataFrame, gutter: DataFrame, body: float) -> DataFrame:
    """All columns, column (0 across, 1 left, 2 right) and place (from 0) of lines in reading order: lines that cross a page's gutter cut it into bands, each band goes left then right, and lines of a side whose
    lower edges lie within 0.4 of the body size of the first one's are one row, read from the left.

    gutter: page, x; a page without one has one column. Bands are running counts over a page, rows are greedy bands by successor pointers, so nothing is walked. Null edges come first in their band; an empty table gives an empty result."""
    from .chains import row_groups

    x, near = F.col("_x"), 0.3 * body
    joined = lines.join(gutter.select(F.col("page").alias("_p"), F.col("x").alias("_x")), F.col("page") == F.col("_p"), "left").drop("_p")
    full = F.coalesce((F.col("x0") < x - near) & (F.col("x1") > x + near), F.lit(False))
    down = Window.partitionBy("page").orderBy("y0", "x0", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    side = F.when(full | x.isNull(), 0).otherwise(((F.col("x0") + F.col("x1")) / 2 > x).cast("int"))
    own = joined.withColumns({"_full": full, "_band": 2 * F.sum(full.cast("int")).over(down) - full.cast("int"), "_side": side})
    own = own.withColumn("_key", F.struct("page", "_band", "_side"))
    banded = row_groups(own, "_key", "y1", 0.4 * body).withColumnRenamed("band", "_row")
    order = Window.partitionBy("page").orderBy("_band", "_side", "_row", "x0", "y0", "line_no")
    column = F.when(F.col("_full") | x.isNull(), 0).otherwise(F.col("_side") + 1).cast("int")
    return banded.select(*lines.columns, column.alias("column"), (F.row_number().over(order) - 1).alias("place"))


def cut_order(boxes: DataFrame, page: str, id: str, across: float = 0.0, down: float = 0.0, rounds: int = 40) -> DataFrame:
    """All columns, region (array of cuts) and place (from 1) of boxes in reading order by recursive cuts along white space: a page is cut where no box covers a height (by more than `down`), each part where none covers a
    breadth (by more than `across`), and so on in turn, until neither cuts any part. boxes: page, id, x0, y0, x1, y1.

    A cut is an island of intervals: boxes sorted by their near edge, where an edge lies beyond all far edges before it. All parts of all pages are cut at once, so the number of rounds is twice the depth of the deepest page and not its
    number of parts. Boxes that no white space parts are read by height, then from the left. Boxes with a null edge are dropped; edges in the wrong order are taken as they are; equal boxes go by id."""
    from .materialise import cut

    now = cut(boxes.where("x0 is not null and x1 is not null and y0 is not null and y1 is not null").withColumn("region", F.array().cast("array<long>")))
    parts, still = now.select(page).distinct().count(), 0
    for r in range(rounds):
        low, high, gap = ("y0", "y1", down) if r % 2 == 0 else ("x0", "x1", across)
        inside = Window.partitionBy(page, "region").orderBy(low, id)
        top = F.max(high).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        told = now.withColumn("_new", F.coalesce((F.col(low) > top + gap).cast("long"), F.lit(0)))
        now = cut(told.withColumn("region", F.concat("region", F.array(F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))))).drop("_new"))
        have = now.select(page, "region").distinct().count()
        still, parts = (still + 1 if have == parts else 0), have
        if still == 2:
            break
    else:
        raise RuntimeError("a page is cut deeper than the rounds allow")
    return now.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("region", "y0", "x0", id)))


def labelled(pictures: DataFrame, labels: DataFrame, gap: float = 90.0, side: float = 25.0, lap: float = 2.0) -> DataFrame:
    """Each picture's label: the nearest within `gap` above it, else within a third of that below, its centre no further than `side` beside the picture; each label once, nearest pairs first."""
    from .aggregates import assign

    p = pictures.select("page", F.col("id").alias("picture"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("y0").alias("_y0"), F.col("y1").alias("_y1"))
    centre = (F.col("x0") + F.col("x1")) / 2
    pairs = labels.select("page", F.col("id").alias("label"), centre.alias("x"), "y0", "y1").join(p, "page").where(F.col("x").between(F.col("_x0") - side, F.col("_x1") + side))
    above, below = F.col("_y0") - F.col("y1"), F.col("y0") - F.col("_y1")
    near = pairs.withColumn("distance", F.when(above.between(-lap, gap), above).when(below.between(-lap, gap / 3), gap + below)).where("distance is not null")
    return assign(near.select("picture", "label", (-F.col("distance")).alias("support")), "picture", "label", "support").select("picture", "label", (-F.col("support")).alias("distance"))


def hidden_removed(df: DataFrame) -> DataFrame:
    """Without private fields: those with a leading underscore."""
    return df.select([c for c in df.columns if not c.startswith("_")])


def overlapping(df: DataFrame, start: str, end: str, first: int, last: int) -> DataFrame:
    """Rows whose closed range overlaps another one."""
    return df.where((F.col(start) <= last) & (F.col(end) >= first))


def unglued(text: Column, title: str) -> Column:
    """An injected title taken out only where it is glued to a word."""
    import re

    return F.regexp_replace(text, f"(?<=\\w){re.escape(title)}|{re.escape(title)}(?=\\w)", "")


#: Words that lead a move in prose, by what they say about it.
CUES = {"threat": r"(?i)\b(threat(?:en(?:s|ing)?|s)?|intending|with the idea)\b", "alternative": r"(?i)\b(or|instead|if|better(?: was)?|after)\b[^.]{0,12}$", "follow": r"(?i)\b(followed by|and then|then)\b[^.]{0,12}$", "bare": r"(?i)\b(e\.g\.|for example|namely)(?![a-z])", "range": r"(?i)\bmoves? +[0-9]{1,3} *(?:-|–|to) *[0-9]{1,3}\b"}


def cue(before: Column) -> Column:
    """The kind of cue in the text before a move; null without one."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(CUES.items()):
        out = F.when(before.rlike(pattern), kind).otherwise(out)
    return out


def side_to_move(before: Column) -> Column:
    """w or b from the text around a diagram; null where it says neither."""
    return F.when(before.rlike(r"(?i)\bwhite\b[^.]{0,20}\b(to (?:move|play)|plays?|moves?)\b|(?i)\bw\b\s*$"), "w").when(before.rlike(r"(?i)\bblack\b[^.]{0,20}\b(to (?:move|play)|plays?|moves?)\b|(?i)\bb\b\s*$"), "b")


def word_shape(word: Column) -> Column:
    """strong, weak or none: how much a word looks like a move."""
    return F.when(word.rlike(MOVE_WORD), "strong").when(word.rlike(r"[a-h£t][1-8lIsSB][t+#!?]*$") & (F.length(word) <= 8), "weak").otherwise("none")


def run_fit(costs: DataFrame, run: str, cost: str, failed: str) -> DataFrame:
    """How well runs read: 0 cleanly, 1 with few failures, 2 not. Mean cost at most 1.5 and the first move read for 0; at most a fifth failed for 1."""
    agg = costs.groupBy(run).agg(F.avg(F.when(~F.col(failed), F.col(cost))).alias("mean"), F.avg(F.col(failed).cast("int")).alias("share"), F.min_by(failed, "pos").alias("first_failed"))
    return agg.withColumn("fit", F.when((F.col("share") == 0) & (F.col("mean") <= 1.5), 0).when(~F.col("first_failed") & (F.col("share") <= 0.2), 1).otherwise(2))


def reached(nodes: DataFrame, diagrams: DataFrame) -> DataFrame:
    """Nodes whose position equals a diagram's placement: an equi join on the first field."""
    return nodes.withColumn("_p", F.element_at(F.split("fen", " "), 1)).join(diagrams.select(F.col("placement").alias("_p"), F.col("id").alias("diagram")), "_p").drop("_p")


def clean_runs(costs: DataFrame, run: str, order: str, cost: str, failed: str, most_failed: float = 0.2, mean: float = 1.5) -> DataFrame:
    """Runs that read cleanly: few failures, none at the start, and cheap on the whole."""
    agg = costs.groupBy(run).agg(F.avg(F.when(~F.col(failed), F.col(cost))).alias("_mean"), F.avg(F.col(failed).cast("int")).alias("_share"), F.min_by(failed, order).alias("_first"))
    return agg.where(~F.col("_first") & (F.col("_share") <= most_failed) & (F.col("_mean") <= mean)).select(run)


def moves_only(text: Column) -> Column:
    """Whether a line holds moves, numbers, results and signs and nothing else."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.rlike(MOVE_WORD) | w.rlike(r"^(?:[0-9]{1,3}\.(?:\.\.)?|1-0|0-1|1/2-1/2|[!?+#=]{1,2})$")) & F.exists(words, lambda w: w.rlike(MOVE_WORD))


def word_classes(words: DataFrame, roles: DataFrame) -> DataFrame:
    """All columns and `main`: whether a word stands in the font of moves (or, in a book without one, in the heading's or body's) and not in a note's. Roles are joined by font, broadcast while they are few."""
    from .materialise import cut

    own = cut(roles.select(F.col("font").alias("_f"), F.col("role").alias("_r")))
    has = F.broadcast(own.agg(F.max((F.col("_r") == "moves").cast("int")).alias("_own")))
    known = with_fonts(words, own, F.col("font") == F.col("_f")).crossJoin(has)  # one row
    return known.withColumn("main", F.when(F.col("_own") == 1, F.coalesce(F.col("_r") == "moves", F.lit(False))).otherwise(F.coalesce(F.col("_r").isin("body", "heading"), F.lit(False)))).drop("_f", "_r", "_own")


#: What stands in the notes where words of the main font are left out.
NOTE_BREAK = "¶"


def buffers(words: DataFrame, line: list[str]) -> DataFrame:
    """Three texts of one length for each line: all words, those of the main font, and the notes, where each run of main words starts with a break; what is left out is blank. words: line columns, word_no, text, main."""
    blank = F.rpad(F.lit(""), F.length("text"), F.lit(" "))
    before = F.lag("main").over(Window.partitionBy(*line).orderBy("word_no"))
    note = F.when(~F.col("main"), F.col("text")).when(F.coalesce(before, F.lit(False)), blank).otherwise(F.rpad(F.lit(NOTE_BREAK), F.length("text"), F.lit(" ")))
    parts = words.select(*line, F.struct("word_no", F.col("text").alias("original"), F.when(F.col("main"), F.col("text")).otherwise(blank).alias("main_text"), note.alias("note_text")).alias("w"))
    lists = parts.groupBy(*line).agg(F.array_sort(F.collect_list("w")).alias("w"))
    return lists.select(*line, *[F.array_join(F.col("w")[n], " ").alias(n) for n in ("original", "main_text", "note_text")])


def solutions(items: DataFrame, diagrams: DataFrame, book: str) -> DataFrame:
    """The exercise diagram of each numbered solution. items: book, at, label; diagrams: book, at, id, label, main (of the main series), section.

    In order of the text: the first diagram with the label after the one that the solution before took and before the solution, outside the main series first; else the only diagram of the book with the label; else, for
    number n, the n-th diagram without a label of a section, sections in order, a new one each time that solutions start again. A solution needs those before it, so a book is walked in order: rows are sorted in their partition and streamed."""
    d = diagrams.select(book, "at", F.lit(0).alias("_k"), F.col("id").cast("string").alias("id"), "label", "main", "section")
    rows = d.unionByName(items.select(book, "at", F.lit(1).alias("_k"), F.lit(None).cast("string").alias("id"), "label", F.lit(None).cast("boolean").alias("main"), F.lit(None).cast(d.schema["section"].dataType).alias("section")))
    only = diagrams.where("label is not null").groupBy(book, "label").agg(F.count("*").alias("_n"))
    rows = rows.join(only, [book, "label"], "left")
    kind = items.schema[book].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r[book] != now.get("book", now):
                    now = {"book": r[book], "seen": [], "pointer": -1, "last": None, "group": -1}
                if r["_k"] == 0:
                    now["seen"].append(r)
                    continue
                label, n = r["label"], int(r["label"]) if (r["label"] or "").isdigit() else None
                again = n is not None and (now["last"] is None or n <= now["last"])
                now["last"] = n if n is not None else now["last"]
                at = next((k for main in (False, True) for k, x in enumerate(now["seen"]) if k > now["pointer"] and x["label"] == label and (main or not x["main"])), None)
                if at is not None:
                    now["pointer"] = at
                elif r["_n"] == 1:
                    at = next((k for k, x in enumerate(now["seen"]) if x["label"] == label), None)
                if at is None and n is not None:
                    now["group"] += again
                    groups: list[list[int]] = []
                    for k, x in enumerate(now["seen"]):
                        if x["label"] is None:
                            if not groups or now["seen"][groups[-1][-1]]["section"] != x["section"]:
                                groups.append([])
                            groups[-1].append(k)
                    if 0 <= now["group"] < len(groups) and n <= len(groups[now["group"]]):
                        at = groups[now["group"]][n - 1]
                        now["pointer"] = max(now["pointer"], at)
                out.append((r[book], r["at"], label, now["seen"][at]["id"] if at is not None else None))
            cols = [list(c) for c in zip(*out, strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(book).type), pa.array(cols[1], batch.schema.field("at").type), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=[book, "at", "label", "diagram"])

    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, book).sortWithinPartitions(book, "at", "_k", "id").mapInArrow(walk, f"{book} {kind}, at {items.schema['at'].dataType.simpleString()}, label string, diagram string")
