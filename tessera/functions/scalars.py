"""Scalar functions as Column expressions: they stay in generated code and can be pushed down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .notation_values import DIGIT_SLIPS, SQUARE_FILES, SQUARE_RANKS

#: What counts as space at the ends of a token; control characters are data.
REAL_SPACES = " \n\r "
#: Letters that stand for digits in a badly printed number.
OCR_FROM, OCR_TO = "lI|OoSsB", "11100888"
#: Annotation signs and their numeric glyphs.
NAGS = {"!": 1, "?": 2, "!!": 3, "??": 4, "!?": 5, "?!": 6}
#: Results as printed and as stored.
RESULTS = {"1-0": "1-0", "0-1": "0-1", "1/2-1/2": "1/2-1/2", "½-½": "1/2-1/2", "1/2": "1/2-1/2", "*": "*"}
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def lookup(col: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), col)


def strip_real(col: Column) -> Column:
    """Strip real spaces only."""
    return F.btrim(col, F.lit(REAL_SPACES))


def ocr_digits(col: Column) -> Column:
    return F.translate(col, OCR_FROM, OCR_TO)


def number_values(col: Column) -> Column:
    """All values of a number with letter digits: an S reads as 8 and as 5; none for a leading zero or over three characters."""
    fits = (F.length(col) <= 3) & ocr_digits(col).rlike("^[1-9][0-9]*$")
    first, second = F.try_to_number(ocr_digits(col), F.lit("999")).cast("int"), F.try_to_number(F.translate(F.translate(col, "Ss", "55"), OCR_FROM, OCR_TO), F.lit("999")).cast("int")
    return F.when(fits, F.array_distinct(F.array(first, second))).otherwise(F.array().cast("array<int>"))


def digit_slip(raw: Column, want: Column) -> Column:
    """Whether a printed number is another one with a single digit misread as one that it is taken for."""
    digits, own = F.regexp_replace(raw, "[^0-9]", ""), want.cast("string")
    pairs = F.zip_with(F.split(digits, ""), F.split(own, ""), lambda a, b: F.array_join(F.array_sort(F.array(a, b)), ""))
    wrong = F.filter(pairs, lambda x: F.substring(x, 1, 1) != F.substring(x, 2, 1))
    return (F.length(digits) == F.length(own)) & (F.size(wrong) == 1) & F.coalesce(F.get(wrong, 0).isin(*[f"{min(pair)}{max(pair)}" for pair in DIGIT_SLIPS]), F.lit(False))


def printed_squares(raw: Column) -> Column:
    """Every square that a printed token may show, misread files and ranks included: place (from 0) and possible squares."""
    at = F.sequence(F.lit(0), F.length(raw) - 2)
    file = lambda i: F.coalesce(lookup(F.substr(raw, i + 1, F.lit(1)), SQUARE_FILES), F.substr(raw, i + 1, F.lit(1)))
    rank = lambda i: F.substr(raw, i + 2, F.lit(1))
    ranks = lambda i: F.when(rank(i).rlike("[1-8]"), rank(i)).otherwise(F.coalesce(lookup(rank(i), SQUARE_RANKS), F.lit("")))
    found = F.transform(at, lambda i: F.struct(i.alias("at"), F.when(file(i).rlike("^[a-h]$") & (ranks(i) != ""), F.transform(F.split(ranks(i), ""), lambda r: F.concat(file(i), r))).alias("squares")))
    return F.when(F.length(raw) >= 2, F.filter(found, lambda x: x["squares"].isNotNull())).otherwise(F.array().cast("array<struct<at:int,squares:array<string>>>"))


def word_part(x0: Column, x1: Column, chars: Column, first: Column, last: Column) -> Column:
    """The edges of characters first to last (excluded) of a word, cut in proportion to its characters."""
    wide = (x1 - x0) / F.greatest(chars, F.lit(1))
    return F.struct((x0 + wide * first).alias("x0"), (x0 + wide * last).alias("x1"))


def ply(number: Column, black: Column) -> Column:
    return (number - 1) * 2 + F.when(black, 1).otherwise(0)


def ordinal(n: Column) -> Column:
    tens, ones = n % 100, n % 10
    end = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def folio(page: Column, offset: Column) -> Column:
    return F.when(page - offset > 0, page - offset)


def result(col: Column) -> Column:
    return lookup(strip_real(col), RESULTS)


def nag(col: Column) -> Column:
    return lookup(col, NAGS)


def join_year(col: Column) -> Column:
    """1 921 as 1921."""
    return F.regexp_replace(col, r"\b([12]) ([0-9]{3})\b", "$1$2")


def roman(col: Column) -> Column:
    """Value of a Roman numeral; null for anything else."""
    digits = F.transform(F.split(F.lower(col), ""), lambda c: F.coalesce(lookup(c, _ROMAN), F.lit(0)))
    total = F.aggregate(
        digits,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, d: F.struct((a.sum + d - F.when(d > a["last"], a["last"] * 2).otherwise(0)).alias("sum"), d.alias("last")),
        lambda a: a.sum,
    )
    return F.when(F.lower(col).rlike("^[ivxlcdm]+$"), total)


def title_case(col: Column, small: tuple[str, ...] = ("a", "an", "and", "at", "by", "for", "in", "of", "on", "the", "to")) -> Column:
    """Words capitalised but for short ones after the first."""
    words = F.split(F.lower(col), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))), " ")


def natural_key(col: Column) -> Column:
    """Numbers of a label, for an order in which 2 comes before 14."""
    return F.transform(F.regexp_extract_all(col, F.lit("([0-9]+)"), 1), lambda x: x.cast("long"))


def token_key(page: Column, x: Column, y: Column, raw: Column) -> Column:
    return F.concat_ws(":", page.cast("string"), F.concat_ws(",", F.round(x).cast("long").cast("string"), F.round(y).cast("long").cast("string")), raw)


def parse_token_key(key: Column) -> Column:
    shape = r"(?s)^([0-9]+):(-?[0-9]+),(-?[0-9]+):(.*)$"
    part = [F.regexp_extract(key, shape, k) for k in range(1, 5)]
    return F.when(key.rlike(shape), F.struct(part[0].cast("int").alias("page"), part[1].cast("int").alias("x"), part[2].cast("int").alias("y"), part[3].alias("raw")))


def box_union(boxes: Column) -> Column:
    """The smallest box around an array of structs x0, y0, x1, y1."""
    edge = lambda n: F.transform(boxes, lambda b: b[n])
    return F.struct(F.array_min(edge("x0")).alias("x0"), F.array_min(edge("y0")).alias("y0"), F.array_max(edge("x1")).alias("x1"), F.array_max(edge("y1")).alias("y1"))


def box_near(a: dict[str, Column], b: dict[str, Column], near: float) -> Column:
    """Whether a box touches another one grown by `near`."""
    return (a["x0"] <= b["x1"] + near) & (a["x1"] >= b["x0"] - near) & (a["y0"] <= b["y1"] + near) & (a["y1"] >= b["y0"] - near)


def placement(fen: Column) -> Column:
    return F.element_at(F.split(fen, " "), 1)


def squares(fen: Column) -> Column:
    """The 64 squares of a placement, from a8 to h1; an empty one is a dot."""
    spread = reduce(lambda c, n: F.replace(c, F.lit(str(n)), F.lit("." * n)), range(8, 0, -1), F.replace(placement(fen), F.lit("/"), F.lit("")))
    return F.filter(F.split(spread, ""), lambda c: c != "")


def square_diff(a: Column, b: Column) -> Column:
    """Squares where two positions differ, as name, first and second."""
    both = F.arrays_zip(squares(a).alias("a"), squares(b).alias("b"))
    named = F.transform(both, lambda x, i: F.struct(F.concat(F.substring(F.lit("abcdefgh"), 1, 0), F.char(97 + i % 8), (8 - F.floor(i / 8)).cast("string")).alias("square"), x["a"].alias("first"), x["b"].alias("second")))
    return F.filter(named, lambda x: x["first"] != x["second"])


def legal_shape(fen: Column) -> Column:
    """One king a side, eight full ranks and no pawn on an end rank."""
    place = placement(fen)
    ranks = F.split(place, "/")
    count = lambda c: F.length(place) - F.length(F.replace(place, F.lit(c)))
    return (count("K") == 1) & (count("k") == 1) & (F.size(ranks) == 8) & (F.size(squares(fen)) == 64) & ~F.concat(F.get(ranks, 0), F.get(ranks, 7)).rlike("[Pp]")


def castling(fen: Column) -> Column:
    """Castling rights that kings and rooks on their first squares leave open."""
    s = squares(fen)
    at = lambda k, c: F.get(s, k) == c
    out = F.concat(*[F.when(at(king, k) & at(rook, r), name).otherwise("") for king, k, rook, r, name in ((60, "K", 63, "R", "K"), (60, "K", 56, "R", "Q"), (4, "k", 7, "r", "k"), (4, "k", 0, "r", "q"))])
    return F.when(out == "", "-").otherwise(out)


def clean_comment(col: Column) -> Column:
    """A comment without braces and control characters, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"[{}\x00-\x1f\x7f]", " "), " +", " "))


def engine_score(centipawns: Column, mate: Column) -> Column:
    return F.when(mate.isNotNull(), F.concat(F.lit("M"), mate.cast("string"))).otherwise(F.format_string("%+.1f", centipawns / 100.0))


def header(col: Column) -> Column:
    """Players, place and year of a game's heading: `White - Black, Place 1921`."""
    shape = r"^\s*(.+?)\s+[-–]\s+([^,]+?)(?:,\s*(.*?))?(?:,?\s+([12][0-9]{3}))?\s*$"
    joined = join_year(col)
    part = [F.nullif(F.regexp_extract(joined, shape, k), F.lit("")) for k in range(1, 5)]
    return F.when(joined.rlike(shape), F.struct(part[0].alias("white"), part[1].alias("black"), part[2].alias("site"), part[3].cast("int").alias("year")))


def chapter_heading(col: Column) -> Column:
    """Kind, number (Arabic or Roman) and title of a heading."""
    shape = r"(?i)^\s*(chapter|part|section)\s+([0-9]+|[ivxlcdm]+)\b[\s.:—-]*(.*)$"
    number = F.regexp_extract(col, shape, 2)
    return F.when(col.rlike(shape), F.struct(F.lower(F.regexp_extract(col, shape, 1)).alias("kind"), F.coalesce(F.try_to_number(number, F.lit("99999")).cast("int"), roman(number)).alias("number"), F.regexp_extract(col, shape, 3).alias("title")))
