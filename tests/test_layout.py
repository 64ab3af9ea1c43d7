"""Layout on hand-written pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tessera.operators import layout

LINES = "page int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, font string, size double"


@pytest.fixture(scope="module")
def lines(spark):
    rows = []
    for page in range(1, 5):
        rows.append((page, 0, 50.0, 5.0, 200.0, 15.0, f"running head {page}", "Body", 9.0))
        if page % 2:
            rows.append((page, 1, 50.0, 30.0, 200.0, 50.0, f"Part {page}", "Head", 18.0))
        rows.append((page, 2, 50.0, 60.0, 300.0, 70.0, "Some words about an opening and its ideas in general", "Body", 10.0))
        rows.append((page, 3, 50.0, 75.0, 300.0, 85.0, "1.e4 e5 2.Nf3 Nc6 3.Bb5 a6", "Bold", 10.1))
        rows.append((page, 4, 50.0, 90.0, 300.0, 100.0, "White - Black", "Body", 10.0))
        rows.append((page, 5, 50.0, 105.0, 300.0, 115.0, "a b c d e f g h", "Tiny", 6.0))
    return spark.createDataFrame(rows, LINES)


def test_roles_and_chapters(lines):
    roles = layout.font_roles(layout.font_profiles(lines))
    named = {r.font: r.role for r in roles.where("font <> 'Body' or role = 'body'").collect()}
    assert named == {"Body": "body", "Head": "heading", "Bold": "moves", "Tiny": "coord"}
    own = layout.line_roles(lines, roles, 20.0, 800.0)
    assert [r.role for r in own.where("page = 1").orderBy("line_no").collect()] == ["head", "heading", "text", "moves", "game_header", "coord"]
    assert [tuple(r) for r in layout.chapters(own, 4).orderBy("start").collect()] == [("Part 1", 1, 2), ("Part 3", 3, 4)]


def test_reading_order_goes_by_band_and_column(spark):
    rows = [(1, 0, 0.0, 0.0, 100.0, 10.0, "title"), (1, 1, 0.0, 20.0, 45.0, 30.0, "left 1"), (1, 2, 55.0, 20.0, 100.0, 30.0, "right 1"), (1, 3, 0.0, 35.0, 45.0, 45.0, "left 2"), (1, 4, 0.0, 60.0, 100.0, 70.0, "across"), (1, 5, 55.0, 80.0, 100.0, 90.0, "right 2"), (1, 6, 0.0, 80.0, 45.0, 90.0, "left 3")]
    df = spark.createDataFrame(rows, "page int, line_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = layout.reading_order(df, spark.createDataFrame([(1, 50.0)], "page int, x double"), 10.0).orderBy("place").collect()
    assert [r.text for r in got] == ["title", "left 1", "left 2", "right 1", "across", "left 3", "right 2"]


def test_each_label_is_used_once(spark):
    box = "page int, id string, x0 double, y0 double, x1 double, y1 double"
    pictures = spark.createDataFrame([(1, "p1", 0.0, 50.0, 40.0, 90.0), (1, "p2", 60.0, 50.0, 100.0, 90.0)], box)
    labels = spark.createDataFrame([(1, "l1", 0.0, 35.0, 20.0, 45.0), (1, "l2", 60.0, 95.0, 80.0, 105.0), (1, "l3", 0.0, 120.0, 20.0, 130.0)], box)
    assert sorted(map(tuple, layout.labelled(pictures, labels).collect())) == [("p1", "l1", 5.0), ("p2", "l2", 95.0)]


def test_small_predicates(spark):
    r = spark.range(1).select(
        layout.cue(F.lit("Black threatens")).alias("a"), layout.cue(F.lit("good, or ")).alias("b"), layout.cue(F.lit("plain")).alias("c"), layout.side_to_move(F.lit("Black to move and win")).alias("d"),
        layout.word_shape(F.lit("Nf3")).alias("e"), layout.word_shape(F.lit("tLlf3")).alias("f"), layout.word_shape(F.lit("board")).alias("g"), layout.unglued(F.lit("atCHESSthe CHESS"), "CHESS").alias("h"),
    ).first()
    assert tuple(r) == ("threat", "alternative", None, "b", "strong", "weak", "none", "atthe CHESS")


def test_fit_and_reached(spark):
    c = spark.createDataFrame([(1, 0, 0.5, False), (1, 1, 0.1, False), (2, 0, 0.1, False), (2, 1, 0.0, True), (2, 2, 0.0, False), (2, 3, 0.0, False), (2, 4, 0.0, False), (3, 0, 4.5, True)], "run int, pos int, cost double, failed boolean")
    assert sorted((r.run, r.fit) for r in layout.run_fit(c, "run", "cost", "failed").collect()) == [(1, 0), (2, 1), (3, 2)]
    n, d = spark.createDataFrame([(1, "8/8/8/8/8/8/8/K6k w - - 0 1")], "id int, fen string"), spark.createDataFrame([("d", "8/8/8/8/8/8/8/K6k")], "id string, placement string")
    assert layout.reached(n, d).first().diagram == "d"
    assert layout.hidden_removed(n.withColumn("_x", F.lit(1))).columns == ["id", "fen"]
    assert layout.overlapping(spark.createDataFrame([(1, 5), (6, 9), (10, 12)], "a int, b int"), "a", "b", 5, 9).count() == 2


def test_words_are_not_dealt_out_by_their_font(spark):
    """Nearly all words of a book are in one font: a join that deals them out by it puts them in one task."""
    words = spark.createDataFrame([(1, k, "w", "M" if k % 9 else "B") for k in range(90)], "line int, word_no int, text string, font string")
    roles = words.select("font").distinct().select("font", F.when(F.col("font") == "M", "moves").otherwise("body").alias("role"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = layout.word_classes(words, roles)
        plan = known._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "hashpartitioning(font" not in plan and "BroadcastHashJoin" in plan
    assert {(r.font, r.main) for r in known.collect()} == {("M", True), ("B", False)}


@pytest.mark.parametrize("most", [20_000, 0])
def test_lines_are_not_dealt_out_by_their_font(spark, monkeypatch, most):
    """While fonts are few, lines find their role where they are; beyond that Spark joins them, with the same roles."""
    monkeypatch.setattr(layout, "FONTS", most)
    lines = spark.createDataFrame([(1, k, 0.0, 100.0 + k, 50.0, 108.0 + k, "some words", "H" if k % 9 == 0 else "B", 10.0) for k in range(30)], "page int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, font string, size double")
    roles = layout.font_profiles(lines).select("font", "size", F.when(F.col("font") == "H", "heading").otherwise("body").alias("role"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = layout.line_roles(lines, roles, 10.0, 2400.0)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r.line_no, r.role) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert ("hashpartitioning(font" in plan) == (most == 0)
    assert got == {(k, "heading" if k % 9 == 0 else "text") for k in range(30)}
