"""The stages in order, each on what the one before kept, against the operators' own brute-force rules."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tessera.llm import oracles, queries, quality

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "pieces"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    docs, out = queries.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out.append(docs)
    return out


def test_each_stage_against_brute_force(spark, steps):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    from test_llm_operators import brute_alike, brute_hits

    first = queries.table(spark, SF, "documents")
    rated, lined, single, clean, last = steps
    assert all(s.columns == first.columns for s in steps[:4])
    keep = {r.doc_id for r in quality.rated(first, queries.table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in rated.collect()} == keep
    assert {r.doc_id for r in lined.collect()} == keep
    gone = {i for i, c in brute_alike([(r.doc_id, r.text) for r in lined.collect()]) if i != c}
    assert {r.doc_id for r in single.collect()} == keep - gone
    bench = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    dirty = {r[0] for r in brute_hits([(r.doc_id, r.text) for r in single.collect()], bench) if r[5]}
    assert not [r for r in brute_hits([(r.doc_id, r.text) for r in clean.collect()], bench) if r[5]]
    texts = {r.doc_id: r.text for r in single.collect()}
    assert {r.doc_id for r in clean.collect() if r.text != texts[r.doc_id]} == dirty
    assert last.where("parity and round_trip").count() == clean.count()


def test_run_gives_the_last_stage(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[-1].collect()))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    rel = con.execute(oracles.ORACLES[name])
    columns = [c[0] for c in rel.description]
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, rel.fetchall()))


def test_each_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_handle_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and clashing columns go through all stages: what each may drop is gone, all else and all other columns stay."""
    long = " ".join(f"w{k}" for k in range(5000))
    rows = [(1, "plain words of one document here", "x"), (1, "plain words of one document here", "x"), (2, None, None), (3, "", "e"), (None, "words without any id at all", "n"), (4, long, "l"), (5, long + " more", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string").withColumns({c: F.lit(c) for c in ("_0", "rank", "th", "cleaned", "lang")})
    names, odd = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, odd, SF).write.parquet(f"{tmp_path}/{name}")
        odd = spark.read.parquet(f"{tmp_path}/{name}")
        assert odd.columns == names
        assert all(r["_0"] == "_0" and r["rank"] == "rank" and r["th"] == "th" for r in odd.collect())
    near = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.gone) for r in near), key=str) == sorted([(1, "x"), (2, None), (None, "n"), (4, "l")], key=str)
    last = corpus_pipeline.piece_stage(spark, docs, SF).collect()
    assert len(last) == len(rows)
    assert all(r.parity and r.round_trip for r in last)
    assert {len(r.pieces) for r in last if r.doc_id in (2, 3)} == {0}


def test_empty_tables_pass_through(spark, tmp_path):
    """All stages on an empty documents table."""
    for t in ("documents", "labels", "benchmark"):
        queries.table(spark, SF, t).where(F.lit(False)).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
