"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from tessera.plans.catalog import CASES, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    compare(QUERIES[name](spark, SF), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(CASES))
def test_stated_cases(spark, duck, name):
    make, sql = CASES[name]
    compare(make(spark, SF), duck.execute(sql))


def compare(df, rel):
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted([plain(r[c]) for c in order] for r in df.collect())
    theirs = sorted([plain(r[columns.index(c)]) for c in order] for r in rel.fetchall())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["token_runs", "text_tokens", "leader_clusters", "text_diagrams"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_texts_are_stripped(spark, tmp_path):
    """Both ends of texts longer than twenty characters."""
    import hashlib

    text = " " * 30 + "a word" + "x" * 40 + "\u00a0\r\n "
    spark.createDataFrame([(1, text, 5, "s")], "doc_id long, text string, n_chars long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["scalar_words"](spark, str(tmp_path)).first().stripped_sha256 == hashlib.sha256(text.strip().encode()).hexdigest()
