"""Every registered query of the library against its SQL on the small tables."""

import os

import pytest

from lectern.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    at = [list(want.columns).index(c) for c in columns]
    rows = sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= len(QUERIES)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["pricing_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan and "l_partkey" not in plan


def plan_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_once_a_row(spark, sf_dir):
    assert plan_of(spark, sf_dir, "length_histogram").count("regexp_extract_all") == 1


def test_pieces_meet_before_they_become_terms(spark, sf_dir):
    assert "keys=[raw#" in plan_of(spark, sf_dir, "lookup_terms")


def test_sentences_are_computed_once(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "segment_cuts")
    assert "written-" in plan and "documents.parquet" not in plan


def test_each_paragraph_is_split_once(spark, sf_dir):
    """One split for the paragraphs that may be cut and one for the text, not one for each length and start."""
    assert plan_of(spark, sf_dir, "length_excerpts").count("(?<=[.!?])") <= 2
