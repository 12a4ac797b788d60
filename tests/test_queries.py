"""Every registered query of the library runs, and agrees with its SQL where it has one."""

import os
import re

import duckdb
import pytest

import compare
from jobgrain.plans import catalogue, registry  # noqa: F401

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in compare.TABLES:
        at = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, db, name):
    got = compare.normal(QUERIES[name](spark, sf).toPandas())
    if name not in SQL:
        assert len(got)
        return
    want = compare.normal(db.execute(SQL[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)


@pytest.mark.parametrize("name", ["title_filter", "quality_filter", "parse_postings", "fold_status", "insert_new", "unnotified_matches", "match_existing_fuzzy"])
def test_plans_stay_in_the_engine(spark, sf, capsys, name):
    QUERIES[name](spark, sf).explain()
    plan = capsys.readouterr().out
    assert not re.search("BatchEvalPython|ArrowEvalPython|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_entry(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).collect()[0]
    assert row.adds_up and row.total == row.n_new + row.n_dup_cross + row.n_dup_store + row.n_low_quality + row.n_dup_hash
    assert set(entry.oracle_sql()) <= set(entry.queries())
