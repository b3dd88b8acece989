import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare
from folioscope.plans import queries as plans


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


#: Queries that SQL does not express, and the test that holds each against another way.
NO_SQL = {
    "vector_lsh": "test_functions", "chunk_pages": "test_functions", "rate_fold": "test_functions", "lis_chain": "test_functions", "sync_merge": "test_merge",
    "parse_body": "test_sources", "vec_decode_f16": "test_functions", "honorific_spell": "test_sources",
    "contents_run": "test_editing", "anchor_chain": "test_editing", "fuzzy_headings": "test_editing", "page_map": "test_editing",
}


def test_all_others_have_sql():
    assert set(plans.QUERIES) - set(plans.SQL) == set(NO_SQL)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, db, sf, name):
    assert compare(spark, db, name, sf).startswith("rows" if name in NO_SQL else "ok")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
