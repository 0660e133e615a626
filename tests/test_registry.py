import duckdb
import pytest

import __spark_entry__ as entry_point
from lexloom.registry import all_oracles, all_queries
from tests.oracle_check import canon, connect

QUICK = ["law_at_date", "bm25_boolean", "phrase", "citing_docs", "parse_refs", "citations", "merge_directory", "apply_changes", "enumerate_pages",
         "search_directory", "classification_tree", "retain_latest"]


def test_every_query_has_an_oracle():
    assert set(all_oracles()) == set(all_queries()) and len(all_queries()) > 100
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries()) >= set(all_queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_against_duckdb(spark, sf_dir, name):
    df = entry_point.queries()[name](spark, sf_dir)
    rel = connect(sf_dir).sql(entry_point.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(rel.fetchall(), rel.columns)


def test_driver_views(sf_dir):
    assert isinstance(connect(sf_dir), duckdb.DuckDBPyConnection)
