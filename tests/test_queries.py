"""Every query of the engine against DuckDB on the smallest tables."""

import os

import pytest

from docloom.plans.oracles import ORACLES
from docloom.plans.queries import QUERIES

from compare import assert_equal


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_duckdb(spark, small, name):
    assert_equal(QUERIES[name](spark, small), ORACLES[name], small)


def test_queries_without_sql_run(spark, small):
    for name in QUERIES.keys() - ORACLES.keys():
        QUERIES[name](spark, small).count()


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 8


def test_scan_holds_a_portion_of_files_at_once(spark, small, monkeypatch):
    from docloom.plans import queries
    from docloom.sources import markdown

    seen, read = [], markdown.read_folder

    def watched(session, root, **how):
        seen.append(sum(len(files) for _, _, files in os.walk(root)))
        return read(session, root, **how)

    monkeypatch.setattr(queries, "PORTION", 60, raising=False)
    monkeypatch.setattr(queries.markdown, "read_folder", watched)
    n = queries.catalog(spark, small).count()
    assert_equal(QUERIES["scan_bundle"](spark, small), ORACLES["scan_bundle"], small)
    assert sum(seen) == n and max(seen) < n / 2
