"""Every registered query against its SQL twin."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, SF_DIR).count() > 0
    else:
        assert compare(spark, con, SF_DIR, queries()[name], sql) >= 0


def test_entry(spark):
    assert entry(spark).count() == 50


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_payloads_grow_with_the_entries(spark, con):
    """One pair of messages for each source and run of ids, not one for each source at any size."""
    from feedspark.plans import views as v

    feeds = v.paged(v.entries(spark, SF_DIR)).select("feed_id").distinct().count()
    bodies = queries()["sink_payloads"](spark, SF_DIR)
    assert bodies.count() == 2 * feeds and bodies.filter("feed_id LIKE '%/%'").count() == 2 * feeds
