"""Every registered query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from sluice import queries as engine
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.database()


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_agrees_with_sql(spark, con, name):
    oracle.assert_same(spark, con, engine.QUERIES[name], engine.SQL[name])


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert engine.QUERIES[name](spark, oracle.DATA).count() > 0


def test_references_cut_short_agree_with_sql(spark, tmp_path):
    pages = ["<title>ver&amp</title><h1>ver&amp", "&am</p>&</p>&amp;&amp;&amp", "&copy 5 &copy; &notit; &ampamp; &amp;lt;", "&#65 &#65; &#x41 &#X41; &#00000065;", "none", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    oracle.assert_same(spark, con, engine.QUERIES["S13_html_unescape"], engine.SQL["S13_html_unescape"], str(tmp_path))


def test_entry_gives_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
