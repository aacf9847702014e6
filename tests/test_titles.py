"""Titles of odd pages against the queries' SQL."""

import duckdb
import pytest

from quirelens.queries import ORACLES, QUERIES

TITLES = [
    "plain", "cut at an escape &amp", "&lt", "&amp;lt; &lt;b&gt; &quot;&#39;&#x27;&apos;", "&copy;&eacute;&nbsp; &#233; &#38;", "&amp;amp;",
    "a&ampb", "two\nlines", "one\r\n# Two\u2028three", "\n", "", " ", "## marks", "Ünï_c-d 2",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("titles")
    pages = [(i, "u", f"<html><TITLE lang=x>{t}</title><body>&amp;") for i, t in enumerate(TITLES)] + [(90, "u", "no title"), (91, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{home}/pages.parquet")
    return str(home)


@pytest.mark.parametrize("name", ["entity_decode", "heading_slugs"])
def test_titles_match_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES[name](spark, folder).collect())
    want = sorted(con.execute(ORACLES[name]).fetchall())
    assert sorted(map(repr, got)) == sorted(map(repr, want))
