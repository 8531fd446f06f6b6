"""Titles as they are written, held against the query's SQL."""

import duckdb

from siltstone import plans


def test_title_with_open_and_other_references(spark, tmp_path):
    titles = ["<title>a &amp;&amp b</title>", "<title>x &quot;1&quot;</title>", "<title>\xa0 </title>", "<title> &amp;\t</title><title>two</title>", "<title>&amp", "", None, "<title>a\nb 　</title>", "<TITLE>no</TITLE>"]
    spark.createDataFrame([(i, f"https://a.example/{i}", t) for i, t in enumerate(titles)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(c.sql(plans.ORACLE_SQL["page_title"]).fetchall())
    assert sorted(map(tuple, plans.QUERIES["page_title"](spark, str(tmp_path)).collect())) == want
    assert len(want) == len(titles)
