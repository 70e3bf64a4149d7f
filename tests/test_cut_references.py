"""Titles cut within a character reference, as the larger tables have them, against the SQL."""

import pytest

from quirefold.operators import edits
from quirefold.plans import registry
from tests.oracle import compare, tables

TITLES = ["Of the&amp;&amp;&amp", "Der&am", "For&a", "A &quot;b&quot; c&quo", "1 &middot; 2 &lt;x&gt;", "&amp;lt;", "", "12 - 3", "Plain"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cut")
    body = '<head><title>{0}</title><style>p{{margin:0}}</style><script>var t="</p>{0}";</script></head><body><nav><a href="/a">a</a></nav><h1>{0}</h1><p><b>{0}&amp;p; {0} and {0}p;</b><br><p>z</p></body>'
    rows = [(i, f"https://x/{i}", "<!DOCTYPE html><html>" + body.format(TITLES[i % len(TITLES)]) + "</html>") for i in range(8 * len(TITLES))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d)


def same(spark, sf, name):
    compare(spark, tables(sf), registry.QUERIES[name], registry.ORACLE[name], sf)


def test_paragraph_context(spark, sf):
    same(spark, sf, "paragraph_context")


def test_retitled_pages(spark, sf):
    same(spark, sf, "retitled_pages")
    assert edits.retitle("<title>x</title><p>for&amp; for&a", "for&a", "Z", raw=True) == ("<title>Z</title><p>Zmp; Z", 1, 2)
    assert edits.retitle("<title>x</title><p>for&amp; for&a", "for&a", "Z") == ("<title>Z</title><p>for&amp; Z", 1, 1)


def test_sitemap_urls(spark, sf):
    same(spark, sf, "sitemap_urls")


def test_toc_rebuilt(spark, sf):
    same(spark, sf, "toc_rebuilt")


def test_toc_titles(spark, sf):
    same(spark, sf, "toc_titles")
