"""Page operators read every page; inline rows are fixtures here."""

from pyspark.sql import functions as F

from quirefold.functions import text
from quirefold.plans import registry
from quirefold.session import table

SF = "/root/testdata/sf0.001"
TYPO = [(1, '<p title="a...b">wait... no -- yes</p>'), (2, "<p>a--b</p><p>c....</p>"), (3, "<p>http://x--y <!-- c --></p>")]


def test_every_page(spark):
    pages = table(spark, SF, "pages")
    for name in ("typography", "repaired_pages"):
        assert registry.QUERIES[name](spark, SF).select("page_id").exceptAll(pages.select("page_id")).count() == 0
        assert registry.QUERIES[name](spark, SF).count() == pages.count()
    hrefs = pages.select(F.sum(F.size(F.split("html", 'href="', -1)) - 1)).first()[0]
    assert registry.QUERIES["page_href_parts"](spark, SF).count() == hrefs > 0


def test_typography(spark):
    got = dict(spark.createDataFrame(TYPO, "id int, html string").select("id", text.typography(F.col("html"))).collect())
    assert 'title="a...b"' in got[1] and "<!-- c -->" in got[3]
    assert "wait\u2026" in got[1]
