"""Articles of pages by their source's own rules."""

import html

import duckdb

from tidewire.functions import dom
from tidewire.operators import extract
from tidewire.plans import catalog
from tidewire.sources.schemas import SOURCES

RULES = SOURCES[SOURCES.index("scraper_config") :]
LIST = '<ul><li class=it><a href="/a">First one</a><span class=d>2024</span></li><li class=it><a href="b">abc</a></li><li class=it><a href="http://x/c">Third one</a><p>Text</p></li></ul>'
BLOG = '<article><h2><a href="/p">Post title</a></h2><p>Short.</p><time datetime="2024-01-02">Jan</time></article><article><h3><a>Other post</a></h3><div><p></p><p>A paragraph of more than twenty.</p></div></article>'
CARD = '<a href="/card"><div class=card><b>Card title</b></div></a>'


def test_sources_have_rules_of_their_own(spark):
    shop = (".it", "a", None, ".d", None, "http://shop.org/")
    card = (".card", "b", None, None, None, "http://cards.org")
    catalogue = spark.createDataFrame([("shop", shop), ("blog", (None,) * 6), ("card", card), ("bare", None), (None, shop)], f"name string, {RULES}")
    pages = [("shop", 1, LIST), ("blog", 2, BLOG), ("shop", 3, BLOG), ("card", 4, CARD), ("bare", 5, BLOG), ("strange", 6, BLOG), (None, 7, LIST), ("shop", 8, None), ("blog", 9, ""), ("blog", 10, BLOG)]
    want = {
        ("shop", 1, 0, "First one", "http://shop.org/a", "", "2024"), ("shop", 1, 1, "Third one", "http://x/c", "Text", ""), ("card", 4, 0, "Card title", "http://cards.org/card", "", ""),
        *(row for k in (2, 10) for row in (("blog", k, 0, "Post title", "/p", "Short.", "2024-01-02"), ("blog", k, 1, "Other post", "", "A paragraph of more than twenty.", ""))),
    }
    df = spark.createDataFrame(pages, "source_name string, id int, html string")
    for few in (extract.MANY_SOURCES, 0):
        extract.MANY_SOURCES, kept = few, extract.MANY_SOURCES
        try:
            got = [tuple(r) for r in extract.articles_by_source(df, catalogue, "id").collect()]
        finally:
            extract.MANY_SOURCES = kept
        assert len(got) == len(want) and set(got) == want
    assert extract.articles_by_source(df.limit(0), catalogue).count() == extract.articles_by_source(df, catalogue.limit(0)).count() == 0


def test_pages_of_one_source_are_not_brought_together(spark):
    catalogue = spark.createDataFrame([("blog", (None,) * 6)], f"name string, {RULES}")
    pages = spark.range(100, numPartitions=4).selectExpr("'blog' as source_name", "id", f"'{BLOG}' as html")
    out = extract.articles_by_source(pages, catalogue, "id")
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 200


def test_empty_selectors():
    assert dom.scrape(BLOG, {"article_selector": ""})[0]["title"] == "Post title" and len(dom.scrape(BLOG, {"article_selector": ""})) == 1
    assert dom.scrape(BLOG, {"title_selector": ""}) == []
    assert [a["summary"] for a in dom.scrape(BLOG, {"summary_selector": ""})] == ["", "A paragraph of more than twenty."]


def test_sql_of_scraping_decodes_references_that_a_cut_title_ends_with():
    whole = html.escape("""a < b > c & d "e" 'f' &lt; &amp""")
    texts = [whole[:k] for k in range(len(whole) + 1)] + ["&ampx &amp;lt; &amplt; &#x27 &quo &", "&&amp&#x27;&quot"]
    told = duckdb.execute(f"SELECT {catalog.references_sql('t')} FROM (SELECT unnest(?) AS t, unnest(range(?)) AS k) ORDER BY k", [texts, len(texts)]).fetchall()
    read = [dom.scrape(f"<head><title>some {t}</title></head>", {"article_selector": "head", "title_selector": "title"})[0]["title"] for t in texts]
    assert [f"some {t}".strip() for (t,) in told] == read
