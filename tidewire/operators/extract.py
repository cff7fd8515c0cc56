"""Main text of pages, scraped article lists, and joining pages to items."""

from __future__ import annotations

import html as html_lib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewire.functions import dom
from tidewire.functions.slices import by_slices
from tidewire.functions.text import clean_noise_lines, decode_entities, fallback_text, strip

ITEM = "struct<title:string,url:string,summary:string,published_date:string>"
MIN_ARTICLE, MAX_ARTICLE = 200, 20_000
SHORT_SUMMARY = 300
#: Rules, of some hundred bytes each, that are sent to every executor.
MANY_SOURCES = 100_000


@F.arrow_udf(StringType())
def main_text(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Text of the main content without boilerplate elements; null if none is found or the page can't be parsed."""

    def one(html: str | None) -> str | None:
        if html is None:
            return None
        try:
            top = dom.parse(html)
            dom.prune(top)
            return dom.main_content(top)
        except (ValueError, AssertionError, RecursionError):
            return None

    return by_slices(pages, lambda part: [one(html) for html in part.to_pylist()], pa.string())


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All named and numeric entities decoded."""
    return texts.map(lambda t: None if t is None else html_lib.unescape(t)).astype(object)


def page_text(html: Column) -> Column:
    """Main content, else the regular-expression fallback; blanks collapsed, noise lines dropped."""
    text = F.coalesce(main_text(html), fallback_text(F.coalesce(html, F.lit(""))))
    text = F.regexp_replace(F.regexp_replace(decode_entities(text), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return clean_noise_lines(text)


def articles(pages: DataFrame, rules: dict, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos and the fields of every article of a page by the rules' CSS selectors."""

    @F.pandas_udf(f"array<{ITEM}>")
    def scraped(batch: pd.Series) -> pd.Series:
        return pd.Series([dom.scrape(h or "", rules) for h in batch], dtype=object)

    return pages.select(key, F.posexplode(scraped(html)).alias("pos", "item")).select(key, "pos", "item.*")


@F.udtf(returnType="pos int, title string, url string, summary string, published_date string", useArrow=False)
class ScrapedArticles:
    """The articles of a page by the rules of its row. Rules are compiled once in each task, however many sources share it."""

    def __init__(self) -> None:
        self.known: dict = {}

    def eval(self, html, rules):  # noqa: A003
        if html is None or rules is None:
            return
        if (scraper := self.known.get(rules)) is None:
            scraper = self.known[rules] = dom.Scraper(rules.asDict())
        for pos, a in enumerate(scraper.read(html)):
            yield pos, a["title"], a["url"], a["summary"], a["published_date"]


def articles_by_source(pages: DataFrame, catalogue: DataFrame, *keep: str) -> DataFrame:
    """source_name, the pages' columns ``keep``, pos and the fields of every article, by the rules of each page's source.

    pages: source_name, html and ``keep``. catalogue: name, scraper_config (a struct of selectors; its null fields take the defaults), once for each name.
    A page of a source that is null, unknown or without rules, or with no article, gives no row. The rules are a row for each source: they are
    sent out if they were counted as few, so that pages, of which one source may have most, are scraped where they lie.
    """
    rules = catalogue.where("name is not null and scraper_config is not null").select(F.col("name").alias("_of"), F.col("scraper_config").alias("_rules"))
    if rules.limit(MANY_SOURCES + 1).count() <= MANY_SOURCES:
        rules = F.broadcast(rules)
    rows = pages.select("source_name", *keep, F.col("html").alias("_html")).join(rules, F.col("source_name") == F.col("_of"))
    return rows.lateralJoin(ScrapedArticles(F.col("_html").outer(), F.col("_rules").outer())).drop("_html", "_of", "_rules")


def wants_fulltext(items: DataFrame) -> Column:
    body = F.coalesce("full_body", F.lit("")) if "full_body" in items.columns else F.lit("")
    return (F.length(F.coalesce("summary", F.lit(""))) < SHORT_SUMMARY) & F.startswith(F.coalesce("url", F.lit("")), F.lit("http")) & (body == "")


def add_fulltext(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with a short summary get their page's text: original_summary, summary, fulltext_fetched (null: not wanted).

    pages: url, html. A text under 200 characters counts as not fetched; longer ones end at 20 000. Pages are
    extracted once each, only those that a wanting item names.
    """
    marked = items.withColumn("_wants", wants_fulltext(items))
    wanted = marked.where("_wants").select("url").distinct()
    text = strip(page_text(F.col("html")))
    fetched = pages.join(wanted, "url", "left_semi").select("url", F.left(text, F.lit(MAX_ARTICLE)).alias("_text")).where(F.length("_text") >= MIN_ARTICLE)
    out = marked.join(fetched, "url", "left")
    got = F.col("_wants") & F.col("_text").isNotNull()
    return out.withColumns(
        {"original_summary": F.when(got, F.col("summary")), "fulltext_fetched": F.when(F.col("_wants"), got), "summary": F.when(got, F.col("_text")).otherwise(F.col("summary"))}
    ).drop("_wants", "_text")


