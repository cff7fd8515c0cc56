"""Every query against its SQL on the smallest tables; those without SQL must run."""

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from tidewire.operators import extract
from tidewire.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, spark, sf):
    assert_same(catalog.queries()[name], catalog.oracle_sql()[name], spark, sf)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(name, spark, sf):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_feed_bodies_and_fulltext_take_whole_texts(spark, sf):
    sizes = catalog.items(spark, sf).select("ord", F.length("summary").alias("n"))
    bodies = catalog.feed_bodies(spark, sf).select("ord", F.length("xml_text").alias("size")).join(sizes, "ord")
    assert bodies.where("n > 300").count() > 0 and bodies.where("size < n").count() == 0
    long = catalog.fulltext_join(spark, sf).join(sizes, "ord").where("n >= 300")
    assert long.count() > 0 and long.where("fulltext_fetched is not null or n_chars <> n").count() == 0


def test_short_summary_gets_the_page(spark):
    items = spark.createDataFrame([(1, "http://a/1", "short"), (2, "http://a/1", "x" * 300)], "ord int, url string, summary string")
    pages = spark.createDataFrame([("http://a/1", "<article><p>" + "Words of the page. " * 30 + "</p></article>")], "url string, html string")
    got = {r.ord: (r.fulltext_fetched, len(r.summary) >= 200) for r in extract.add_fulltext(items, pages).collect()}
    assert got == {1: (True, True), 2: (None, True)}
