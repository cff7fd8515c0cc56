"""Report tables: projection, grouping by category in a given order, views, and lookups of details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.rules import CATEGORY_ORDER, UNCLASSIFIED
from tidewire.functions.text import cve_ids, hue, summary_html
from tidewire.scratch import Scratch
from tidewire.sources.write import write_packed

DETAIL_COLUMNS = ("full_body", "summary", "ai_summary", "scoring_matched")


def optional(df: DataFrame, name: str, kind: str = "string"):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def report_items(items: DataFrame) -> DataFrame:
    """The 16 columns of a report, with ord. A translated summary is used if it has at least half the length."""
    text = lambda c: F.coalesce(optional(items, c), F.lit(""))
    filled = lambda c: F.when(text(c) != "", text(c))
    summary_zh = F.when(F.length(text("summary_zh")) >= F.length(text("summary")) * 0.5, filled("summary_zh"))
    return items.select(
        "ord",
        F.coalesce(filled("title_zh"), text("title")).alias("title"),
        F.coalesce(summary_zh, text("summary")).alias("summary"),
        F.coalesce(filled("ai_summary_zh"), text("ai_summary")).alias("ai_summary"),
        text("url").alias("url"),
        text("source_name").alias("source_name"),
        F.left(text("published_date"), F.lit(10)).alias("published_date"),
        text("content_type").alias("content_type"),
        text("source_type").alias("source_type"),
        F.coalesce(optional(items, "category"), F.lit(UNCLASSIFIED)).alias("category"),
        F.coalesce(optional(items, "merged_sources", "array<string>"), F.array().cast("array<string>")).alias("merged_sources"),
        optional(items, "fulltext_fetched", "boolean").alias("fulltext_fetched"),
        (F.col("scoring_matched") if "scoring_matched" in items.columns else F.lit(None).cast("struct<strong:array<string>,medium:array<string>,weak:array<string>>")).alias("scoring_matched"),
        hue(F.col("source_name")).alias("source_hue"),
        text("filter_decision").alias("filter_decision"),
        F.coalesce(optional(items, "confidence_score", "int"), F.lit(0)).alias("confidence_score"),
        text("full_body").alias("full_body"),
    )


def category_dimension(spark, order=CATEGORY_ORDER) -> DataFrame:
    rows = [(c, i) for i, c in enumerate([*order, UNCLASSIFIED] if UNCLASSIFIED not in order else order)]
    return spark.createDataFrame(rows, "category string, place int")


def group_by_category(items: DataFrame, order=CATEGORY_ORDER) -> DataFrame:
    """cat_idx (among groups with items), category, n, in the given order; items of unknown categories count as unclassified."""
    dim = category_dimension(items.sparkSession, order)
    known = items.join(F.broadcast(dim), "category", "left")
    unknown = (len(order) if UNCLASSIFIED not in order else list(order).index(UNCLASSIFIED))
    grouped = known.groupBy(F.coalesce("place", F.lit(unknown)).alias("place")).agg(F.count("*").alias("n"))
    named = grouped.join(dim, "place")
    index = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("place")) - 1  # a row for each category
    return named.select(index.alias("cat_idx"), "category", "n")


def split_decisions(items: DataFrame) -> DataFrame:
    """is_review of every item: all that isn't for review counts as accepted."""
    return items.withColumn("is_review", F.coalesce("filter_decision", F.lit("")) == "review")


def category_view(items: DataFrame, category: str | None = None, review: bool = False) -> DataFrame:
    """The items a reader sees: for review, of one category (with or without its number prefix), or all that aren't for review."""
    marked = split_decisions(items)
    if review:
        return marked.where("is_review").drop("is_review")
    rows = marked.where("not is_review").drop("is_review")
    bare = lambda c: F.regexp_replace(c, r"^[①-⑥]\s*", "")
    return rows if category is None else rows.where((F.col("category") == category) | (bare(F.col("category")) == bare(F.lit(category))))


def list_rows(report: DataFrame) -> DataFrame:
    """A report without its detail columns."""
    return report.drop(*DETAIL_COLUMNS)


def readable(report: DataFrame) -> DataFrame:
    """A report with summary_html, and cves: the distinct vulnerability numbers of its summaries, in capitals and in order of first mention."""
    return report.withColumns({"summary_html": summary_html(F.col("summary")), "cves": F.array_distinct(F.transform(cve_ids(F.coalesce("summary", F.lit(""))), F.upper))})


def details(report: DataFrame) -> DataFrame:
    """category, url and the detail columns: the last item of each url in its category."""
    last = report.where("url != ''").groupBy("category", "url").agg(F.max_by(F.struct(*DETAIL_COLUMNS), "ord").alias("d"))
    return last.select("category", "url", "d.*")


def with_details(rows: DataFrame, detail: DataFrame) -> DataFrame:
    return rows.join(detail, ["category", "url"], "left")


def upsert_keywords(existing: DataFrame, texts: DataFrame) -> DataFrame:
    """The new list of keyword texts, by text: a text known in any case keeps its metadata, blanks go.

    existing: text, categories, ord; of entries that differ in case the last one counts. texts: text, ord.
    """
    known = existing.groupBy(F.lower("text").alias("k")).agg(F.max_by("categories", "ord").alias("categories"))
    new = texts.select(F.trim("text").alias("text"), "ord").where("text != ''")
    out = new.join(known, F.lower("text") == F.col("k"), "left")
    return out.select("text", F.coalesce("categories", F.array().cast("array<string>")).alias("categories")).orderBy("text")


def with_category_index(report: DataFrame, order=CATEGORY_ORDER) -> DataFrame:
    """is_review of every item, and cat_idx: its category's place among the categories of accepted items; null for review."""
    marked = split_decisions(report)
    places = group_by_category(marked.where("not is_review"), order).select("cat_idx", F.col("category").alias("_named"))
    bare = F.when(F.col("category").isin([*order]), F.col("category")).otherwise(UNCLASSIFIED)
    joined = marked.join(F.broadcast(places), ~F.col("is_review") & (bare == F.col("_named")), "left")  # a row for each category
    return joined.drop("_named")


def write_weekly(report: DataFrame, path: str, order=CATEGORY_ORDER) -> None:
    """The report by decision and category's index, a folder each, compressed where that is smaller; the files there before stay until all are written."""
    write_packed(with_category_index(report, order), path, ("is_review", "cat_idx"))


def preview(report: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` items by ord."""
    return report.orderBy("ord").limit(n)


def append_history(stats: DataFrame, path: str) -> None:
    """A day's statistics; a second run of a day replaces the first."""
    stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def numbered_by(rows: DataFrame, key: str) -> DataFrame:
    """Adds place: the rows' numbers from 1 by ``key`` over the whole table. Ranges of the key are sorted and numbered by
    themselves, and each begins where those before it end (a number for each range), so no task sees all rows. Equal keys: in any order."""
    scratch = Scratch(rows.sparkSession, "places")
    cut, _ = scratch.save(rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    here = cut.withColumn("_at", F.row_number().over(W.partitionBy("_range").orderBy(key)))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_start"))  # a row for each range
    return here.join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("_at") + F.col("_start")).alias("place"))
