"""One entry from fetched bodies to the report: each step's rows are written, and read as the next one's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.rules import SAMPLE, Rules
from tidewire.operators import dedup, extract, report, scoring, summary
from tidewire.scratch import Scratch
from tidewire.sources import parse
from tidewire.sources.settings import Settings

Step = tuple[str, Callable[[DataFrame], DataFrame]]


def numbered(items: DataFrame) -> DataFrame:
    """ord by the bodies' and their entries' order. An item's ord is 2^32 times its body's, plus its place there, which is an int: no sort, no clash."""
    return items.withColumn("ord", F.col("ord") * (1 << 32) + F.col("pos")).drop("pos")


def merged(items: DataFrame, similarity: float = Settings.similarity) -> DataFrame:
    firsts = dedup.drop_url_duplicates(items)
    return dedup.merge_clusters(firsts, dedup.cluster_titles(firsts, similarity))


def steps(pages: DataFrame, now: Column, rules: Rules = SAMPLE, translate=summary.identity, settings: Settings = Settings()) -> list[Step]:
    """What follows parsing. pages: url, html. Rows of unreadable bodies go with the first step, after they were written."""
    def stage1(items: DataFrame) -> DataFrame:
        return scoring.quick_score(items, rules).where("not stage1_drop").drop("stage1_score", "stage1_drop")

    def stage2(items: DataFrame) -> DataFrame:
        rows = scoring.score(items, rules).where("filter_decision != 'filtered'")
        return rows.select(*items.columns, "confidence_score", "filter_decision", "category", "content_type", "scoring_matched")

    return [
        ("expiry", lambda items: dedup.filter_by_date(items.where("not parse_error"), now, settings.max_days)), ("duplicates", lambda items: merged(items, settings.similarity)), ("prefilter", stage1),
        ("fulltext", lambda items: extract.add_fulltext(items, pages)), ("score", stage2), ("summaries", lambda items: summary.choose_summary(items, translate)),
        ("translation", lambda items: summary.translate_items(items, translate)),
    ]


def run(raw: DataFrame, following: list[Step], at: Column, keep: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The report's table, and what failed: step and error.

    Parsing and the report must succeed. A step that fails is passed over: its input goes on. A step's rows are
    kept until the next step's are written; in the folder ``keep``, if one is named, they stay as JSON lines, by step.
    """
    scratch, failed = Scratch(raw.sparkSession, "weekly"), {}

    def stay(rows: DataFrame, name: str) -> None:
        if keep:
            rows.write.mode("overwrite").option("compression", "gzip").json(f"{keep.rstrip('/')}/{name}")

    rows, path = scratch.save(numbered(parse.parse_with_errors(raw, at)))
    stay(rows, "parsed")
    for name, step in following:
        try:
            new, written = scratch.save(step(rows))
        except Exception as e:  # noqa: BLE001  a failed step is reported, the rest goes on
            failed[name] = f"{type(e).__name__}: {e}"
            continue
        scratch.drop(path)
        rows, path = new, written
        stay(rows, name)
    return report.report_items(rows), failed
