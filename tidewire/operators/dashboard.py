"""Counts, histograms and drift of scored items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 11


def decision_counts(scored: DataFrame) -> DataFrame:
    of = lambda d: F.count_if(F.col("filter_decision") == d)
    return scored.agg(F.count("*").alias("total_input"), of("accepted").alias("total_accepted"), of("review").alias("total_review"), of("filtered").alias("total_discarded"))


def score_histogram(scored: DataFrame) -> DataFrame:
    """bucket 0..10 and n, for accepted and discarded items; a row also for an empty bucket."""
    base = scored.where("filter_decision != 'review'")
    counts = base.groupBy(F.least(F.floor(F.col("confidence_score") / 10), F.lit(BUCKETS - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    every = scored.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def category_distribution(scored: DataFrame) -> DataFrame:
    """Items kept by category, most first, then in order of appearance."""
    kept = scored.where("filter_decision in ('accepted', 'review')")
    counts = kept.groupBy("category").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    return counts.orderBy(F.desc("n"), "first_ord")


def ordered_kept(scored: DataFrame) -> DataFrame:
    """Accepted items, then those to review, each in order; the rest goes.

    Sorting samples its input first: the kept rows are exchanged before it, so that they aren't scored once more for the sample.
    """
    place = F.when(F.col("filter_decision") == "accepted", 0).otherwise(1)
    return scored.where("filter_decision in ('accepted', 'review')").withColumn("kept_rank", place).repartition("ord").orderBy("kept_rank", "ord")


def daily_stats(scored: DataFrame) -> DataFrame:
    """A row for each day: counts by decision and the histogram as an array."""
    bucket = F.least(F.floor(F.col("confidence_score") / 10), F.lit(BUCKETS - 1))
    counted = [F.count_if((F.col("filter_decision") != "review") & (bucket == b)) for b in range(BUCKETS)]
    of = lambda d: F.count_if(F.col("filter_decision") == d)
    return scored.groupBy("day").agg(
        F.count("*").alias("total_input"), of("accepted").alias("total_accepted"), of("review").alias("total_review"), of("filtered").alias("total_discarded"),
        F.array(*counted).alias("score_buckets"),
    )


def drift(stats: DataFrame, share_points: float = 5.0, bucket_rows: int = 5) -> DataFrame:
    """Each day against the latest day before it: change of the accepted share (in points) and of buckets.

    Shares are over accepted and discarded items. A window over days: one row a day.
    """
    by_day = W.partitionBy(F.lit(0)).orderBy("day")
    base = F.col("total_accepted") + F.col("total_discarded")
    share = F.when(base > 0, F.col("total_accepted") * 100.0 / base).otherwise(0.0)
    out = stats.withColumn("share", share)
    out = out.withColumns({"prev_day": F.lag("day").over(by_day), "prev_share": F.lag("share").over(by_day), "prev_buckets": F.lag("score_buckets").over(by_day)})
    change = F.col("share") - F.col("prev_share")
    diffs = F.zip_with("score_buckets", "prev_buckets", lambda a, b: a - b)
    moved = F.filter(F.transform(diffs, lambda d, i: F.when(F.abs(d) >= bucket_rows, i)), lambda i: i.isNotNull())
    return out.where("prev_day is not null").select(
        "day", "prev_day", F.round("share", 6).alias("share"), F.round(change, 6).alias("share_change"), (F.abs(change) >= share_points).alias("share_flag"), F.array_join(moved.cast("array<string>"), ",").alias("moved_buckets")
    )


def fetch_counts(statuses: DataFrame) -> DataFrame:
    """Sources fetched, failed and skipped as disabled, of the last status of each."""
    of = lambda s: F.count_if(F.col("status") == s)
    return statuses.agg(of("success").alias("n_success"), of("error").alias("n_error"), of("auto_disabled").alias("n_disabled"))
