"""Health of sources: run lengths of failures, counters, automatic disabling and alerts.

All state is a fold over a source's fetches in order. As failures since the last success, counts and last times
are what matters, most of it is an aggregation; only the running form needs order, and gets it from a distributed prefix scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.rules import OTHER_GROUP, REASONS, SEVERITY, SEVERITY_ORDER
from tidewire.scratch import Scratch, sized

DISABLE_AT = 5


def running_health(fetches: DataFrame) -> DataFrame:
    """After each fetch: consecutive failures, totals, last success and error. fetches: name, ts, seq, failed.

    A prefix scan: the log is cut into ranges of (name, ts, seq), so a source with most of the rows has many of them; each range is scanned by
    itself, its last row is the range's fold, the folds (a row for each range and source) are scanned, and what came before a range is added to its rows.
    """
    scratch = Scratch(fetches.sparkSession, "health")
    failed, succeeded = F.when(F.col("failed"), 1).otherwise(0), F.when(~F.col("failed"), 1).otherwise(0)
    cut, first = scratch.save(fetches.repartitionByRange("name", "ts", "seq").withColumn("_range", F.spark_partition_id()))
    order = W.partitionBy("_range", "name").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    run = W.partitionBy("_range", "name", "_island").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    here = cut.withColumn("_island", F.sum(succeeded).over(order)).select(
        *fetches.columns, "_range",
        F.struct(
            F.count("*").over(order).alias("n"), F.sum(failed).over(order).alias("errors"), F.sum(failed).over(run).alias("fails"),
            F.last(F.when(~F.col("failed"), F.col("ts")), ignorenulls=True).over(order).alias("ok"), F.last(F.when(F.col("failed"), F.col("ts")), ignorenulls=True).over(order).alias("bad"),
        ).alias("_here"),
    )
    here, _ = scratch.save(here)
    scratch.drop(first)
    folds = here.groupBy(F.col("name").alias("_name"), F.col("_range").alias("_of")).agg(F.max_by("_here", F.col("_here.n")).alias("f"))
    ranges = W.partitionBy("_name").orderBy("_of")
    before = ranges.rowsBetween(W.unboundedPreceding, -1)
    folds = folds.withColumn("_island", F.sum(F.when(F.col("f.ok").isNotNull(), 1).otherwise(0)).over(ranges))
    folds = folds.withColumn("_fails", F.sum("f.fails").over(W.partitionBy("_name", "_island").orderBy("_of")))
    carried = folds.select(
        "_name", "_of",
        F.struct(
            F.coalesce(F.sum("f.n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("f.errors").over(before), F.lit(0)).alias("errors"), F.coalesce(F.lag("_fails").over(ranges), F.lit(0)).alias("fails"),
            F.last("f.ok", ignorenulls=True).over(before).alias("ok"), F.last("f.bad", ignorenulls=True).over(before).alias("bad"),
        ).alias("_before"),
    )
    carried, _ = scratch.save(carried)
    rows = here.join(sized(carried), here["name"].eqNullSafe(carried["_name"]) & (here["_range"] == carried["_of"]))
    both = lambda c: F.col(f"_here.{c}") + F.col(f"_before.{c}")
    return rows.select(
        *fetches.columns,
        (F.col("_here.fails") + F.when(F.col("_here.ok").isNull(), F.col("_before.fails")).otherwise(0)).alias("consecutive_failures"),
        both("n").alias("total_fetches"), both("errors").alias("total_errors"),
        F.coalesce("_here.ok", "_before.ok").alias("last_success"), F.coalesce("_here.bad", "_before.bad").alias("last_error"),
    )


def source_health(fetches: DataFrame) -> DataFrame:
    """The state after all fetches, without sorting a source's whole log: failures after the last success are counted."""
    at = F.struct("ts", "seq")
    base = fetches.groupBy("name").agg(
        F.count("*").alias("total_fetches"),
        F.count_if("failed").alias("total_errors"),
        F.max(F.when(~F.col("failed"), at)).alias("_ok"),
        F.max(F.when(F.col("failed"), F.col("ts"))).alias("last_error"),
    )
    since = fetches.join(base.select("name", "_ok"), "name").where(F.col("failed") & (F.col("_ok").isNull() | (at > F.col("_ok"))))
    runs = since.groupBy("name").agg(F.count("*").alias("consecutive_failures"))
    return base.join(runs, "name", "left").select(
        "name",
        F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"),
        "total_fetches",
        "total_errors",
        F.col("_ok.ts").alias("last_success"),
        "last_error",
        (F.col("_ok").isNotNull() & F.col("consecutive_failures").isNull()).alias("recovered"),
    )


def auto_disabled(health: DataFrame, limit: int = DISABLE_AT) -> DataFrame:
    return health.where((F.col("consecutive_failures") >= limit) & ~F.col("recovered"))


def split_sources(sources: DataFrame, health: DataFrame, limit: int = DISABLE_AT) -> tuple[DataFrame, DataFrame]:
    """Enabled sources to fetch, and those skipped as disabled with their count of failures."""
    enabled = sources.where(F.coalesce("enabled", F.lit(True)))
    out = auto_disabled(health, limit).select("name", "consecutive_failures")
    return enabled.join(out, "name", "left_anti"), enabled.join(out, "name")


def last_status(statuses: DataFrame) -> DataFrame:
    """The last status of each named source. statuses: name, status, error, ord."""
    named = statuses.where("name is not null and name != ''")
    return named.groupBy("name").agg(F.max_by(F.struct("status", "error", "ord"), "ord").alias("s")).select("name", "s.status", "s.error")


def severity_of(group: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return F.coalesce(F.get(F.filter(F.map_entries(pairs), lambda e: e["key"] == group), 0)["value"], F.lit("low"))


def source_alerts(sources: DataFrame, status: DataFrame, health: DataFrame, items: DataFrame) -> DataFrame:
    """Alerts of enabled sources, ordered by severity, then as configured. sources: name, group, enabled, ord."""
    counts = items.groupBy(F.col("source_name").alias("name")).agg(F.count("*").alias("n"))
    rows = sources.where(F.coalesce("enabled", F.lit(True))).join(status, "name", "left").join(health.select("name", "consecutive_failures"), "name", "left").join(counts, "name", "left")
    group = F.coalesce("group", F.lit(OTHER_GROUP))
    fails, n = F.coalesce("consecutive_failures", F.lit(0)), F.coalesce("n", F.lit(0))
    ok, disabled = F.coalesce(F.col("status") == "success", F.lit(False)), F.coalesce(F.col("status") == "auto_disabled", F.lit(False))
    failing, silent = (fails >= 3) & ~ok & (n == 0), n == 0
    told = rows.where(disabled | silent).select(
        F.col("name").alias("source_name"),
        group.alias("group"),
        F.when(disabled, "high").when(failing, F.when(fails >= 5, "high").otherwise("medium")).otherwise(severity_of(group)).alias("severity"),
        F.when(disabled, F.format_string(REASONS["disabled"], fails)).when(failing, F.format_string(REASONS["failing"], fails)).when(~ok, REASONS["failed"]).otherwise(REASONS["no_items"]).alias("reason"),
        F.when(disabled | failing | ~ok, F.col("error")).alias("fetch_error"),
        "ord",
    )
    rank = F.lit(9)
    for name, r in SEVERITY_ORDER.items():
        rank = F.when(F.col("severity") == name, r).otherwise(rank)
    return told.withColumn("severity_rank", rank).orderBy("severity_rank", "ord")


def with_skipped(fetches: DataFrame, skipped: DataFrame, at: Column) -> DataFrame:
    """The log with a failed fetch at ``at`` for each source that was passed over, after its other fetches.

    With it a disabled source's failures go on growing until its state is reset by hand; without it they stay.
    """
    return fetches.unionByName(skipped.select("name", at.cast(fetches.schema["ts"].dataType).alias("ts"), F.lit(2**31 - 1).cast(fetches.schema["seq"].dataType).alias("seq"), F.lit(True).alias("failed")))
