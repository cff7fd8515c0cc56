"""Streams of raw items and fetches: keyed health state, duplicates within a watermark, weekly windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HEALTH = "name string, consecutive_failures long, total_fetches long, total_errors long, ok long, bad long"
#: Times are microseconds. ``old``: failures since the last success from before the watermark; ``open_at``, ``open_seq``: those after it.
STATE = "fetches long, errors long, ok long, ok_seq long, bad long, old long, open_at array<bigint>, open_seq array<bigint>"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningHealth(StatefulProcessor):
    """A source's state, the same in whatever order its fetches arrive.

    A failure counts if it is later than the last success known. Those that a success yet to come might still overtake are kept one
    by one; once the watermark has passed them no success can come between them, and they are a number.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fetches, errors, ok, ok_seq, bad, old, at, seqs = self.state.get() if self.state.exists() else (0, 0, None, None, None, 0, [], [])
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        last = (ok, ok_seq) if ok is not None else None
        failures = list(zip(at, seqs, strict=True))
        for batch in rows:
            for us, seq, failed in zip(batch["us"].tolist(), batch["seq"].tolist(), batch["failed"].tolist(), strict=True):
                if us < passed:
                    continue
                fetches, errors = fetches + 1, errors + failed
                if failed:
                    failures.append((us, seq))
                    bad = us if bad is None else max(bad, us)
                elif last is None or (us, seq) > last:
                    last, old = (us, seq), 0
        failures = [f for f in failures if last is None or f > last]
        old += sum(f[0] < passed for f in failures)
        failures = [f for f in failures if f[0] >= passed]
        ok, ok_seq = last if last else (None, None)
        self.state.update((fetches, errors, ok, ok_seq, bad, old, [f[0] for f in failures], [f[1] for f in failures]))
        out = pd.DataFrame([[key[0], old + len(failures), fetches, errors, ok, bad]], columns=["name", "consecutive_failures", "total_fetches", "total_errors", "ok", "bad"])
        yield out.astype({"ok": "Int64", "bad": "Int64"})

    def close(self) -> None:
        pass


def health_stream(fetches: DataFrame, late: str = "1 day") -> DataFrame:
    """The state of each source after each batch that has fetches of it, as ``source_health`` gives it for all of them. fetches: name, ts, seq, failed.

    Fetches may come in any order; those older than the watermark (``late`` behind the latest time seen in earlier batches), or without a name or a time, are
    passed over. Rows that are delivered twice count twice. Needs the state store ``STATE_STORE`` (spark.sql.streaming.stateStore.providerClass).
    """
    rows = fetches.where("name is not null and ts is not null").select("name", "ts", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("failed", F.lit(False)).alias("failed"))
    rows = rows.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    states = rows.groupBy("name").transformWithStateInPandas(RunningHealth(), HEALTH, "Update", "EventTime")
    return states.select(
        "name", "consecutive_failures", "total_fetches", "total_errors", F.timestamp_micros("ok").alias("last_success"), F.timestamp_micros("bad").alias("last_error"),
        (F.col("ok").isNotNull() & (F.col("consecutive_failures") == 0)).alias("recovered"),
    )


def fresh_items(items: DataFrame, time: str = "ts", days: int = 7) -> DataFrame:
    """Each url once within the retention; items without a url or a time all pass by, as in ``drop_url_duplicates``. Later ones than the watermark are dropped."""
    keyed = (F.coalesce("url", F.lit("")) != "") & F.col(time).isNotNull()
    rows = items.withWatermark(time, f"{days} days")
    return rows.where(keyed).dropDuplicatesWithinWatermark(["url"]).unionByName(items.where(~keyed))


def weekly_counts(items: DataFrame, key: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts by week (from Monday: the epoch was a Thursday, hence the offset of 4 days) and key."""
    week = F.window(F.col(time), "7 days", "7 days", "4 days")
    counts = items.withWatermark(time, late) if items.isStreaming else items
    return counts.groupBy(week.alias("week"), key).agg(F.count("*").alias("n")).select(F.col("week.start").alias("week_start"), key, "n")


def sliding_counts(items: DataFrame, key: str, time: str = "ts", size: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts of each key in windows of ``size`` that begin every ``slide``: a row counts in each window that holds it."""
    counts = items.withWatermark(time, late) if items.isStreaming else items
    return counts.groupBy(F.window(time, size, slide).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(items: DataFrame, key: str, time: str = "ts", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a key's rows without a pause of ``gap``; a session ends that long after its last row. Rows without a time have none."""
    rows = items.withWatermark(time, late) if items.isStreaming else items
    return rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
