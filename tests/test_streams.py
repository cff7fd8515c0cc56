"""Streams against their batch forms: rows in any order, repeated and late ones, restarts from the checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import dedup, health
from tidewire.streaming import feeds


@pytest.fixture
def feeding(spark, tmp_path):
    """Writes each part as a file and runs the stream over it to its end: a restart between any two parts."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.STATE_STORE)

    def run(parts, plan, mode):
        out = []

        def keep(batch, _):
            out.extend(batch.collect())

        for part in parts:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            rows = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
            q = plan(rows).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            assert q.awaitTermination(180)
        return out

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def fetch_rows(spark, rows):
    return spark.createDataFrame(rows, "name string, ts long, seq long, failed boolean").withColumn("ts", F.timestamp_seconds((F.col("ts") + 400) * 3600))


def test_health_stream_equals_batch_in_any_order(spark, feeding):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), rng.randrange(40), seq, rng.random() < 0.7) for seq in range(90)]
    rows += [("late", 5, 100, True), ("late", 1, 101, False), ("late", 5, 100, True), ("bad", 3, 102, True), (None, 1, 1, True), ("a", None, 1, True)]
    rng.shuffle(rows)
    parts = [fetch_rows(spark, rows[k::3]) for k in range(3)]
    states = feeding(parts, lambda s: feeds.health_stream(s, "10 days"), "update")
    last = {r.name: r for r in states}  # the latest state of each
    want = health.source_health(fetch_rows(spark, [r for r in rows if r[0] and r[1] is not None])).collect()
    assert len(want) == 5
    for r in want:
        assert last[r.name].asDict() == r.asDict(), r.name


def test_health_stream_counts_failures_behind_the_watermark_and_passes_later_rows_over(spark, feeding):
    parts = [[("a", 1, 1, True), ("a", 2, 2, True)], [("a", 100, 3, True)], [("a", 101, 4, True)], [("a", 50, 5, False)], [("a", 102, 6, False), ("a", 103, 7, True)]]
    states = feeding([fetch_rows(spark, p) for p in parts], lambda s: feeds.health_stream(s, "1 hour"), "update")
    fails = [(r.consecutive_failures, r.total_fetches) for r in states]
    assert [x for k, x in enumerate(fails) if k == 0 or fails[k - 1] != x] == [(2, 2), (3, 3), (4, 4), (1, 6)]


ITEMS = "ord long, url string, ts long"


def item_rows(spark, rows):
    return spark.createDataFrame(rows, ITEMS).withColumn("ts", F.timestamp_seconds((F.col("ts") + 400) * 3600))


def test_fresh_items_equal_batch_and_keep_items_without_url_or_time(spark, feeding):
    rows = [(1, "u", 1), (2, "", 1), (3, "", 1), (4, None, 2), (5, "v", None), (6, "v", None), (7, "u", 3), (8, "w", 4), (9, "u", 20), (10, "w", 21)]
    parts = [item_rows(spark, rows[:4]), item_rows(spark, rows[4:8]), item_rows(spark, rows[8:])]
    got = sorted(r.ord for r in feeding(parts, feeds.fresh_items, "append"))
    timed = item_rows(spark, [r for r in rows if r[2] is not None])
    want = sorted([r.ord for r in dedup.drop_url_duplicates(timed).collect()] + [5, 6])
    assert got == want == [1, 2, 3, 4, 5, 6, 8]


@pytest.mark.parametrize("name", ["weekly", "sliding", "sessions"])
def test_windows_equal_batch_after_a_restart(spark, feeding, name):
    plan = {"weekly": lambda s: feeds.weekly_counts(s, "url"), "sliding": lambda s: feeds.sliding_counts(s, "url", size="2 days"), "sessions": lambda s: feeds.sessions(s, "url", late="1 day")}[name]
    rng = random.Random(1)
    rows = sorted([(k, rng.choice("xy"), rng.randrange(24 * 20)) for k in range(60)], key=lambda r: r[2] + rng.randrange(12)) + [(99, None, None)]
    end, late = (1000, "x", 24 * 300), (1001, "x", 3)  # closes all windows; comes too late
    parts = [item_rows(spark, rows[:30]), item_rows(spark, rows[30:]), item_rows(spark, [end]), item_rows(spark, [late, (1002, "y", 24 * 301)])]
    got = feeding(parts, plan, "append")
    want = plan(item_rows(spark, [r for r in rows if r[2] is not None])).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
