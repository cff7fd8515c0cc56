"""Fetching: order and number of calls at once, limits for each host, disabled sources, and runs as a stream."""

import json
import threading
import time
from datetime import datetime, timedelta, timezone

import pytest

from tidewire.sources import fetch


def told(source, headers):
    return f"body of {source['name']}"


class Clock:
    def __init__(self):
        self.now, self.waits = 100.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.waits.append(round(seconds, 6))
        self.now += seconds


def test_a_bucket_spaces_calls_after_its_burst():
    clock = Clock()
    bucket = fetch.Bucket(2.0, 3, clock, clock.sleep)
    at = []
    for _ in range(6):
        bucket.take()
        at.append(clock.now - 100)
    assert at == [0, 0, 0, 0.5, 1.0, 1.5]
    clock.now += 60  # no more than the burst is saved up
    clock.waits.clear()
    for _ in range(4):
        bucket.take()
    assert clock.waits == [0.5]


def test_hosts_have_buckets_of_their_own_and_second_tries_count():
    clock = Clock()
    calls = []

    def shy(source, headers):
        calls.append((source["url"], clock.now - 100))
        return "x" if headers else ""

    slow = fetch.limited(shy, 1.0, clock=clock, sleep=clock.sleep)
    for url in ("http://A.x/1", "http://b.x/1", "http://a.x:80/2", "http://[", None):
        fetch.fetch_one({"name": "s", "url": url}, slow)
    by_host = [(fetch.host_of({"url": u}), t) for u, t in calls]
    assert by_host == [("a.x", 0), ("a.x", 1), ("b.x", 1), ("b.x", 2), ("a.x", 2), ("a.x", 3), ("", 3), ("", 4), ("", 5), ("", 6)]


def test_results_come_in_order_and_a_bounded_number_is_in_work():
    lock, now, most, begun = threading.Lock(), 0, 0, 0

    def work(source):
        nonlocal now, most, begun
        with lock:
            now, begun = now + 1, begun + 1
            most = max(most, now)
        time.sleep(0.02 if source["n"] % 3 else 0.06)
        with lock:
            now -= 1
        return source["n"]

    sources = [{"n": i} for i in range(40)]
    assert list(fetch.in_order(work, sources, 5)) == list(range(40)) and 1 < most <= 5
    begun = 0
    first = fetch.in_order(work, sources, 2)
    assert next(first) == 0
    first.close()  # a reader that stops early leaves no more than what was ahead
    assert begun <= fetch.AHEAD * 2
    assert list(fetch.in_order(work, sources[:3], 1)) == [0, 1, 2] and list(fetch.in_order(work, [], 4)) == []


@pytest.mark.parametrize("size", [1, 3, 100])
def test_hosts_are_kept_whole_where_calls_are_limited(size):
    sources = [{"name": str(i), "url": f"http://h{i % 4 if i % 3 else 0}.x/{i}"} for i in range(30)] + [{"name": "none"}]
    plain, whole = fetch.dealt(sources, size, False), fetch.dealt(sources, size, True)
    assert [s for p in plain for s in p] == sources and max(map(len, plain)) <= size
    assert sorted(s["name"] for p in whole for s in p) == sorted(s["name"] for s in sources)
    where = {}
    for k, part in enumerate(whole):
        for s in part:
            where.setdefault(fetch.host_of(s), set()).add(k)
    assert all(len(parts) == 1 for parts in where.values())
    assert all(len(p) <= size or len({fetch.host_of(s) for s in p}) == 1 for p in whole)


def test_disabled_sources_are_rows_that_were_not_asked(spark):
    spark.dataSource.register(fetch.FeedSource)
    sources = [{"name": n, "type": "rss", "url": f"http://{n}.x"} for n in ("a", "b", "c", "d")] + [{"name": "off", "enabled": False}]
    status = {"b": {"consecutive_failures": 5}, "c": {"consecutive_failures": 9, "recovered": True}, "d": {"consecutive_failures": 4}, "off": {"consecutive_failures": 7}, "x": None}
    read = spark.read.format("feeds").option("catalogue", json.dumps(sources)).option("status", json.dumps(status)).option("transport", "tests.test_fetching:told")
    for rate in ("0", "1000"):
        got = {r.source_name: (r.xml_text, r.error) for r in read.option("rate", rate).option("per_task", 2).load().collect()}
        assert got == {"a": ("body of a", None), "b": ("", "auto_disabled: 5 failures"), "c": ("body of c", None), "d": ("body of d", None)}


def test_runs_are_fetched_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(fetch.FeedSource)
    sources = [{"name": f"s{i}", "type": "rss", "url": f"http://s{i % 3}.x"} for i in range(7)]
    start = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0) - timedelta(hours=5)
    times = lambda runs: [(start + timedelta(hours=2 * r)).isoformat() for r in runs]

    def until_done(begin):
        stream = spark.readStream.format("feeds").option("catalogue", json.dumps(sources)).option("transport", "tests.test_fetching:told")
        stream = stream.option("start", begin.isoformat()).option("every", 7200).option("per_task", 2).option("rate", "1000").load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(90)
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.fetch_time, r.source_name, r.xml_text) for r in rows)

    want = lambda at: [(t, s["name"], f"body of {s['name']}") for t in at for s in sources]
    assert until_done(start) == want(times([2]))  # the last run that is due; those before it were missed
    assert until_done(start) == want(times([2]))  # nothing new is due
    # as if the schedule had begun three hours before: five runs are due, and the last of the two new ones comes
    assert until_done(start - timedelta(hours=3)) == want(times([2]) + [(start + timedelta(hours=5)).isoformat()])


def test_offsets_of_runs():
    options = {"catalogue": json.dumps([{"name": "a"}, {"name": "b"}]), "start": "2024-01-01T00:00:00", "every": "60", "per_task": "1"}
    runs = fetch.FeedRuns(options)
    assert runs.initialOffset() == {"runs": 0} and runs.latestOffset()["runs"] > 10**6
    assert [p.sources for p in runs.partitions({"runs": 3}, {"runs": 3})] == [[]]
    again = [[(p.at, [s["name"] for s in p.sources]) for p in runs.partitions({"runs": 3}, {"runs": 5})] for _ in range(2)]
    assert again[0] == again[1] == [("2024-01-01T00:04:00", ["a"]), ("2024-01-01T00:04:00", ["b"])]
    assert fetch.FeedRuns({**options, "start": "2999-01-01T00:00:00"}).latestOffset() == {"runs": 0}
    with pytest.raises(ValueError):
        fetch.FeedRuns({})
