"""Files that steps read and write, settings, and what is said of entries and readers."""

import json

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.functions.rules import CATEGORY_ORDER, UNCLASSIFIED
from tidewire.operators import health, report
from tidewire.plans import weekly
from tidewire.sources import fetch, settings

REPORT = "ord long, title string, url string, category string, filter_decision string"


def test_a_status_file_that_is_missing_or_damaged_is_empty(spark, tmp_path):
    for name, body in (("good", '{"a": {"n": 1}}'), ("cut", '{"a": '), ("none", ""), ("list", "[1]")):
        (tmp_path / name).write_text(body)
    read = lambda name: settings.read_status(spark, str(tmp_path / name))
    assert [read(n) for n in ("good", "cut", "none", "list", "missing")] == [{"a": {"n": 1}}, {}, {}, {}, {}]


def test_settings_have_defaults():
    assert settings.settings_from({}) == settings.Settings(85, 7, (*CATEGORY_ORDER, UNCLASSIFIED) if UNCLASSIFIED not in CATEGORY_ORDER else settings.Settings().category_order)
    assert settings.settings_from({"dedup": {"similarity_threshold": 70, "max_days": 3}, "category_order": ["b", "a"]}) == settings.Settings(70, 3, ("b", "a"))
    assert settings.settings_from({"category_order": []}).category_order == settings.Settings().category_order


def test_weekly_files_are_split_by_the_category_index(spark, tmp_path):
    first, second = CATEGORY_ORDER[1], CATEGORY_ORDER[3]
    rows = [(0, "a", "u0", second, "accepted"), (1, "b", "u1", first, "accepted"), (2, "c", "u2", "strange", None), (3, "d", "u3", CATEGORY_ORDER[0], "review"), (4, "e", "u4", None, "accepted")]
    df = spark.createDataFrame(rows, REPORT)
    got = {r.ord: (r.is_review, r.cat_idx) for r in report.with_category_index(df).collect()}
    assert got == {0: (False, 1), 1: (False, 0), 2: (False, 2), 3: (True, None), 4: (False, 2)}
    report.write_weekly(df, str(tmp_path / "week"))
    assert {p.name for p in (tmp_path / "week" / "is_review=false").iterdir() if p.is_dir()} == {"cat_idx=0", "cat_idx=1", "cat_idx=2"}
    assert spark.read.json(str(tmp_path / "week")).count() == 5
    report.write_weekly(df.limit(0), str(tmp_path / "empty"))
    assert [r.ord for r in report.preview(df, 2).collect()] == [0, 1]


def test_history_keeps_one_row_set_a_day(spark, tmp_path):
    day = lambda d, n: spark.createDataFrame([(d, n)], "day string, n int")
    for d, n in (("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-01", 3)):
        report.append_history(day(d, n), str(tmp_path / "history"))
    assert sorted((str(r.day), r.n) for r in spark.read.parquet(str(tmp_path / "history")).collect()) == [("2024-01-01", 3), ("2024-01-02", 2)]


def test_items_come_from_the_first_file_that_exists(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"title": "x", "n": 1}, {"title": None}]))
    read = lambda *names: fetch.read_items(spark, *(str(tmp_path / n) for n in names), schema="title string, n int")
    assert [tuple(r) for r in read("a.json", "b.json").collect()] == [("x", 1), (None, None)] and read("a.json").count() == 0


def test_steps_stay_in_a_named_folder(spark, tmp_path):
    body = "<rss><channel><item><title>license</title><link>http://1</link><description>d</description></item></channel></rss>"
    raw = spark.createDataFrame([(0, "s", "en", "rss", None, body, None)], "ord int, source_name string, language string, type string, api_platform string, xml_text string, error string")

    def broken(items):
        raise RuntimeError("no")

    rows, failed = weekly.run(raw, [("same", lambda x: x), ("bad", broken)], F.lit("2024-06-15").cast("timestamp"), keep=str(tmp_path / "kept"))
    assert list(failed) == ["bad"] and {p.name for p in (tmp_path / "kept").iterdir()} == {"parsed", "same"}
    assert spark.read.json(str(tmp_path / "kept" / "same")).count() == rows.count() == 1


def test_skipped_sources_go_on_failing(spark):
    log = spark.createDataFrame([("a", "2024-01-01", 1, False), ("a", "2024-01-02", 2, True), ("b", "2024-01-01", 1, False)], "name string, ts string, seq long, failed boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    skipped = spark.createDataFrame([("a",)], "name string")
    for _ in range(2):
        log = health.with_skipped(log, skipped, F.lit("2024-01-03"))
    assert {r.name: (r.consecutive_failures, r.total_errors) for r in health.source_health(log).collect()} == {"a": (3, 3), "b": (0, 0)}


def test_body_of_an_entry_and_mobile_readers(spark):
    df = spark.createDataFrame([("<p>full</p>", "s", "d"), (" \n", "<b>s</b>", "d"), (None, None, "d &amp; e"), (None, "", "d"), (None, None, None)], "c string, s string, d string")
    assert [r[0] for r in df.select(T.feed_body(F.col("c"), F.col("s"), F.col("d"))).collect()] == ["full", "s", "d & e", "", ""]
    agents = spark.createDataFrame([("Mozilla (iPhone; x)",), ("Opera Mini/7",), ("Mozilla (X11; Linux)",), ("",), (None,)], "a string")
    assert [r[0] for r in agents.select(T.is_mobile(F.col("a"))).collect()] == [True, True, False, False, None]


def test_settings_decide_similarity_and_age(spark):
    day = lambda d: f"2024-06-{d:02d}T00:00:00"
    rows = [(0, "alpha beta gamma", "u0", day(14), False), (1, "alpha beta gammas!!", "u1", day(14), False), (2, "other words", "u2", day(9), False)]
    items = spark.createDataFrame([(*r, "s") for r in rows], "ord long, title string, url string, published_date string, parse_error boolean, source_name string")
    pages, now = spark.createDataFrame([], "url string, html string"), F.lit("2024-06-15").cast("timestamp")

    def kept(**given):
        following = dict(weekly.steps(pages, now, settings=settings.settings_from({"dedup": given})))
        return sorted(r.ord for r in following["duplicates"](following["expiry"](items)).collect())

    assert kept() == [0, 2]
    assert kept(max_days=3) == [0] and kept(similarity_threshold=99) == [0, 1, 2]
