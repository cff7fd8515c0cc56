"""Translation by calls: each distinct text once, failures, the memo, the rate, and both ways of joining."""

import time
import uuid

from pyspark.sql import functions as F

from tidewire.operators import summary, translate

ITEMS = "ord long, language string, title string, summary string, original_summary string, ai_summary string"


def calls_of(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def caller(folder):
    def call(text):
        (folder / uuid.uuid4().hex).write_text(text)
        if "bad" in text:
            raise TimeoutError
        return None if "none" in text else text if "same" in text else text.upper()

    return call


def rows_of(df):
    return sorted(((r.ord, r.title_zh, r.summary_zh, r.ai_summary_zh) for r in df.collect()), key=str)


def table(spark):
    rows = [
        (1, "en", "one", "two", None, "three"), (2, "en", "one", "x", "two", "one"), (3, "de", "one", "two", None, "vier"), (4, "en", "bad", "none", "", "same"), (5, None, None, None, None, None),
        (6, "en", "", " \n", None, "漢字漢字"), (7, "en", "a" * 1600, "b" * 700, None, "c" * 1600), (7, "en", "other", "two", None, "three"), (7, "en", "other", "two", None, "three"), (None, "en", "one", None, None, ""),
    ]
    return spark.createDataFrame(rows, ITEMS)


EXPECTED = [
    (1, "ONE", "TWO", "THREE"), (2, "ONE", "TWO", "ONE"), (3, None, None, "VIER"), (4, "bad", "none", "same"), (5, None, None, ""), (6, "", " \n", "漢字漢字"),
    (7, "A" * 1500, "B" * 500, "C" * 1500), (7, "OTHER", "TWO", "THREE"), (7, "OTHER", "TWO", "THREE"), (None, "ONE", "", ""),
]


def test_each_text_is_sent_once_and_remembered(spark, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir()
    second.mkdir()
    got, memo = translate.translate_once(table(spark), caller(first), callers=3)
    assert rows_of(got) == sorted(EXPECTED, key=str)
    sent = sorted(["a" * 1500, "b" * 500, "bad", "c" * 1500, "none", "one", "other", "same", "three", "two", "vier"])
    assert calls_of(first) == sent and sorted(r.text for r in memo.collect()) == [t for t in sent if t not in ("bad", "none", "same")]
    again, grown = translate.translate_once(table(spark), caller(second), memo, callers=3)
    assert rows_of(again) == sorted(EXPECTED, key=str) and calls_of(second) == ["bad", "none", "same"] and grown.count() == memo.count()
    empty, memo = translate.translate_once(table(spark).limit(0), caller(second), memo)
    assert empty.count() == 0 and memo.count() == 8 and empty.columns == got.columns


def test_joining_by_item_gives_the_same_rows(spark, tmp_path):
    keyed = table(spark).where("ord is not null").withColumn("key", F.lit(1)).withColumn("made", F.lit("x"))
    got, _ = translate.translate_once(keyed, caller(tmp_path), broadcast_bytes=0)
    assert rows_of(got) == sorted((r for r in EXPECTED if r[0] is not None), key=str) and [r.made for r in got.collect()] == ["x"] * 9


def test_calls_keep_to_the_rate(spark, tmp_path):
    items = spark.range(12).selectExpr("id as ord", "'en' as language", "concat('t', id) as title")
    began = time.time()
    got, _ = translate.translate_once(items, caller(tmp_path), callers=2, per_second=8)
    assert {r.title_zh for r in got.collect()} == {f"T{i}" for i in range(12)} and len(calls_of(tmp_path)) == 12
    assert time.time() - began >= 5 / 4  # of two callers one has six texts or more, a quarter of a second apart


def test_english_first_keeps_the_order(spark):
    df = spark.createDataFrame([(0, "de"), (1, "en"), (2, None), (3, "en")], "ord long, language string").withColumn("id", F.col("ord"))
    assert [r.id for r in summary.english_first(df).orderBy("ord").collect()] == [1, 3, 0, 2]
