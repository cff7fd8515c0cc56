"""Chinese words by a dictionary against all cuts of short strings, and its use in summaries."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import segment, text
from tidewire.functions.rules import STOP_WORDS
from tidewire.operators import summary
from tidewire.sources import settings


def all_cuts(run):
    for k in range(len(run)):
        for at in itertools.combinations(range(1, len(run)), k):
            yield [run[i:j] for i, j in zip((0, *at), (*at, len(run)), strict=True)]


def brute(counts, run):
    total = sum(counts.values())
    weigh = lambda n: round(segment.SCALE * math.log(n / total))
    possible = (c for c in all_cuts(run) if all(p in counts or len(p) == 1 for p in c))
    return max(possible, key=lambda c: (sum(weigh(counts.get(p, 0.5)) for p in c), [len(p) for p in c]))


@pytest.mark.parametrize("seed", range(6))
def test_best_path_equals_all_cuts(seed):
    rng = random.Random(seed)
    letters = "数据安全网络"[: 2 + seed % 5]
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): rng.choice([1, 1, 2, 8, 64]) for _ in range(12)}
    words = segment.Dictionary(counts)
    for _ in range(150):
        run = "".join(rng.choice(letters + "外") for _ in range(rng.randint(1, 9)))
        got = list(words.cut(run))
        assert [p for p, _ in got] == brute(counts, run) and all(known == (p in counts) for p, known in got)


def test_unknown_runs_give_bigrams():
    words = segment.Dictionary({"网络": 5, "安全": 5, "网络安全": 50, "大": 1})
    assert words.words("网络安全") == ["网络安全"] and words.words("大网络") == ["大", "网络"]
    assert words.words("甲乙丙安全丁") == ["甲乙", "乙丙", "安全", "丁"] and words.words("") == []
    assert segment.Dictionary({}).words("甲乙丙") == ["甲乙", "乙丙"] == segment.bigrams("甲乙丙")
    assert len(list(segment.Dictionary({"网" * 40: 1}).cut("网" * 20_000))) == 500


def test_a_dictionary_without_words_gives_the_same_tokens_as_none(spark):
    rows = [(["Word 网络安全 the x2", "", "据"],), ([],), (None,), ([None, "ab 数据数据"],)]
    df = spark.createDataFrame(rows, "s array<string>")
    plain = [r[0] for r in df.select(F.transform("s", lambda x: text.tokens(x, STOP_WORDS))).collect()]
    empty = [r[0] for r in df.select(segment.tokens_of_all(F.col("s"), STOP_WORDS, segment.Dictionary({}))).collect()]
    assert empty[:3] == plain[:3] and empty[3][1] == plain[3][1] == ["ab", "数据", "据数"]
    own = segment.Dictionary({"网络安全": 9, "数据": 9})
    assert df.select(segment.tokens_of_all(F.col("s"), STOP_WORDS, own)).first()[0][0] == ["word", "x2", "网络安全"]


def test_summaries_by_a_dictionary(spark, tmp_path):
    (tmp_path / "words").write_text("网络安全 50 n\n数据 20\n\nbroken\n数据 5 n\n研究 x\n研究人员 7\n漏洞 -1\n", encoding="utf-8")
    words = settings.read_dictionary(spark, str(tmp_path / "words"))
    assert words.words("网络安全数据研究人员漏洞") == ["网络安全", "数据", "研究人员", "漏洞"]  # the last as a bigram of unknown characters
    lines = ["网络安全研究人员发布了新的数据报告并说明了情况。", "今天天气晴朗大家都到公园里去散步和拍照片了呢。", "研究人员认为网络安全与数据同样重要需要重视它。"]
    docs = spark.createDataFrame([(1, "".join(lines)), (2, None), (3, "".join(lines * 3))], "ord long, text string")
    got = {(r.ord, r.i, r.j): r.weight for r in summary.sentence_similarity(docs.where("ord = 1"), dictionary=words).collect()}
    sets = [set(w for w in words.words(s.rstrip("。")) if len(w) > 1 and w not in STOP_WORDS) for s in lines]
    assert got == {(1, 0, 2): pytest.approx(len(sets[0] & sets[2]) / len(sets[0] | sets[2]))}
    made = {r.ord: r.extract for r in summary.summarize(docs, dictionary=words).collect()}
    sentences = lines * 3
    assert made == {1: "", 2: "", 3: summary.best_sentences(sentences, [sets[i % 3] for i in range(9)])}
