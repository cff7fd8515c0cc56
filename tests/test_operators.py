import json
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire import scratch
from tidewire.functions import dom, match
from tidewire.functions import text as T
from tidewire.functions.match import has_keyword
from tidewire.functions.rules import SAMPLE, STOP_WORDS
from tidewire.operators import dashboard, dedup, extract, health, report, scoring, summary
from tidewire.plans import weekly
from tidewire.sources import fetch, parse
from tidewire.streaming import feeds


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_keywords_are_words_of_any_script(spark):
    texts = ["an APT group", "APT组织", "apt_x", "CAPTION", "APT", "the ①APT"]
    assert one(spark, lambda v: has_keyword(v, "APT"), *texts) == [True, False, False, False, True, False]
    assert one(spark, lambda v: has_keyword(v, "CVE-"), "CVE-2024", "CVE- x") == [True, False]
    assert one(spark, lambda v: has_keyword(v, "漏洞"), "新漏洞披露", "none") == [True, False]


def test_keyword_boundaries_equal_pythons(spark):
    texts = ["a b", "xab", "ab", "ab.", "éab", "ab²", "9ab", "ab-c", "_ab", " AB "]
    assert one(spark, lambda v: has_keyword(v, "ab"), *texts) == [bool(re.search(r"\bab\b", t, re.I)) for t in texts]


def items(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, title string, summary string, url string, source_name string, published_date string, language string")


def test_segments_at_400_and_401_characters(spark):
    df = items(spark, ("t", "a" * 400, "", "", "", "en"), ("t", "a" * 401, "", "", "", "en"), (None, None, "", "", "", "en"))
    got = [tuple(len(r[f"seg_{s}"]) for s in scoring.SEGMENTS) for r in scoring.segments(df).orderBy("ord").collect()]
    assert got == [(1, 200, 200, 0), (1, 200, 1, 200), (0, 0, 0, 0)]


def test_negative_clamp_lifts_to_ten_unless_strong(spark):
    df = items(spark, ("stupid", "nothing here", "", "", "", "en"), ("stupid idiot", "x", "", "", "", "en"))
    got = {r.ord: r.confidence_score for r in scoring.score(df).collect()}
    assert got == {0: 10, 1: 60}
    assert {r.ord: (r.stage1_score, r.stage1_drop) for r in scoring.quick_score(df).collect()} == {0: (0, True), 1: (60, False)}


def test_site_demotion_is_off_unless_named(spark):
    df = items(spark, ("license", "x", "", "src3", "", "en"))
    assert scoring.score(df).first().confidence_score == 100
    assert scoring.score(df, site="source_name").first().raw_score == 100.0


def test_two_normal_mediums_make_tier_c(spark):
    df = items(spark, ("und by with", "x", "", "", "", "en"))
    tiers = {r.category: r.tier for r in scoring.matches(scoring.segments(df)).select(F.explode(scoring.tier_scores(F.col("matched"))).alias("t")).select("t.*").collect()}
    assert tiers == {"Beta": "D", "Gamma": "D"}  # by doesn't score alone
    assert SAMPLE.ambiguity["by"].standalone is False


def test_dates(spark):
    now = F.lit("2024-06-15 12:00:00").cast("timestamp")
    dates = ["", None, "soon", "2024-06-14T00:00:00", "2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "ord long, published_date string")
    assert sorted(r.ord for r in dedup.filter_by_date(df, now).collect()) == [0, 1, 2, 3, 5, 6]
    assert sorted(r.ord for r in dedup.filter_by_date(df, now, strict=True).collect()) == [0, 1, 2, 3]


def test_urls_first_wins_and_empty_ones_stay(spark):
    df = items(spark, *[("t", "s", u, "a", "", "en") for u in ("x", "", "x", None, "", "y")])
    assert sorted(r.ord for r in dedup.drop_url_duplicates(df).collect()) == [0, 1, 3, 4, 5]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def similarity(a, b):
    return 100.0 if not a + b else 200 * lcs(a, b) / len(a + b)


@pytest.mark.parametrize("threshold", [60, 75, 90])
def test_close_pairs_equal_the_plain_subsequence(threshold):
    rng = random.Random(threshold)
    keys = ["".join(rng.choice("abcd é日") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 127, 128, 200]))) for _ in range(45)]
    keys = sorted({*keys, *(k[: len(k) // 2] + "x" + k[len(k) // 2 :] for k in keys[:20])})
    titles = pd.DataFrame({"key": keys, "first": range(len(keys))})
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if similarity(keys[i], keys[j]) >= threshold}
    assert want and set(dedup.close_pairs(titles, titles, threshold, True)) == want
    half = titles["first"] % 2 == 0
    across = {(i, j) for i, j in want if (i + j) % 2}
    got = dedup.close_pairs(titles[half], titles[~half], threshold, False)
    assert len(got) == len(set(got)) and set(got) == across


def test_few_close_pairs_need_whole_subsequences(monkeypatch):
    rng = random.Random(4)
    letters = "etaoinshrdlucmfw .,-é" + "".join(chr(0x4E00 + i) for i in range(30))
    weights = [1 / (i + 3) for i in range(len(letters))]
    keys = ["".join(rng.choices(letters, weights, k=rng.choice([62, 63, 64, 126, 127, 150, 250]))) for _ in range(50)]
    keys = sorted({*keys, *("".join(c for c in k if rng.random() > 0.3) for k in keys), *("".join(c if rng.random() > 0.2 else "x" for c in k) for k in keys)})
    titles = pd.DataFrame({"key": keys, "first": rng.sample(range(1000), len(keys))})
    first = titles["first"].tolist()
    want = {(min(first[i], first[j]), max(first[i], first[j])) for i in range(len(keys)) for j in range(i) if similarity(keys[i], keys[j]) >= 75}
    whole, lengths = [], dedup.lcs_lengths

    def counted(left, right, of_left, *rest):
        if left.sizes.max() == max(map(len, keys)):
            whole.append(len(of_left))
        return lengths(left, right, of_left, *rest)

    monkeypatch.setattr(dedup, "lcs_lengths", counted)
    assert set(dedup.close_pairs(titles, titles, 75, True)) == want
    assert len(want) <= sum(whole) <= 2 * len(want)
    monkeypatch.setattr(dedup, "FEW", 0)  # the same word by word
    assert set(dedup.close_pairs(titles, titles, 75, True)) == want


def made_titles(n, sizes, seed):
    """Titles of one make-up, so that common characters exclude few pairs, and some near copies."""
    rng = random.Random(seed)
    letters = " etaoinshrdlu"
    keys = ["".join(rng.choices(letters, [len(letters) - i for i in range(len(letters))], k=rng.choice(sizes))) for _ in range(n)]
    return sorted({*keys, *("".join(c for c in k if rng.random() > 0.1) for k in keys[::4])})


def test_titles_are_bounded_beside_many_before_they_meet_in_pairs(monkeypatch):
    keys = made_titles(400, [40, 45, 50, 120, 130, 260, 420], 11)
    titles = pd.DataFrame({"key": keys, "first": random.Random(12).sample(range(10_000), len(keys))})
    pairwise, lengths = [], dedup.lcs_lengths

    def counted(left, right, of_left, *rest):
        pairwise.append(len(of_left))
        return lengths(left, right, of_left, *rest)

    monkeypatch.setattr(dedup, "lcs_lengths", counted)
    monkeypatch.setattr(dedup, "BESIDE", 10**9, raising=False)
    want = set(dedup.close_pairs(titles, titles, 75, True))
    by_pairs = sum(pairwise)
    pairwise.clear()
    monkeypatch.setattr(dedup, "BESIDE", 1, raising=False)
    got = dedup.close_pairs(titles, titles, 75, True)
    assert want and len(got) == len(set(got)) and set(got) == want
    assert sum(pairwise) < by_pairs / 10


def test_lengths_beside_equal_those_of_pairs(monkeypatch):
    keys = ["", *made_titles(60, [3, 16, 17, 32, 33, 63, 64, 126, 127, 200, 600], 5)]
    (coded,) = dedup.coded(keys)
    which, some = np.repeat(np.arange(12), len(keys)), np.tile(np.arange(len(keys)), 12)
    monkeypatch.setattr(dedup, "BESIDE", 1)
    monkeypatch.setattr(dedup, "TOGETHER", 100)
    for group in (np.arange(13), np.array([0, 3, 4]), np.array([7])):
        part, starts = coded.only(group), np.cumsum(coded.sizes) - coded.sizes
        codes = [coded.flat[starts[j] : starts[j] + coded.sizes[j]] % dedup.BINS for j in range(12)]
        want = dedup.lcs_lengths(part, part, some, which, np.zeros(len(some), np.int64))
        assert dedup.Beside(coded, group).lengths(some, which, codes).tolist() == want.tolist()


def test_blocks_and_slices_make_each_pair_once(spark, monkeypatch):
    keys = ["", "a", *made_titles(60, [20, 30, 40, 60, 90, 140], 3)]
    titles = pd.DataFrame({"key": keys, "first": random.Random(1).sample(range(1000), len(keys))})
    want = set(dedup.close_pairs(titles, titles, 75, True))
    for name, value in (("BLOCK", 7), ("SLICE", 4)):
        monkeypatch.setattr(dedup, name, value)
    got = [tuple(r) for r in dedup.similar_titles(spark.createDataFrame(titles, "key string, first long"), 75).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_clusters_are_greedy_and_not_components(spark):
    titles = ["alpha beta gamma one", "alpha beta gamma two", "alpha beta gmma twoxx yy", "other thing", "News: other thing", "", "", "zz"]
    df = items(spark, *[(t, "s", f"u{i}", f"src{i % 3}", "", "en") for i, t in enumerate(titles)])
    norm = [" ".join(sorted(re.sub("^news: ", "", t.lower()).split())) for t in titles]
    reps, want = [], {}
    for i, t in enumerate(norm):
        want[i] = next((r for r in reps if similarity(norm[r], t) >= 75), i)
        if want[i] == i:
            reps.append(i)
    clusters = dedup.cluster_titles(df)
    assert {r.ord: r.rep for r in clusters.collect()} == want
    merged = {r.ord: r.merged_sources for r in dedup.merge_clusters(df, clusters).collect()}
    assert set(merged) == set(reps) and merged[3] == ["src0", "src1"] and merged[7] is None


def test_html_text(spark):
    html = "<p>One&nbsp;two</p><script>var x='</p>';</script><br/>A &amp;lt; b<hr><li>x</li>"
    assert one(spark, lambda v: T.fallback_text(v), html) == ["One two\n\nA < b\nx\n"]
    assert one(spark, lambda v: T.strip_html(v, extract.unescape), "<p>a&eacute;  b</p>\n\n\n\n<b>c</b>　") == ["aé b\n\nc"]
    assert one(spark, T.clean_noise_lines, "Copyright 2024 x\n body \n\n\n\nContact Us\n阅读原文\nend") == ["body\n\nend"]


def test_sentences(spark):
    text = "Copyright 2024 by all. 第一句话很好很长的一句话啊。Second sentence is here! 3.14 is pi\n\nNext paragraph sentence."
    assert one(spark, T.sentences, text)[0] == ["Copyright 2024 by all.", "第一句话很好很长的一句话啊。", "Second sentence is here!", "14 is pi Next paragraph sentence."]
    assert one(spark, T.useful_sentences, text)[0] == ["Second sentence is here!", "14 is pi Next paragraph sentence."]
    assert one(spark, lambda v: T.tokens(v, STOP_WORDS), "The Fox and 安全漏洞 x")[0] == ["fox", "and", "安全", "全漏", "漏洞"]


def test_text_rank_prefers_the_hub():
    rank = summary.text_rank([{"a", "b"}, {"a", "b", "c", "d"}, {"c", "d"}, {"z"}])
    assert rank.argmax() == 1 and abs(rank.sum() - 1) < 0.05


def dense_rank(sets):
    n = len(sets)
    weight = np.array([[len(a & b) / len(a | b) if i != j and a & b else 0.0 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    sums = weight.sum(axis=0)
    step = np.divide(weight, sums, out=np.full((n, n), 1 / n), where=sums > 0)
    rank = np.full(n, 1 / n)
    for _ in range(200):
        new = 0.15 / n + 0.85 * (step @ rank)
        moved, rank = np.abs(new - rank).sum(), new
        if moved < 1e-4:
            return rank
    return rank


@pytest.mark.parametrize(("cells", "kept"), [(2_000_000, 4_000_000), (60, 4_000_000), (60, 10)])
def test_text_rank_on_pairs_equals_the_dense_form(monkeypatch, cells, kept):
    monkeypatch.setattr(summary, "CELLS", cells)
    monkeypatch.setattr(summary, "KEPT", kept)
    rng = random.Random(cells + kept)
    for _ in range(60):
        sets = [set(rng.choices("abcdefghijklmnop", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 30))]
        assert np.allclose(summary.text_rank(sets), dense_rank(sets), atol=1e-12, rtol=0)


def test_summary_forms(spark):
    df = spark.createDataFrame([(0, "short"), (1, "word " * 30), (2, "This is a first long sentence. " * 3 + "Another longer sentence stands here. " * 3 + "x" * 600 + "."), (3, None)], "ord long, text string")
    got = {r.ord: r.extract for r in summary.summarize(df).collect()}
    assert got[0] == "" and got[3] == "" and got[1].startswith("word word") and len(got[2]) <= 500


def test_main_content_and_scraping():
    page = "<html><body><nav>menu</nav><div class='ad'>buy</div><article><h2><a href='/a'>Title one</a></h2><p>Text.</p><time datetime='2024-01-02'>x</time></article></body></html>"
    top = dom.parse(page)
    dom.prune(top)
    assert dom.main_content(top).split() == ["Title", "one", "Text.", "x"]
    assert dom.scrape(page, {"link_base": "https://e.org/"}) == [{"title": "Title one", "url": "https://e.org/a", "summary": "Text.", "published_date": "2024-01-02"}]
    long, links = "word " * 60, "<a href='x'>" + "link " * 60 + "</a>"
    assert dom.main_content(dom.parse(f"<body><div>{links}</div><div id=m>{long}</div></body>")).strip() == long.strip()


def test_parsers(spark):
    def raw(platform, body, kind="api"):
        return (0, "src", "en", kind, platform, body if isinstance(body, str) else json.dumps(body), None)

    rel = [{"tag_name": "v1", "name": "", "body": "", "html_url": "https://github.com/o/r/releases/1", "author": {"login": "me"}}, {"tag_name": "", "name": ""}]
    stix = {"objects": [{"type": "tool", "name": "N", "description": "d" * 600, "external_references": [{"source_name": "x", "url": "u"}, {"source_name": "mitre-attack", "url": "v"}]}, {"type": "tool", "name": "N"}, {"type": "other", "name": "Q"}]}
    repo = {"items": [{"full_name": "o/r", "description": None, "topics": list("abcdef"), "stargazers_count": 3}]}
    rss = '<rss xmlns:content="c"><channel><item><title>T &amp; u</title><link>http://l</link><description>&lt;p&gt;d&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate><content:encoded>long</content:encoded></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="http://a"/><summary>s</summary><published>2024-01-02T00:00:00Z</published><author><name>me</name></author><category term="c"/></entry></feed>'
    rows = [raw("releases", rel), raw("stix", stix), raw("repo_search", repo), raw(None, rss, "rss"), raw("papers", atom), raw("nobody", {}), raw("news", "not json"), raw("posts", {"data": [{"title": "t", "slug": "s", "content": "c"}]})]
    df = spark.createDataFrame(rows, "ord long, source_name string, language string, type string, api_platform string, xml_text string, error string")
    got = {r.title: r for r in parse.parse_all(df).collect()}
    assert set(got) == {"[o/r] v1", "[MITRE tool] N", "o/r", "T & u", "A", "t"}
    assert got["[o/r] v1"].summary == "Release v1" and got["[o/r] v1"].authors == ["me"]
    assert got["[MITRE tool] N"].url == "v" and len(got["[MITRE tool] N"].summary) == 500
    assert got["o/r"].summary == "o/r | stars: 3 | 语言: 未知 | 标签: a, b, c, d, e"
    assert (got["T & u"].published_date, got["T & u"].summary, got["T & u"].full_body) == ("2024-01-02T02:04:05", "d", "long")
    assert got["A"].authors == ["me"] and got["A"].categories == ["c"] and got["A"].url == "http://a"


def test_feed_dates(spark):
    for value, want in (
        ("Tue, 02 Jan 2024 03:04 GMT", "2024-01-02T03:04:00"), ("02 Jan 2024 03:04:05 EST", "2024-01-02T08:04:05"), ("Tue, 2 Jan 2024 03:04:05 -0130", "2024-01-02T04:34:05"),
        ("Tue, 02 Jan 2024 03:04:05 Z", "2024-01-02T03:04:05"), ("2024-01-02T03:04:05+02:00", "2024-01-02T01:04:05"), ("soon", ""), (None, ""),
    ):
        assert one(spark, parse.feed_date, value)[0] == want, value


def test_rdf_feeds_untyped_rows_and_named_sources(spark):
    rdf = '<rdf:RDF xmlns="http://purl.org/rss/1.0/" xmlns:rdf="r" xmlns:dc="d"><channel><title>c</title></channel><item><title>One</title><link>http://1</link><dc:date>2024-01-02T00:00:00Z</dc:date></item><item><title>Two</title></item></rdf:RDF>'
    news = '{"code": "10000", "data": [{"id": "7", "title": "N"}]}'
    rows = [(0, "s", "en", None, None, rdf, None), (1, "mine", "en", "api", None, news, None), (2, "mine", "en", "api", "drafts", news, None), (3, "else", "en", "api", "nobody", news, None)]
    df = spark.createDataFrame(rows, "ord long, source_name string, language string, type string, api_platform string, xml_text string, error string")
    parse.register_source("mine", parse.news)
    try:
        got = [(r.ord, r.title, r.published_date) for r in parse.parse_all(df).orderBy("ord", "pos").collect()]
    finally:
        parse.NAMED.clear()
    assert got == [(0, "One", "2024-01-02T00:00:00"), (0, "Two", ""), (1, "N", "")]


def test_patterns_behind_a_fold(spark):
    for text in ("the Kelvin \u212aernel", "\u017fcum here", "W\u0130TH", "w\u0131th", "nothing"):
        for word in ("kernel", "scum", "with"):
            assert one(spark, lambda v: match.has_keyword(v, word), text) == one(spark, lambda v: match.has_keyword(v, word, match.folded(v)), text), (text, word)  # noqa: B023


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Fake:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

            class _jsc:  # noqa: N801
                class sc:  # noqa: N801
                    class getCheckpointDir:  # noqa: N801
                        isDefined = staticmethod(lambda: False)

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        scratch.scratch_dir(Fake)
    said = spark.conf.get(scratch.BATCH_SETTING)
    scratch.Scratch(spark, "t").save(spark.range(3))
    assert spark.conf.get(scratch.BATCH_SETTING) == said


def fake_transport(source, headers):
    if source["name"] == "bad":
        raise TimeoutError("slow")
    return "" if source["name"] == "shy" and "User-Agent" not in headers else f"body of {source['name']}"


def test_fetching_source(spark):
    spark.dataSource.register(fetch.FeedSource)
    sources = [{"name": "a", "type": "rss"}, {"name": "bad", "type": "api"}, {"name": "shy", "type": "rss"}, {"name": "off", "enabled": False}]
    assert [fetch.fetch_one(s, fake_transport)[5] for s in sources[:3]] == ["body of a", "", "body of shy"]
    assert fetch.fetch_one(sources[1], fake_transport)[7] == "TimeoutError: slow"
    df = spark.read.format("feeds").option("catalogue", json.dumps(sources)).option("per_task", 1).load()
    assert {r.source_name: r.error for r in df.collect()} == dict.fromkeys(("a", "bad", "shy"), "ConnectionError: no transport is set")


def test_headers_timeouts_and_unknown_platforms(monkeypatch):
    asked = []

    def transport(source, headers):
        asked.append((source["timeout"], headers))
        return "x"

    monkeypatch.setenv("SCHOLAR_API_KEY", "k")
    monkeypatch.setenv("GITHUB_TOKEN", "t")
    for platform in ("scholar", "repo", "stix", None):
        fetch.fetch_one({"name": "s", "type": "api", "api_platform": platform, "url": "http://s"}, transport)
    assert asked == [(30, {"x-api-key": "k"}), (30, {"Accept": "application/vnd.github.v3+json", "Authorization": "Bearer t"}), (60, {}), (30, {})]
    odd = {"name": "s", "type": "api", "api_platform": "odd", "url": "http://s"}
    assert fetch.fetch_one(odd, transport)[7] == "未知 api_platform: odd" and fetch.fetch_one(odd, transport, platforms=("odd",))[5] == "x"
    assert fetch.fetch_one({"name": "s", "type": "api", "url": "http://<key>"}, transport)[7] == "未知 api_platform: "


def rss_of(*entries):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title><link>{u}</link><description>{d}</description></item>" for t, u, d in entries) + "</channel></rss>"


RAW = "ord long, source_name string, language string, type string, api_platform string, xml_text string, error string"


def test_bodies_that_cannot_be_read_are_rows(spark):
    whole = rss_of(("T", "http://t", "d"))
    bodies = [(None, whole), (None, whole[:-12]), (None, "<html>no feed</html>"), (None, "<rss><channel></channel></rss>"), ("news", "{}"), ("news", "{"), ("papers", "<feed>"), ("papers", "<feed></feed>")]
    rows = [(i, "s", "en", "api" if p else "rss", p, b, None) for i, (p, b) in enumerate(bodies)] + [(8, "s", "en", "rss", None, "", None), (9, "s", "en", "rss", None, "<", "failed")]
    got = parse.parse_with_errors(spark.createDataFrame(rows, RAW), F.lit("2024-06-15 12:00:00").cast("timestamp")).collect()
    assert sorted(r.ord for r in got if r.parse_error) == [1, 2, 5, 6]
    assert {r.parse_time for r in got} == {"2024-06-15T12:00:00"} and [r.title for r in got if not r.parse_error and r.ord == 0] == ["T"]


def test_translation_splits_languages(spark):
    rows = [(0, "en", "title", "s" * 600, None, "sum"), (1, "zh", "题", "文", None, "english"), (2, "en", "", "page", "orig", "漢字漢字"), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "ord long, language string, title string, summary string, original_summary string, ai_summary string")
    got = {r.ord: (r.title_zh, r.summary_zh, r.ai_summary_zh) for r in summary.translate_items(df, F.upper).collect()}
    assert got == {0: ("TITLE", "S" * 500, "SUM"), 1: (None, None, "ENGLISH"), 2: ("", "ORIG", "漢字漢字"), 3: (None, None, "")}
    assert one(spark, lambda v: summary.translated(v, F.upper), "a" * 1600, "A" * 1600) == ["A" * 1500, "A" * 1600]


def test_a_run_from_bodies_to_the_report(spark):
    now = F.lit("2024-06-15 12:00:00").cast("timestamp")
    long = "license " * 60
    body = rss_of(("license idiot", "http://1", long), ("license idiot", "http://1", long), ("license idiot!", "http://2", long), ("quiet", "http://3", "nothing"), ("moron license", "http://4", "short"))
    raw = spark.createDataFrame([(0, "s", "en", "rss", None, body, None), (1, "s", "en", "rss", None, "<rss>", None)], RAW)
    pages = spark.createDataFrame([("http://4", "<article>" + "license words of a page " * 20 + "</article>")], "url string, html string")
    following = weekly.steps(pages, now, translate=F.upper)
    rows, failed = weekly.run(raw, following, now)
    got = {r.url: r for r in rows.collect()}
    assert failed == {} and set(got) == {"http://1", "http://4"}
    assert got["http://1"].title == "LICENSE IDIOT" and got["http://4"].fulltext_fetched and got["http://1"].filter_decision == "accepted"

    def broken(items):
        raise RuntimeError("no")

    rows, failed = weekly.run(raw, [(n, broken if n in ("duplicates", "fulltext") else f) for n, f in following], now)
    assert failed == {"duplicates": "RuntimeError: no", "fulltext": "RuntimeError: no"} and sorted(r.url for r in rows.collect()) == ["http://1", "http://1", "http://2", "http://4"]


def test_report_prefers_long_translations_and_details_are_the_last(spark):
    df = spark.createDataFrame([(0, "t", "abcdef", "zz", "Beta", "u", "src1"), (1, "t", "abcdef", "z" * 4, "Beta", "u", "src1")], "ord long, title string, summary string, summary_zh string, category string, url string, source_name string")
    rows = report.report_items(df)
    assert [r.summary for r in rows.orderBy("ord").collect()] == ["abcdef", "zzzz"]
    assert {r.summary for r in report.with_details(report.list_rows(rows), report.details(rows)).collect()} == {"zzzz"}


def test_histogram_has_all_buckets(spark):
    df = spark.createDataFrame([(0, 100, "accepted"), (1, 5, "filtered"), (2, 47, "review")], "ord long, confidence_score int, filter_decision string")
    assert {r.bucket: r.n for r in dashboard.score_histogram(df).collect()} == {**dict.fromkeys(range(11), 0), 0: 1, 10: 1}


def test_rules_from_a_configuration():
    from tidewire.sources.settings import rules_from, strong_texts

    config = {
        "strong": {"weight": 30, "keywords": [{"text": "A", "categories": ["x"]}, {"text": "a", "categories": ["y"]}]},
        "medium": {"weight": 15, "keywords": [{"text": "b", "type": "core"}]},
        "weak": {"weight": 5, "keywords": []},
        "position_multipliers": {"title": 2},
        "thresholds": {"direct_accept": 60},
        "ambiguity_rules": {"B": {"standalone_score": False}},
    }
    rules = rules_from(config)
    assert [(k.text, k.categories) for k in rules.keywords] == [("A", ("y",)), ("a", ("y",)), ("b", ())]
    assert (rules.accept, rules.review, rules.ambiguity["b"].standalone, rules.ratios["B"]) == (60, 45, False, (0.6, 0.3))
    assert strong_texts(config) == ["A", "a"]


def test_feeds_with_namespaces_guids_and_cdata(spark):
    rss = lambda inner: f'<rss version="2.0" xmlns:media="m" xmlns:dc="d"><channel><title>C</title><atom:link href="http://self" rel="self"/><item>{inner}</item></channel></rss>'
    atom = lambda inner: f'<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry>{inner}</entry></feed>'
    bodies = [
        rss("<title>Real</title><media:title>Photo caption</media:title><description>d</description><media:description>m</media:description><link>http://1</link>"),
        rss("<title>A</title><link>http://2</link><atom:link href='http://other' rel='self'/>"),
        rss("<title>B</title><atom:link href='http://3'/><dc:date>2024-01-02T03:04:05Z</dc:date>"),
        rss("<title>C</title><guid>http://4</guid><pubDate>soon</pubDate><dc:date>2024-01-02</dc:date>"),
        rss("<title>D</title><guid isPermaLink='false'>id-5</guid>"),
        rss('<title>E</title><description><![CDATA[set xmlns="abc" and &lt;dc:date>x]]></description><content:encoded><![CDATA[<p>Full</p>]]></content:encoded>'),
        atom("<title type='html'>G &amp; H</title><link rel='self' href='http://s'/><link href='http://7'/><media:title>no</media:title><summary>s</summary><content>long</content><updated>2024-01-02T03:04:05Z</updated>"),
        '<atom:feed xmlns:atom="a"><atom:entry><atom:title>I</atom:title><atom:link href="http://8"/><atom:content>only</atom:content></atom:entry></atom:feed>',
        rss("<title>  </title><link> </link>"),
    ]
    raw = spark.createDataFrame([(i, "s", "en", "rss", None, b, None) for i, b in enumerate(bodies)], RAW)
    got = [(r.title, r.url, r.summary, r.published_date, r.full_body) for r in parse.parse_all(raw).orderBy("ord").collect()]
    assert got == [
        ("Real", "http://1", "d", "", None),
        ("A", "http://2", "", "", None),
        ("B", "http://3", "", "2024-01-02T03:04:05", None),
        ("C", "http://4", "", "2024-01-02T00:00:00", None),
        ("D", "", "", "", None),
        ("E", "", 'set xmlns="abc" and <dc:date>x', "", "Full"),
        ("G & H", "http://7", "s", "2024-01-02T03:04:05", "long"),
        ("I", "http://8", "only", "", None),
        ("", "", "", "", None),
    ]


def test_automaton_finds_what_the_patterns_find(spark):
    rng = random.Random(2)
    pieces = ["apt", "APT", "ab", "CVE-", "cve-", "-", ".", " ", "_", "漏洞", "é", "É", "İ", "ı", "ſ", "K", "k", "s", "i", "x", "9", "²", "\n", "ß", "c++", "Σ", "日"]
    keywords = ("APT", "ab", "CVE-", "漏洞", "k", "s", "is", "-", "c++", "x 9", "été", "É", "i", "ks", "apt ab", "日x", "Ab", "_", "9")
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = df.select("i", *(match.has_keyword(F.col("t"), k).alias(f"k{n}") for n, k in enumerate(keywords))).collect()
    automaton = match.Automaton(keywords)
    assert {r.i: {n for n in range(len(keywords)) if r[f"k{n}"]} for r in want} == {i: automaton.found(t) for i, t in enumerate(texts)}
    assert match.Automaton(("", "a")).found("") == {0} and match.Automaton(()).found("a") == set()


def test_time_of_matching_hardly_grows_with_keywords():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(150)]
    few, many = match.Automaton(["zyxw", *words[:13]]), match.Automaton([*words[:13], *(f"word{i} of rules" for i in range(500)), *(f"{i}号" for i in range(500))])

    def took(automaton):
        began = time.perf_counter()
        for t in texts:
            automaton.found(t)
        return time.perf_counter() - began

    took(many)
    assert min(took(many) for _ in range(3)) < 3 * min(took(few) for _ in range(3))


def test_running_health_of_a_hot_source_is_a_scan_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), rng.randrange(300), seq, rng.random() < rng.choice([0.1, 0.97])) for seq in range(3000)]
    df = spark.createDataFrame(rows, "name string, ts long, seq long, failed boolean").withColumn("ts", F.timestamp_seconds("ts"))
    want, state = {}, {}
    for name, ts, seq, failed in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        fails, n, errors, ok, bad = state.get(name, (0, 0, 0, None, None))
        state[name] = (fails + 1 if failed else 0, n + 1, errors + failed, ok if failed else ts, ts if failed else bad)
        want[seq] = state[name]
    seconds = lambda c: F.unix_timestamp(c).alias(c)
    got = health.running_health(df.repartition(6)).select("seq", "consecutive_failures", "total_fetches", "total_errors", seconds("last_success"), seconds("last_error")).collect()
    assert {r.seq: tuple(r)[1:] for r in got} == want
    assert health.running_health(df.limit(0)).count() == 0
