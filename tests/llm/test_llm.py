"""The training-data operators on small tables: edge cases, and brute-force versions where SQL can't express them."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from tidewire.llm import bpe, decontamination, entry, language_id, line_dedup, neardup, quality, secrets, sharding, topk, url_filter
from tidewire.llm.components import components
from tidewire.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, row string, _text string"


def docs(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, 3, "r", "x") for i, t in zip(ids, texts)], DOCS)


ODD = [None, "", "   \n ", "word", "a b", "x " * 30_000, "same text here now", "same text here now", "日本語 テキスト ①", "\U0001f600 emoji\x00nul"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(name, spark, sf):
    assert_same(entry.queries()[name], entry.oracle_sql()[name], spark, sf)


def test_every_operator_takes_odd_and_empty_tables(spark):
    for rows in (docs(spark, ODD), docs(spark, ODD, [None, 1, 1, 2, 2, 3, 4, 4, 5, 6]), docs(spark, [])):
        n = rows.count()
        items = spark.createDataFrame([(1, "word"), (None, None), (2, "same text")], "item_id long, text string")
        path, pattern = bpe.public_vocabulary()
        labels = spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, None, None)], "doc_id long, quality int, toxic int")
        assert decontamination.contamination(rows, items).count() == n
        assert neardup.near_duplicates(rows).count() == n
        assert line_dedup.dedup_lines(rows).count() == n
        assert bpe.decode(bpe.encode(rows, path, pattern), path).where("decoded is not null").count() == n
        assert sharding.shard_documents(rows).select("shard", "slot").distinct().count() == n
        assert quality.judge(rows, labels).count() == n
        assert language_id.predict(rows, language_id.train(rows)).count() == n
        assert secrets.find_secrets(rows).count() == n


def test_topk_ties_bad_vectors_and_early_stop(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [-1.0]), (7, []), (None, [1.0, 1.0]), (50, [0.001, -0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 81920), (0, 2, 81920), (0, 7, 0), (50, 6, 0), (50, 7, 0), (50, 0, -128)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    rng = np.random.default_rng(0)
    x = np.floor(rng.pareto(1.0, (2000, 4)) * 50)
    stops = {d for *_, d in topk.search(np.arange(2000), topk.Lists(x), np.array([-1]), np.array([[3.0, 1.0, 2.0, 1.0]]), 5)}
    best = [(-s, i) for s, i in sorted(zip(-(x @ [3, 1, 2, 1]), range(2000)))[:5]]
    assert [(s, i) for _, i, s, _ in topk.search(np.arange(2000), topk.Lists(x), np.array([-1]), np.array([[3.0, 1.0, 2.0, 1.0]]), 5)] == best
    assert max(stops) < 2000


def test_windows_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdef")
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 10, 14])))) for i in range(12)] + [(0, "a b"), (7, "A, B")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) + " " + rng.choice(items)[1].upper() for _ in range(40)]
    got = decontamination.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_bytes=60).collect()
    for r in got:
        w, hit, of = [x.decode() for x in decontamination.words(r.row.text)], set(), set()
        for i, t in items:
            v = [x.decode() for x in decontamination.words(t)]
            n = min(10, len(v))
            for k in range(len(v) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        of.add(str(i))
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(of))
        assert sum(s.end - s.start for s in r.spans) == len(hit)


def test_near_duplicates_equal_brute_force_with_a_hot_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(60)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(t))
    texts += ["one", "ONE", "", None, "one two", "other words entirely"] + texts[:3]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, texts), words=2).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(links, Scratch(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_patience_alignment():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert line_dedup.patience(list("abcx"), list("zabc")) == [(0, 1), (1, 2), (2, 3)]


def test_gaps_without_unique_lines_are_aligned_whole():
    assert len(line_dedup.patience(list("xyxy"), list("yxyx"))) == 3
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abc") * 2 for _ in range(rng.randint(0, 14))] for _ in range(2))
        a, b = a + a[::-1], b[::-1] + b  # each line more than once
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x == y))
        for got in (line_dedup.longest(a, b), line_dedup.patience(a, b)):
            assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [f"line {i} with some words of its own" for i in range(8)] + ["short", "", "  "]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.5 else f"only {k} {j} is here once" for j in range(rng.randint(1, 9))) for k in range(30)]
    first = {}
    for k, t in enumerate(texts):
        for x in t.split("\n"):
            if x.strip():
                first.setdefault(x.strip(), k)
    want = {}
    for k, t in enumerate(texts):
        lines, gone = t.split("\n"), []
        for a in {first[x.strip()] for x in lines if x.strip()} - {k}:
            mine = [(p, x.strip()) for p, x in enumerate(lines) if x.strip() and first[x.strip()] == a]
            theirs = [x.strip() for x in texts[a].split("\n") if x.strip() in {m for _, m in mine}]
            gone += [(mine[j][0], len(mine[j][1].split())) for _, j in line_dedup.patience(theirs, [m for _, m in mine])]
        cut = set(line_dedup.blocks_to_delete(gone, 5))
        want[k] = "\n".join(x for p, x in enumerate(lines) if p not in cut)
    got = {r.row.doc_id: r.row.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got == want and any(got[k] != t for k, t in enumerate(texts))


def every_alignment(texts):
    """The texts without the lines aligned with any earlier text, by brute force."""
    rows, out = [[(p, x.strip()) for p, x in enumerate(t.split("\n")) if x.strip()] for t in texts], []
    for k, t in enumerate(texts):
        gone, rank = [], {p: r for r, (p, _) in enumerate(rows[k])}
        for before in rows[:k]:
            both = {x for _, x in before} & {x for _, x in rows[k]}
            mine, theirs = [(p, x) for p, x in rows[k] if x in both], [x for _, x in before if x in both]
            gone += [(rank[mine[j][0]], len(mine[j][1].split())) for _, j in line_dedup.patience(theirs, [x for _, x in mine])]
        cut = {rows[k][r][0] for r in line_dedup.blocks_to_delete(gone, 5)}
        out.append("\n".join(x for p, x in enumerate(t.split("\n")) if p not in cut))
    return out


def test_lines_equal_alignment_with_every_earlier_document(spark):
    a, b = "first line of five words", "second line of five words"
    texts = [f"{b}\n{a}", "nothing in common here at all", f"{a}\n{b}", f"{a}\n{b}\nan own line of many words"]
    got = {r.row.doc_id: r.row.text for r in line_dedup.dedup_lines(docs(spark, texts), whole=True).collect()}
    assert got[3] == "an own line of many words" and list(got[k] for k in range(4)) == every_alignment(texts)
    rng = random.Random(8)
    pool = [f"line {i} with some words of its own" for i in range(6)] + ["short", "two words"]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.8 else f"only {k} {j} is here once" for j in range(rng.randint(1, 8))) for k in range(60)]
    got = {r.row.doc_id: r.row.text for r in line_dedup.dedup_lines(docs(spark, texts), whole=True).collect()}
    assert [got[k] for k in range(60)] == every_alignment(texts)


def test_blank_lines_do_not_end_a_block(spark):
    verse = [f"verse {w}\n" for w in "one two three four five six".split()]
    texts = ["\n".join(verse), "own line here\n" + "\n \n".join(verse) + "\n\nother own line"]
    got = {r.row.doc_id: r.row.text for r in line_dedup.dedup_lines(docs(spark, texts), whole=True).collect()}
    assert got[0] == texts[0] and got[1].split() == "own line here other own line".split()
    assert [got[0], got[1]] == every_alignment(texts)


def test_bpe_equals_the_library(spark):
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(path))}, special_tokens={})
    texts = [*ODD, "aaa" * 400, " " * 700 + "x", "don't <|endoftext|> 123456", "th" * 900, "".join(random.Random(1).choice("ethains") for _ in range(3000))]
    for r in bpe.digests(bpe.decode(bpe.encode(docs(spark, texts), path, pattern), path)).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_shards_are_balanced_and_slots_gapless_with_a_hot_text(spark):
    texts = ["same " * 20] * 400 + [f"t{i} " * (i % 50) for i in range(800)]
    got = sharding.shard_documents(docs(spark, texts)).select("doc_id", "size", "shard", "slot").toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 2 * got["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])


def test_url_rules_and_classifier(spark):
    urls = ["http://A.Example.com/en/1", "http://example.com/en/77?q", "x://b.example.net/de/8", "x://b.example.net/de/7", "nothing", None, "http://org/es/#x", "http://www.casino-bets.example.net/fr/1", "http://blog.thth.example.net/fr/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == ("a.example.com", "/en/1", "com/en/", "block") and got[1] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert got[2][2:] == ("example.net/de/8", "block") and got[3][2:] == ("net/de/", "allow") and got[6][2:] == ("org/es/", "block")
    assert got[4] == got[5] == ("", "", None, "allow") and got[7][3] == "block" and got[8][3] == "allow"


def test_language_of_held_out_documents(spark, sf):
    got = entry.queries()["op9_language"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    got = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    good = got[(got.quality == 1) & (got.toxic == 0)]
    assert good.rejected.mean() < 0.03 and got[got.quality == 0].rejected.mean() > 0.7


def test_quality_rejects_toxic_documents_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/documents.parquet").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)))
    got = quality.judge(rows, spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    got = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id").merge(rows.select("doc_id", "fold").toPandas(), on="doc_id")
    unseen = got[got.fold == 1]
    toxic, good = unseen[(unseen.quality == 1) & (unseen.toxic == 1)], unseen[(unseen.quality == 1) & (unseen.toxic == 0)]
    print(toxic.groupby("lang").rejected.agg(["mean", "size"]), good.rejected.mean(), got[got.quality == 0].rejected.mean())
    assert toxic.rejected.mean() > 0.7 and good.rejected.mean() < 0.03


def test_secrets_equal_brute_force(spark):
    for t in [*ODD, 'token = "abcdef1"', "password: abc", "AKIA" + "B" * 16 + " AKIAX", "f" * 23 + "g" + "0" * 24, "Api_Key='xxxxxxx' api-key=yyyyyyy secret=token:abcdefgh", "\u017fecret=abcdefg"]:
        text, want = t or "", []
        for kind, pattern, ok in (
            ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
            ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
        ):
            want += [(kind, *m.span()) for m in re.finditer(pattern, text, re.A) if ok(m)]
        assert sorted(s[:3] for s in secrets.find_spans(t) if s[0] in secrets.KINDS[:3]) == sorted(want)
    weak = "user_name: alice\nkey Abc9Xyz0Abc9Xyz0Abc9Xyz0"
    assert Counter(s[0] for s in secrets.find_spans(weak)) == {"ident": 1, "token": 1}
    assert secrets.find_spans("key Abc9Xyz0Abc9Xyz0Abc9Xyz0") == [] and secrets.find_spans("user_name: alice") == []
    assert secrets.find_spans("user_name: alice\n\nAbc9Xyz0Abc9Xyz0Abc9Xyz0") == []


def test_parts_of_a_scope_meet_at_any_distance():
    far = "user_name: alice\n" + "some words\n" * 100 + "Abc9Xyz0Abc9Xyz0Abc9Xyz0"
    assert [s[0] for s in secrets.find_spans(far)] == ["ident", "token"] and secrets.find_spans(far, 400) == []


def test_lines_aligned_with_every_earlier_document_take_odd_and_empty_tables(spark):
    for rows in (docs(spark, ODD), docs(spark, ODD, [None, 1, 1, 2, 2, 3, 4, 4, 5, 6]), docs(spark, [])):
        got = line_dedup.dedup_lines(rows, whole=True)
        assert got.count() == rows.count() and got.select("row.*").columns == rows.columns
    first, later = "one line of five words\nalone here", "one line of five words\nother"
    kept = {r.row.doc_id: r.row.text for r in line_dedup.dedup_lines(docs(spark, [first, later, None, ""]), whole=True).collect()}
    assert kept == {0: first, 1: "other", 2: None, 3: ""}
