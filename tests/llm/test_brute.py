"""Operators and the pipeline against the plain versions in brute.py, and the cases that the test tables don't hold."""

import hashlib
import random
import re
import time

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.llm import bpe, decontamination, language_id, line_dedup, quality, secrets, sharding, topk, url_filter
from tidewire.llm.common import Scratch


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def labelled_corpus(rng):
    """(doc_id, text, lang), labels and benchmark items: prose of two languages, junk, foul, copied and empty texts."""
    vocabulary = {"en": "the of and that river stone garden winter letter morning carries under bright".split(), "zh": "天 地 玄 黄 宇 宙 洪 荒 日 月 盈 昃".split()}
    docs, labels = [], []
    for i in range(90):
        lang = "zh" if i % 4 == 0 else "en"
        text = "\n".join(prose(rng, rng.randint(6, 14), vocabulary[lang]) for _ in range(rng.randint(1, 5)))
        if i % 9 == 4:
            text = text.replace(" ", " filthy ", 2)
        if i % 11 == 7:
            text = "".join(rng.choice("xqzj#%&{}") for _ in range(60))
        docs.append((i, text, lang))
        labels.append((i, 0 if i % 11 == 7 else 1, 1 if i % 9 == 4 else 0))
    for i in range(90, 110):  # copies, near copies, repeated lines and passages
        of = docs[rng.randrange(60)][1]
        docs.append((i, rng.choice([of, of + " And more.", prose(rng, 12, vocabulary["en"]) + "\n" + of]), "en"))
    items = [(1, prose(rng, 30, vocabulary["en"])), (2, "filthy river"), (3, None), (4, "")]
    docs += [(110, "Before. " + items[0][1] + " After.", "en"), (111, None, "en"), (112, "", None), (113, "   \n ", "en"), (114, "word", None), (114, "word", None)]
    return docs, labels + [(None, 1, 0), (999, 1, 0), (3, None, None)], items


def frame(spark, docs, extra="x"):
    rows = [(i, t, lang, "s", len(t or ""), extra, 5, "p") for i, t, lang in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, found int, _text string")


def prints(spark, docs):
    return [r[0] for r in frame(spark, docs).select(F.xxhash64("text")).collect()]


def test_quality_equals_brute_force_in_place_and_by_joins(spark):
    docs, labels, _ = labelled_corpus(random.Random(1))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute.qualities([(i, t, lang or "", p) for (i, t, lang), p in zip(docs, prints(spark, docs), strict=True)], labels)
    assert sum(r for _, r in want) > 5 and any(p is None for p, _ in want)
    for model_rows in (quality.MODEL_ROWS, 0):
        got = sorted(((r.doc_id, r.perplexity, r.rejected) for r in quality.judge(frame(spark, docs), table, model_rows=model_rows).collect()), key=lambda r: r[0])
        assert [i for i, _, _ in got] == [i for i, _, _ in docs]
        for (_, p, rejected), (q, wanted) in zip(got, want, strict=True):
            assert rejected == wanted and (p is None) == (q is None) and (p is None or abs(p / q - 1) < 1e-9)


def test_characters_of_any_script_are_told_apart():
    keys = quality.keys_of(["\u4e00", "\u5200", "a\u4e00", "a\u5200"])
    assert len(set(keys.tolist())) == 4
    for _, _, found, at in quality.grams(["a\u4e00"]):
        assert found[2].view(np.int64)[at[-1]] == keys[2]


def test_kneser_ney_sums_to_one(spark):
    rng = random.Random(6)
    text = ["".join(rng.choice("abcd ") for _ in range(300)) for _ in range(6)]
    rows = spark.createDataFrame([("en", t) for t in text], "lang string, text string")
    model = quality.models(quality.model_tables(rows, Scratch(spark, "test")), spark.createDataFrame([], "lang string, mark string, value double"))["en"]
    p, chars = brute.kneser_ney(text), sorted(set("".join(text)))
    for context in ("abca", "zzzz", "a ba"):
        seen = []
        for c in [*chars, "q"]:
            for _, _, keys, at in quality.grams([context + c]):
                seen.append(np.exp(model.log_probabilities(keys, at))[-1])
            assert abs(seen[-1] - p(context + c)) < 1e-9
        assert abs(sum(seen) - 1) < 1e-9, context


def chain(spark, docs, labels, items):
    """The pipeline's rows by brute force."""
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(path))}, special_tokens={})
    told = brute.qualities([(i, t, lang or "", p) for (i, t, lang), p in zip(docs, prints(spark, docs), strict=True)], labels)
    kept = [(i, t) for (i, t, _), (_, rejected) in zip(docs, told, strict=True) if not rejected]
    texts = brute.lines([t for _, t in kept])
    kept = [(i, new) for (i, old), new in zip(kept, texts, strict=True) if new == old or re.search(r"\S", new)]
    top = brute.groups([t for _, t in kept])
    first = {}
    for (i, _), g in zip(kept, top, strict=True):
        first.setdefault(g, i)
    kept = [(i, t) for (i, t), g in zip(kept, top, strict=True) if first[g] == i]
    kept = [(i, t) for i, t in kept if not brute.contaminated(t, [x for _, x in items])]
    out = []
    for i, t in kept:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def written(spark, folder, docs, labels, items):
    frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_equals_a_chain_of_brute_force_stages(spark, tmp_path):
    docs, labels, items = labelled_corpus(random.Random(1))
    want = chain(spark, docs, labels, items)
    got = corpus_pipeline.run(spark, written(spark, tmp_path / "a", docs, labels, items))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want
    assert 20 < len(want) < len(docs) - 15
    none = written(spark, tmp_path / "b", [], [], [])
    assert corpus_pipeline.run(spark, none).count() == 0


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    docs, labels, items = labelled_corpus(random.Random(2))
    sf = written(spark, tmp_path / "c", docs[:60], labels, items)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns and 0 < out.where("row = 'x' and found = 5 and _text = 'p'").count() == out.count() <= 60


def test_patience_equals_its_definition():
    """Common head and tail; of lines once on both sides as many as can keep their order; without any a longest common subsequence."""
    rng = random.Random(3)
    for _ in range(600):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for _ in range(2))
        head, tail = brute.common_ends(a, b)
        got = line_dedup.patience(a, b)
        assert got[:head] == [(i, i) for i in range(head)] and got[len(got) - tail :] == [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
        x, y = a[head : len(a) - tail], b[head : len(b) - tail]
        once = {line for line in x if x.count(line) == 1 and y.count(line) == 1}
        inner = [x[i - head] for i, _ in got[head : len(got) - tail]]
        if once:
            assert sum(line in once for line in inner) == brute.longest([line for line in x if line in once], [line for line in y if line in once])
        else:
            assert len(inner) == brute.longest(x, y)


def test_repeated_rows_are_divided_and_any_column_is_carried(spark):
    rows = [(1, "same text")] * 160 + [(i, f"t{i}") for i in range(2, 40)] + [(None, None)] * 3
    df = spark.createDataFrame([(i, t, 1, 2, "r", 7, 8, 9) for i, t in rows], "doc_id long, text string, key int, _key int, row string, tie int, shard int, place int")
    got = sharding.shard_documents(df).toPandas()
    assert len(got) == len(rows) and (got["_key"] == 2).all() and (got["place"] == 9).all() and got["shard"].max() == 15
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_url_parts_and_rules_equal_sql(spark, sf):
    rules = ", ".join(f"('{v}', '{h}', '{p}', {k})" for k, (v, h, p) in enumerate(url_filter.RULES))
    want = duckdb.sql(f"""
      WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM '{sf}/pages.parquet'),
      r(verdict, rh, rp, k) AS (VALUES {rules}),
      m AS (SELECT page_id, rh || rp AS rule, verdict FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, k) = 1)
      SELECT page_id, host, path, rule, verdict FROM u LEFT JOIN m USING (page_id)""").fetchall()
    got = {r.page_id: r for r in url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert len(got) == len(want) and any(rule for *_, rule, _ in want)
    for i, host, path, rule, verdict in want:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and (rule is None or got[i].verdict == verdict) and (got[i].score is None) == (rule is not None)
    empty = spark.createDataFrame([], "page_id long, url string, host string, verdict string")
    assert url_filter.judge(empty).count() == 0


def test_url_regression_on_urls_it_has_not_seen():
    labelled, right = url_filter.LABELLED, 0
    for fold in range(5):
        model = url_filter.fit([x for i, x in enumerate(labelled) if i % 5 != fold])
        held = [(y, *u.partition("/")) for i, (y, u) in enumerate(labelled) if i % 5 == fold]
        scores = url_filter.scores([h for _, h, _, _ in held], [s + p for *_, s, p in held], *model)
        right += sum((s > 0.5) == bool(y) for s, (y, *_) in zip(scores, held, strict=True))
        row, bucket = url_filter.features(["ab.c"], [""])  # by loops
        assert len(row) == len(set(bucket)) == sum(max(0, len("^ab.c$") - n + 1) for n in url_filter.GRAMS)
    assert right / len(labelled) > 0.65
    assert not any(host in u for _, u in labelled for host in ("example.com", "example.net", "example.org"))


def test_language_scores_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [("ab", "a b aab ab"), ("cd", "cd dc cdc c"), ("ef", "ef fe eef"), ("ab", "ba bab")] * 3
    rows = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(texts)], "doc_id long, text string, lang string")
    asked = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 40)))) for i in range(30)] + [(40, None), (41, ""), (42, "12 !"), (43, "ab cd " * 60_000)]
    model = language_id.train(rows)

    def grams(t):
        t = t.lower()
        return [bucket for _, found in language_id.grams([t]) for bucket in found.tolist()]

    langs = sorted({g for g, _ in texts})
    counts = {g: pd.Series([b for x, t in texts if x == g for b in grams(t)]).value_counts() for g in langs}
    for at_once in (language_id.LANGS, 1):  # one pass, or a pass for each language
        got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(asked, "doc_id long, text string"), model, langs_at_once=at_once).collect()}
        for i, t in asked:
            if not t or not re.search("[a-z]", t):
                assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
                continue
            logs = {g: np.log(sum(x == g for x, _ in texts) / len(texts)) + sum(np.log((counts[g].get(b, 0) + 0.5) / (counts[g].sum() + 0.5 * language_id.BUCKETS)) for b in grams(t[:200])) for g in langs}
            if len(t) <= 200:
                best = max(logs, key=logs.get)
                assert got[i].lang_pred == best and abs(got[i].score - 1 / sum(np.exp(v - logs[best]) for v in logs.values())) < 1e-6
    one = language_id.sparse_scores([asked[-1][1]], np.ones((language_id.BUCKETS, 2)))
    n = len(asked[-1][1])
    assert one.tolist() == [[3 * n - 3, 3 * n - 3]]


def test_secret_scan_is_linear_and_tokens_stand_by_themselves():
    for text in ("abc9 " * 200_000, "a1" * 500_000, "http://x.y " + "a" * 1_000_000, "a.b-" * 250_000 + "://q", "://" * 300_000, "token" * 200_000, "abc9xyz0abc9xyz0abc9xyz0 " * 40_000 + "Z"):
        began = time.time()
        secrets.find_spans(text)
        assert time.time() - began < 2, text[:30]
    assert secrets.find_spans("user: alice abc9xyz0abc9xyz0abc9xyz0 Z") == []


def linked_spans(text):
    """Kinds and places of all spans, by comparing all parts of a scope."""
    parts = []
    plain = lambda p: not any(s < p[1] and p[0] < e for s, e, _ in parts)
    for kind, pattern, ok in (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        parts += [(*m.span(), kind) for m in re.finditer(pattern, text, re.A) if ok(m)]
    for kind, pattern, ok in (
        ("ident", secrets.IDENT.pattern, lambda m: True), ("endpoint", r"""[a-z][a-z0-9+.-]*://[^\s"'<>]+""", lambda m: True),
        ("token", r"[A-Za-z0-9+/_=-]+", lambda m: len(m[0]) >= 20 and re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0])),
    ):
        found = [(*m.span(), kind) for m in re.finditer(pattern, text, re.A | (0 if kind == "token" else re.I)) if ok(m)]
        parts += [p for p in found if plain(p)]
    scope = lambda p: len(re.findall(r"\n[^\S\n]*(?=\n)", text[: p[0] + 1]))
    has = lambda p, *kinds: any(q is not p and q[2] in kinds and scope(q) == scope(p) for q in parts)
    secret = ("token", "hex", "assign")
    ok = {
        "token": lambda p: has(p, "ident", "access", "endpoint"), "ident": lambda p: has(p, *secret), "endpoint": lambda p: has(p, *secret) and has(p, "ident", "access"),
    }
    return sorted((s, e, k) for s, e, k in parts if k not in ok or ok[k]((s, e, k)))


def test_linked_parts_equal_brute_force():
    rng = random.Random(5)
    pieces = ["user: alice", "login=bob77", "Abc9Xyz0Abc9Xyz0Abc9Xyz0", "https://h.example/x?y=1", "ftp://z", "AKIA" + "B" * 16, "f" * 24, "password: hunter22", "some words", "abc9xyz0abc9xyz0abc9xyz0", "a+b://c://d"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "\n", "\n\n", "\n \n", ", "]) for _ in range(rng.randint(1, 9)))
        assert sorted((s, e, k) for k, s, e, *_ in secrets.find_spans(text)) == linked_spans(text), text


@pytest.mark.parametrize("seed", range(6))
def test_long_rows_merge_as_the_matrix_does(seed):
    """On random vocabularies, with and without tokens that form a pair of lower rank than their own."""
    rng = random.Random(seed)
    tokens, letters = [bytes([b]) for b in range(256)], b"abc"
    for _ in range(60):
        new = rng.choice(tokens[97:100] + tokens[256:]) + rng.choice(tokens[97:100] + tokens[256:])
        if new not in tokens:
            tokens.append(new)
    tail = tokens[256:]
    if seed % 2:
        rng.shuffle(tail)
    codec = bpe.Codec(tokens[:256] + tail)
    if seed % 2:
        assert codec.pairs.early
    for _ in range(60):
        piece = bytes(rng.choice(letters) for _ in range(rng.randint(2, 90)))
        ids = codec.of_byte[np.frombuffer(piece, np.uint8)]
        matrix = [x for _, _, x in codec.merge_matrix(ids[None, :].copy(), np.array([0]))][0]
        assert codec.merge_long(ids.copy()).tolist() == matrix.tolist()


def test_depth_of_lists_on_the_real_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = rows.count()
    got = topk.top_k(rows, rows.where("vec_id % 50 = 0"))
    assert 0 < got.agg(F.max("list_depth")).first()[0] <= n
    skewed = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(np.random.default_rng(0).pareto(1.0, (1500, 4)))], "vec_id long, embedding array<double>")
    assert topk.top_k(skewed, skewed.where("vec_id = 7")).agg(F.max("list_depth")).first()[0] < 1500
    wide = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0, 3.0]), (50, [1.0, 1.0]), (100, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id): r.score for r in topk.top_k(wide, wide.where("vec_id >= 50")).collect()}[100, 1] == 6 * 256 * 256


def test_many_occurrences_are_searched_in_parts(spark, monkeypatch):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(8, 60)))) for i in range(6)]
    tests = decontamination.Tests(items)
    docs = [decontamination.words(" ".join(rng.choice("ab") for _ in range(400))) for _ in range(3)]
    want = decontamination.scan(tests, docs)
    for most in (50, 1):
        monkeypatch.setattr(decontamination, "MOST", most)
        assert decontamination.scan(tests, docs) == want
    monkeypatch.undo()
    df = spark.createDataFrame([(1, "a b " * 30, "x"), (2, None, "y"), (3, "c", "z")], "doc_id long, text string, found string")
    for block in (decontamination.BLOCK_BYTES, 20):
        got = {r.row.doc_id: (r.n_hit, r["items"]) for r in decontamination.contamination(df, spark.createDataFrame([*items, (9, "c")], "item_id long, text string"), block_bytes=block).collect()}
        assert got[2] == (0, []) and got[3] == (1, ["9"])
