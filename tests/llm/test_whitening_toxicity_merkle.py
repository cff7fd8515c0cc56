"""Operators 11 to 13 against plain versions of their definitions, and their odd cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import merkle, toxicity, whitening
from tidewire.llm.common import Scratch

VECTORS = "vec_id long, embedding array<double>, x int, whitened string, n int, pos int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "w", 2, 3) for i, v in rows], VECTORS)


def plain_whitening(rows, components=8):
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in fine), default=0)
    x = [[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (width - len(v)) for _, v in fine]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x]).reshape(n, width)
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1][:components], q[:, ::-1][:, :components]
    return [i for i, _ in fine], deviation, centred @ q / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_equals_numpy_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(300, 12)) * rng.uniform(0.1, 2, 12))]
    rows += [(300, None), (301, [float("nan")] * 12), (302, [None] * 12), (303, [float("inf")] * 12), (None, [0.5] * 12), (7, rows[7][1]), (304, [1.0, -1.0]), (305, [])]
    done, model, error = whitening.whiten(vectors(spark, rows).repartition(70))
    ids, deviation, whitened, explained = plain_whitening(rows)
    assert model.n == len(ids) == 304 and error < 1e-9
    assert np.allclose(model.values / model.trace, explained, rtol=1e-9)
    got = done.toPandas()
    key = lambda i, d, w: (-1 if i is None or i != i else i, d, round(abs(w[0]), 6))
    mine = sorted((key(i, d, w), w) for i, d, w in zip(got.vec_id, got.deviation, got.whitened.map(list)))
    want = sorted((key(i, d, w), w) for i, d, w in zip(ids, deviation, whitened.tolist()))
    assert [k for k, _ in mine] == [k for k, _ in want]
    a, b = np.array([w for _, w in mine]), np.array([w for _, w in want])
    signs = np.sign((a * b).sum(axis=0))
    assert np.allclose(a * signs, b, atol=1e-8)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, []), (2, [])], [(1, None)], [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])]])
def test_whitening_of_few_and_flat_rows(spark, rows):
    done, model, error = whitening.whiten(vectors(spark, rows))
    got = done.collect()
    fine = [v for _, v in rows if v is not None]
    assert len(got) == model.n == len(fine) and error < 1e-9
    live = int(model.live.sum())
    assert live == (1 if len(fine) == 3 else 0)
    for r in got:
        assert len(r.whitened) == len(fine[0]) and all(w == 0 for w in r.whitened[live:])


def test_whitening_is_exact_beyond_longs_in_between(spark):
    rows = [(i, [float(2**17 * i), -3.0]) for i in range(5)]
    done, model, _ = whitening.whiten(vectors(spark, rows))
    want = dict(zip(*plain_whitening(rows, 2)[:2]))
    assert {r.vec_id: r.deviation for r in done.collect()} == want and max(want.values()) > 2**53
    done, model, _ = whitening.whiten(vectors(spark, [(1, [1e300]), (2, [-1e300]), (3, [0.0])]))
    assert [int(t) for t in model.total] == [300_000] and {r.deviation for r in done.collect()} == {2**63 - 1, 0}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40])
def test_eigen_solver(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.eye(n), np.zeros((n, n)), np.diag(np.arange(n, dtype=float)), np.ones((n, n)) * 1e-200):
        a = a @ a.T if a.any() and a[0, 0] != 1e-200 else a
        values, q = whitening.eigen(a)
        size = max(np.abs(a).max(), 1e-300)
        assert np.allclose(values / size, np.linalg.eigvalsh(a)[::-1] / size, atol=1e-12) and np.allclose(q @ q.T, np.eye(n), atol=1e-12)
        assert np.allclose(q @ a @ q.T / size, np.diag(values) / size, atol=1e-11)


def test_merged_moments_equal_those_of_one_stream():
    x = np.random.default_rng(0).integers(-1000, 1000, (50, 4))
    one, merged = whitening.Moments(7), whitening.Moments(7)
    one.add(np.hstack([x[:, :3], np.r_[np.full(20, 7), x[20:, 3]][:, None]]))
    for rows in (x[:20, :3], x[20:21], x[21:]):
        part = whitening.Moments(7)
        part.add(rows)
        merged.merge(part.n, part.total, part.mean, part.products)
    assert merged.n == 50 and merged.total.tolist() == one.total.tolist()
    assert np.allclose(merged.mean, one.mean) and np.allclose(merged.products, one.products)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, fanout):
    """The root, and each node's siblings as (before, after)."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(k, min(k + fanout, len(nodes))) for k in range(0, len(nodes), fanout)]
        for run in runs:
            for p in run:
                for i in owners[p]:
                    proofs[i].append((tuple(nodes[q] for q in run if q < p), tuple(nodes[q] for q in run if q > p)))
        nodes, owners = [H(*(nodes[p] for p in run)) for run in runs], [sum((owners[p] for p in run), []) for run in runs]
    return nodes[0], proofs


def plain_manifest(rows, fanout):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    first = lambda v: (v is not None, v if v is not None else 0)
    leaves = {}
    for i, text, lang, source, n in rows:
        shown = n + 1 if n is not None and i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n
        leaf, other = (H(*map(part, (i, source, lang, k, text))) for k in (n, shown))
        leaves.setdefault(lang, []).append((first(i), leaf, i, other))
    groups = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[1] for x in sorted(leaves[g], key=lambda x: x[:2])], fanout) for g in groups}
    root, upper = plain_tree([trees[g][0] for g in groups], fanout)
    out = []
    for g, over in zip(groups, upper):
        for (_, leaf, i, other), lower in zip(sorted(leaves[g], key=lambda x: x[:2]), trees[g][1]):
            node = other
            for before, after in lower + over:
                node = H(*before, node, *after)
            out.append((i, leaf, trees[g][0], root, H(*(x for b, a in lower + over for x in b + a)), node, node == root))
    return sorted(out, key=str)


MANIFEST = "doc_id long, text string, lang string, source string, n_chars long, g string, idx int, node string, before string, of string, bucket int"


def manifest_rows(spark, rows, fanout, block):
    docs = spark.createDataFrame([(*r, "g", 1, "n", "b", "o", 2) for r in rows], MANIFEST)
    shown = merkle.leaf_of(*[F.when(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)), F.col("n_chars") + 1).otherwise(F.col("n_chars")) if c == "n_chars" else docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")])
    done = merkle.manifest(docs, "lang", ["doc_id", "source", "lang", "n_chars", "text"], shown=shown, fanout=fanout, block=block)
    got = done.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(done).alias("p"), merkle.folded(done, done["shown_leaf"]).alias("f"))
    return sorted((tuple(r) + (r.f == r.root,) for r in got.collect()), key=str)


@pytest.mark.parametrize(("fanout", "block"), [(2, 1024), (2, 4), (3, 9)])
def test_manifest_equals_a_plain_tree(spark, fanout, block):
    rng = random.Random(fanout * block)
    rows = [(rng.randrange(60), rng.choice([None, "", "é\x00日", "x" * 50_000, "t"]), rng.choice(["en", "en", "en", "de", "é", None, ""]), rng.choice(["s", None]), rng.choice([5, None])) for _ in range(90)]
    rows += [(None, "no id", "en", "s", 1), (3, "same", "en", "s", 4)] + [(3, "same", "en", "s", 4)] * 6 + [(1, "alone", "fr", "s", 5)]
    assert manifest_rows(spark, rows, fanout, block) == plain_manifest(rows, fanout)


def test_manifest_of_one_group_one_row_and_none(spark):
    for rows in ([(1, "a", "en", "s", 1)], [(i, "a", None, "s", 1) for i in range(5)]):
        assert manifest_rows(spark, rows, 2, 2) == plain_manifest(rows, 2)
    assert manifest_rows(spark, [], 2, 2) == []


DOCS = "doc_id long, text string, lang string, toxic string, fold int, features int, score int"


def toxic_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, 3) for i, t in rows], DOCS)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


WORDS = [a + b for a in "ka lo mi ne su ta re vo".split() for b in "ran lin dor mes tul".split()]


def corpus(rng, n=160):
    rows, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randint(20, 60), WORDS)
        if i % 4 == 1:  # forms of one root, and a plain word
            foul = rng.choice([["snurk"], ["grobz" + w for w in WORDS]])
            text = " ".join(w if rng.random() > 0.1 else rng.choice(foul) for w in text.split()) + " " + rng.choice(foul)
        rows.append((i, text))
        labels.append((i, int(i % 4 == 1)))
    return rows, labels


def test_toxicity_separates_unseen_texts(spark):
    rng = random.Random(1)
    rows, labels = corpus(rng)
    told = spark.createDataFrame(labels + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(toxic_docs(spark, rows), told)
    fresh, truth = corpus(rng)
    fresh[1] = (1, prose(rng, 30, WORDS) + " you grobzelwick grobzelmar")  # a form that no text had, by its head
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "日本語 \U0001f600"), (1004, "x" * 600_000), (None, "snurk"), (1005, "snurk snurk"), (1005, "lolin")]
    got = {}
    for r in model.score(toxic_docs(spark, fresh + odd)).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert all(0 <= s <= 1 for v in got.values() for s in v) and sum(map(len, got.values())) == len(fresh) + len(odd)
    right = sum((got[i][0] >= 0.7) == bool(t) for i, t in truth)
    assert right >= 0.95 * len(truth) and got[1][0] >= 0.7
    assert all(got[i][0] < 0.7 for i in range(1000, 1005)) and got[1000] == got[1001]
    assert model.score(toxic_docs(spark, [])).count() == 0


def test_toxicity_without_labels_or_with_one_class(spark):
    docs = toxic_docs(spark, [(1, "a b c"), (2, None)])
    for labels, score in (([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1)], 1.0), ([(None, 1), (3, 1), (1, None)], 0.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.score for r in model.score(docs).collect()] == [score, score]
    assert toxicity.fit(toxic_docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).constant == 0.0


def test_copies_teach_once_and_the_sample_is_bounded(spark):
    rows = [(i, "one two three four snurk") for i in range(50)] + [(i, " ".join(WORDS[(i * k) % 40] for k in (1, 3, 7, 9))) for i in range(50, 80)]
    docs = toxic_docs(spark, rows).select("doc_id", "text")
    labels = spark.createDataFrame([(i, int(i < 50)) for i in range(80)], "doc_id long, toxic int")
    known = toxicity.sampled(docs, labels, Scratch(spark, "sample"), 1000)
    assert sorted((r.toxic, r["count"]) for r in known.groupBy("toxic").count().collect()) == [(0, 30), (1, 1)]
    assert "snurk" not in toxicity.lexicons(known)[-1]
    assert toxicity.sampled(docs, labels, Scratch(spark, "sample"), 7).count() <= 7


def test_features_by_hand():
    lexicon = {"snurk": 5.0, "grob*": 4.5, "mild": 2.5}
    of = lambda text: dict(zip(toxicity.NAMES, toxicity.Features(lexicon).of(text), strict=True))
    f = of("You SNURK! a grobling is mild b c d e f g h i j snurk")
    assert f["length"] == math.log1p(16) and f["strong"] == pytest.approx(2 / 16) and f["heads"] == pytest.approx(1 / 16) and f["light"] == pytest.approx(3 / 16)
    assert f["near_you"] == pytest.approx(2 / 16) and f["largest"] == 5.0 and f["different"] == math.log1p(2) and f["hits"] == math.log1p(3)
    text = "You SNURK! a grobling is mild b c d e f g h i j snurk"
    letters = sum(c.isalpha() for c in text)
    assert f["capitals"] == pytest.approx(6 / letters) and f["capital_runs"] == pytest.approx(4 / letters) and f["shouting"] == f["punctuation"] == pytest.approx(1 / len(text))
    assert of("sn3rk 5nurk s.n.u.r.k s*urk nothing")["unmasked"] > 0
    assert of("soooo")["stretched"] == pytest.approx(2 / 5)
    long = "snurk " * 200_000  # over a piece
    assert of(long)["strong"] == 1.0 and of(None) == of("") and of("x" * 700_000)["length"] > 0


def test_held_out_documents_on_the_test_table(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op12_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got[got.toxic == 1].predicted == 1).mean() >= 0.7 and (got[got.toxic == 0].predicted == 0).mean() >= 0.97
