"""Sentences of many texts at once: pairs and ranks as of each text alone, in blocks of bounded size."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidewire.operators import summary

KIND = pa.list_(pa.list_(pa.string()))


def texts(n: int = 60) -> list:
    r = random.Random(3)
    return [None if k % 13 == 0 else [sorted({f"w{min(r.randrange(30), r.randrange(30))}" for _ in range(r.randrange(7))}) for _ in range(r.randrange(25))] for k in range(n)]


@pytest.mark.parametrize("cells", [2_000_000, 40, 1])
def test_pairs_are_those_of_each_text(monkeypatch, cells):
    monkeypatch.setattr(summary, "CELLS", cells)
    given = texts()
    every, got = summary.Sentences(pa.array(given, KIND).slice(1)), {}
    for i, j, weights in every.pairs():
        assert len(i) <= max(cells, 25)
        for a, b, w in zip(i, j, weights, strict=True):
            assert every.text[a] == every.text[b] and (key := (every.text[a], every.place[a], every.place[b])) not in got
            got[key] = w
    want = {(t, i, j): len(a & b) / len(a | b) for t, s in enumerate(given[1:]) for j, b in enumerate(map(set, s or [])) for i, a in enumerate(map(set, s[:j])) if a & b}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_ranks_and_extracts_are_those_of_each_text(monkeypatch):
    given = texts()
    sentences = [None if s is None else [f"{k}.{i}; " for i in range(len(s))] for k, s in enumerate(given)]
    every = summary.Sentences(pa.array(given, KIND))
    rank = summary.text_ranks(every)
    for k, s in enumerate(given):
        if s:
            assert np.allclose(rank[every.text == k], summary.text_rank([set(w) for w in s]), atol=1e-12, rtol=0)
    want = [summary.best_sentences(s, [set(x) for x in w]) if s is not None and len(s) > 3 else None for s, w in zip(sentences, given, strict=True)]
    columns = pa.array(sentences, pa.list_(pa.string())), pa.array(given, KIND)
    assert summary.extracts(*columns) == want
    monkeypatch.setattr(summary, "KEPT", 10)
    assert summary.text_ranks(every) is None and summary.extracts(*columns) == want
    assert summary.extracts(*(c.slice(0, 1) for c in columns)) == [None]


def test_sentences_are_not_exchanged(spark):
    docs = spark.createDataFrame([(1, "The quick fox jumps over the fence. The quick fox sleeps under the tree."), (None, "The quick fox jumps over. The quick fox sleeps under."), (2, None)], "ord long, text string")
    out = summary.sentence_similarity(docs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.ord, r.i, r.j) for r in out.collect()] == [(1, 0, 1)]
