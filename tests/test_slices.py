"""Arrow batches are worked through in slices of bounded size, with the same values."""

import pyarrow as pa
import pytest

from tidewire.functions import match, slices
from tidewire.operators import extract


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(slices, "SLICE_BYTES", 1000)


def test_slices_are_bounded_and_whole(small):
    texts = pa.array(["x" * 90, None, "", "ä" * 3000] * 50)
    parts = list(slices.slices((texts, texts)))
    assert all(len(a) == 1 or a.nbytes + b.nbytes <= 1000 for a, b in parts)
    assert [t for a, _ in parts for t in a.to_pylist()] == texts.to_pylist()
    assert list(slices.slices((texts.slice(0, 0),))) == []


def test_keywords_are_found_a_slice_at_a_time(small):
    seen = []
    texts = pa.array([f"alpha {k} " + "x" * 40 if k % 2 else None for k in range(400)])
    counted = lambda part: seen.append(len(part)) or [len(t or "") for t in part.to_pylist()]
    made = list(slices.by_slices(iter([texts, texts.slice(0, 0), texts.slice(3, 5)]), counted, pa.int64()))
    assert [len(m) for m in made] == [400, 0, 5] and max(seen) < 100
    found = list(match.batches_found(("alpha",), iter([(texts, texts)]), lambda a, row: sorted(a.found(row[0] or "")), pa.list_(pa.int64())))
    assert [f.to_pylist() for f in found] == [[[0] if k % 2 else [] for k in range(400)]]


def test_pages_are_extracted_a_slice_at_a_time(small, monkeypatch):
    sizes = []
    kept = slices.slices
    monkeypatch.setattr(slices, "slices", lambda columns: (sizes.append(len(p[0])) or p for p in kept(columns)))
    pages = pa.array([f"<article><p>{k} {'words of a page ' * 20}</p></article>" if k % 5 else None for k in range(100)])
    (texts,) = extract.main_text.func(iter([pages]))
    assert max(sizes) < 10 and [t and t.split()[0] for t in texts.to_pylist()] == [str(k) if k % 5 else None for k in range(100)]
