"""Operator 2: benchmark decontamination with suffix arrays over the training text.

Documents are read in shards of about ``SHARD_BYTES`` of text (a longer document is a shard of its own). A
shard's words become ids of the benchmark's vocabulary, 0 for every other word; its suffix array holds the
suffixes that can begin a window, that is, those at which at least as many known words follow each other as the
shortest window has. Every benchmark suffix that is long enough is searched by binary search, narrowing its
range of the array word by word to the window's length; all positions in the range are occurrences.
Occurrences that continue each other give the longest verbatim matches and where they lie. Nothing is shuffled.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text (one item if it is longer); each further
block is one more pass over the documents.

Defined cases: null or wordless text has no words and is clean; items without words have no window; identical
items count each by its id, repeated ids once, items without an id mark words but aren't listed; every
row of documents is judged by itself, so repeated rows repeat; an empty benchmark leaves all clean; other columns
are carried whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices, spread
from .common import LOWER, Scratch, table, utf8

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
#: Occurrences times items in a shard above which its documents are searched in two halves.
MOST = 8_000_000
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
TO_WORDS = bytes(b if b in _WORD else 32 for b in LOWER)

FOUND = "n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: int, end: int>>, longest: int"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", SPANS), ("longest", pa.int32())])


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII."""
    return utf8(text).translate(TO_WORDS).split()


class Tests:
    """A block of benchmark items: vocabulary, distinct windows and which items have them where."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        at: dict[bytes, int] = {}
        tokens: list[np.ndarray] = []
        owners: list[tuple[int, int, int]] = []
        for k, (_, text) in enumerate(items):
            got = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            ids = np.array(got, np.int32)
            w = min(window, len(ids))
            for i in range(len(ids) - w + 1 if w else 0):
                key = ids[i : i + w].tobytes()
                if key not in at:
                    at[key] = len(tokens)
                    tokens.append(ids[i : i + w])
                owners.append((at[key], k, i))
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.shortest = int(self.lens.min()) if len(tokens) else 0
        self.longest = int(self.lens.max()) if len(tokens) else 0
        self.tokens = np.zeros((len(tokens), self.longest), np.int32)
        for r, t in enumerate(tokens):
            self.tokens[r, : len(t)] = t
        own = np.array(sorted(owners), np.int64).reshape(-1, 3)
        self.owner_item, self.owner_at = own[:, 1], own[:, 2]
        self.owners = np.bincount(own[:, 0], minlength=len(tokens))
        self.first_owner = np.cumsum(self.owners) - self.owners


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` words (or more) from there, by prefix doubling."""
    _, rank = np.unique(tokens, return_inverse=True)
    k = 1
    while k < depth and rank.max(initial=0) + 1 < len(rank):
        after = np.zeros(len(rank), np.int64)
        after[:-k] = rank[k:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 2) + after, return_inverse=True)
        k *= 2
    return np.argsort(rank, kind="stable")


def bound(tokens: np.ndarray, order: np.ndarray, j: int, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all ``want`` at once, each in its range of the suffix array, by the j-th word."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        there = tokens[np.minimum(order[mid] + j, len(tokens) - 1)]
        up = there <= want[open_] if right else there < want[open_]
        lo[open_[up]] = mid[up] + 1
        hi[open_[~up]] = mid[~up]
    return lo


def search(tests: Tests, tokens: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of the suffix array that begins with each window."""
    lo, hi = np.zeros(len(tests.lens), np.int64), np.full(len(tests.lens), len(order), np.int64)
    for j in range(tests.longest):
        on = np.flatnonzero((tests.lens > j) & (lo < hi))
        want = tests.tokens[on, j]
        first = bound(tokens, order, j, want, lo[on], hi[on], False)
        hi[on] = bound(tokens, order, j, want, first, hi[on], True)
        lo[on] = first
    return lo, hi


def runs(tests: Tests, win: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Item, first word and number of words of the longest verbatim matches; win, at: the windows that occur, and where.

    An occurrence continues another of the item if both lie one word further. Items are taken in parts of ``MOST`` occurrences at
    most; an item that has more by itself is followed place by place.
    """
    each = np.bincount(tests.owner_item, np.bincount(win, minlength=len(tests.lens))[np.repeat(np.arange(len(tests.lens)), tests.owners)], len(tests.items))
    part = np.where(each > MOST, -1 - np.arange(len(each)), np.cumsum(np.where(each > MOST, 0, each)) // MOST).astype(np.int64)
    of_window = np.repeat(np.arange(len(tests.lens)), tests.owners)
    for some in np.unique(part[each > 0]):
        mine = np.flatnonzero(part[tests.owner_item] == some)
        if some < 0:
            yield followed(tests, int(-1 - some), mine, of_window[mine], win, at)
            continue
        owners = np.bincount(of_window[mine], minlength=len(tests.lens))
        first_owner = np.cumsum(owners) - owners
        k = owners[win]
        own = mine[spread(first_owner[win], k)]
        item, i, p, size = tests.owner_item[own], tests.owner_at[own], np.repeat(at, k), np.repeat(tests.lens[win], k)
        turn = np.lexsort((i, p - i, item))
        item, i, p, size = item[turn], i[turn], p[turn], size[turn]
        new = np.ones(len(p), bool)
        new[1:] = (item[1:] != item[:-1]) | (p[1:] != p[:-1] + 1) | (i[1:] != i[:-1] + 1)
        first = np.flatnonzero(new)
        yield item[first], p[first], np.diff(first, append=len(p)) + size[first] - 1


def followed(tests: Tests, item: int, mine: np.ndarray, of_window: np.ndarray, win: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``runs`` for one item, by the lengths of the matches that end at each of its words, place after place."""
    places = {w: tests.owner_at[mine[of_window == w]] for w in np.unique(of_window).tolist()}
    span = int(tests.owner_at[mine].max()) + 2
    before, last, found = np.zeros(span, np.int64), -2, []
    turn = np.argsort(at, kind="stable")
    for w, p in zip(win[turn].tolist(), at[turn].tolist(), strict=True):
        if w not in places:
            continue
        now = np.zeros(span, np.int64)
        now[places[w] + 1] = 1 + (before[places[w]] if p == last + 1 else 0)
        before, last = now, p
        n = int(now.max())
        found.append((p - n + 1, n + int(tests.lens[w]) - 1))
    p, n = np.array(found, np.int64).reshape(-1, 2).T
    return np.full(len(p), item), p, n


def scan(tests: Tests, docs: list[list[bytes]]) -> list[tuple[int, list[str], list[tuple[int, int]], int]]:
    """For each document its hit words, items, hit spans (words, end exclusive) and longest match."""
    none = [(0, [], [], 0)] * len(docs)
    sizes = np.array([len(d) for d in docs], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    n = int(sizes.sum() + len(docs))
    if not len(tests.lens):
        return none
    ids = np.zeros(n, np.int32)
    get = tests.vocabulary.get
    for b, d in zip(begins, docs, strict=True):
        ids[b : b + len(d)] = np.fromiter((get(w, 0) for w in d), np.int32, len(d))
    edge = np.flatnonzero(np.diff((ids > 0).astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    long = end - start >= tests.shortest
    start, end = start[long], end[long]
    if not len(start):
        return none
    where = spread(start, end - start + 1)  # with the 0 that ends each run
    part = ids[np.minimum(where, n - 1)] * (where < np.repeat(end, end - start + 1))
    left = np.repeat(end, end - start + 1) - where
    order = suffix_array(part, tests.longest)
    order = order[left[order] >= tests.shortest]
    lo, hi = search(tests, part, order)
    if len(docs) > 1 and int(((hi - lo) * tests.owners).sum()) > MOST:  # fewer documents at a time
        return scan(tests, docs[: len(docs) // 2]) + scan(tests, docs[len(docs) // 2 :])
    win = np.repeat(np.arange(len(lo)), hi - lo)
    at = where[order[spread(lo, hi - lo)]]
    if not len(at):
        return none
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + tests.lens[win], -1)
    edge = np.flatnonzero(np.diff((np.cumsum(marks)[:-1] > 0).astype(np.int8), prepend=0, append=0))
    longest, of = np.zeros(len(docs), np.int64), [set() for _ in docs]
    for item, p, length in runs(tests, win, at):
        doc = np.searchsorted(begins, p, "right") - 1
        np.maximum.at(longest, doc, length)
        for key in np.unique(doc * len(tests.items) + item).tolist():
            of[key // len(tests.items)].add(tests.items[key % len(tests.items)])
    spans: dict[int, list] = {}
    for s, e, d in zip(edge[::2].tolist(), edge[1::2].tolist(), (np.searchsorted(begins, edge[::2], "right") - 1).tolist(), strict=True):
        spans.setdefault(d, []).append((s - int(begins[d]), e - int(begins[d])))
    out = []
    for d in range(len(docs)):
        mine = spans.get(d, [])
        out.append((sum(e - s for s, e in mine), sorted({str(x) for x in of[d] if x is not None}), mine, int(longest[d])))
    return out


def joined(a: list, b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted([*((x["start"], x["end"]) for x in a), *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def judged(tests: Tests, shard: pa.RecordBatch) -> pa.StructArray:
    """What is found in a shard's texts, added to what earlier blocks have found (null at first)."""
    texts = [words(t) for t in shard.column(0).to_pylist()]
    found = []
    for (hit, items, spans, longest), n, old in zip(scan(tests, texts), map(len, texts), shard.column(1).to_pylist(), strict=True):
        if old and old["spans"]:
            spans = joined(old["spans"], spans)
            hit = sum(e - s for s, e in spans)
        if old and old["items"]:
            items = sorted({*items, *old["items"]})
        spans = [{"start": s, "end": e} for s, e in spans]
        found.append({"n_words": n, "n_hit": hit, "items": items, "spans": spans, "longest": max(longest, (old or {}).get("longest") or 0)})
    return pa.array(found, FOUND_ARROW)


def scanning(shared, window: int):
    """A function of a text and what earlier blocks have found: with what the shared block of items has."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tests = tests_of(shared, window)
        for texts, before in batches:
            whole = pa.RecordBatch.from_arrays([texts, before], names=["text", "before"])
            parts = [judged(tests, b) for b in slices(whole, 0, SHARD_BYTES)]
            yield pa.concat_arrays(parts) if parts else pa.array([], FOUND_ARROW)

    # said to be non-deterministic, so that no filter on its result makes Spark compute it twice
    return F.arrow_udf(run, f"struct<{FOUND}>").asNondeterministic()


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark, read block by block: the driver holds one block at a time."""
    block, held = [], 0
    for i, text in items.toLocalIterator():
        if block and held + len(text or "") > block_bytes:
            yield block
            block, held = [], 0
        block.append((i, text))
        held += len(text or "")
    yield block


_tests: list = [None, None]


def tests_of(shared, window: int) -> Tests:
    """A worker keeps the tests that it used last."""
    if _tests[0] is not shared.value:
        _tests[:] = shared.value, Tests(shared.value, window)
    return _tests[1]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``row`` (a struct of the document's columns) and n_words, n_hit, items, spans, longest."""
    spark = docs.sparkSession
    kind = F.lit(None).cast(f"struct<{FOUND}>")
    frame = docs.select(F.struct(*docs.columns).alias("row"), kind.alias("found"))
    text = F.col("row")[text_col].cast("string")
    scratch, old = Scratch(spark, "decontamination"), None
    for k, block in enumerate(item_blocks(benchmark.select(item_col, item_text), block_bytes)):
        if k:  # one block's Python workers at a time
            last, (frame, old) = old, scratch.save(frame)
            if last:
                scratch.drop(last)
        frame = frame.select("row", scanning(spark.sparkContext.broadcast(block), window)(text, "found").alias("found"))
    return frame.select("row", "found.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of any item."""
    return contamination(docs, benchmark, **options).where("n_hit = 0").select("row.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (
  SELECT DISTINCT item_id, i AS pos, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bi),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bi.item_id, bi.pos FROM dw JOIN bi USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
s AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id),
run AS (
  SELECT doc_id, max(c) AS longest FROM (
    SELECT doc_id, count(*) + any_value(n) - 1 AS c FROM (
      SELECT DISTINCT doc_id, item_id, i, pos, n,
        i - row_number() OVER (PARTITION BY doc_id, item_id, i - pos ORDER BY i) AS grp, i - pos AS dia FROM m)
    GROUP BY doc_id, item_id, dia, grp) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, CAST(coalesce(longest, 0) AS INTEGER) AS longest
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN run USING (doc_id)
"""
