"""Operator 1: exact top-k by inner product, with sorted lists and no random access (NRA).

Candidates are dealt into shards of about ``SHARD`` vectors; every shard is sorted once, and all queries stream past
it in blocks of ``QUERIES``. A shard has two sorted lists for each dimension, one by
falling and one by rising component; a query reads the list whose contributions fall, by the sign of its own component.
Lists are read sequentially and all to the same depth. At a depth, a candidate's score is bounded by what has
been read: components not yet seen lie between the list's last value read and its end. A query stops when
its k-th lower bound exceeds the upper bounds of all others, seen or not; its winners' scores are then resolved:
their lists are read on until the winners' entries have come. Otherwise reading goes on to the double depth, or to the lists' end if
most candidates are still open; then all scores are known. Bounds of all queries of a block are
computed together as products of matrices. Each shard returns its k best, and the best of all shards are picked
by a window over ``shards * k`` rows a query.

Defined cases: a vector that is null, or has a null or non-finite component, takes no part, nor does one without a vec_id;
vectors of other lengths count as padded with zeros; repeated rows are candidates each by itself (all but the
query's own id; they are dealt as one row and its number, of which no query can want more than k); equal query rows are asked once,
and rows of one query id with different vectors are queries by themselves, told apart by ``asked``; ties go to the smaller vec_id;
scores outside a long are clipped to it; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

K = 5
SHARD = 4096
QUERIES = 512
#: Part of the lists that is read first.
FIRST = 1 / 8


def whole_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles hold it; null unless all components are finite."""
    asdouble = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(asdouble, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(asdouble, lambda x: F.floor(x * scale).cast("double")))


class Lists:
    """A shard's sorted lists. ``falling[d]`` holds candidates by falling component d; read backwards, by rising."""

    def __init__(self, vectors: np.ndarray):
        self.x = vectors
        self.falling = np.argsort(-vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.falling, axis=0)
        self.rank = np.empty_like(self.falling)
        np.put_along_axis(self.rank, self.falling, np.arange(len(vectors))[:, None], axis=0)

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores after ``depth`` entries of each query's lists."""
        n = len(self.x)
        if depth >= n:
            exact = queries @ self.x.T
            return exact, exact.copy()
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        seen = self.rank < depth
        high, low = self.sorted[depth - 1], self.sorted[-1]
        upper = up @ np.where(seen, self.x, high).T
        lower = up @ np.where(seen, self.x, low).T
        seen = self.rank >= n - depth
        high, low = self.sorted[n - depth], self.sorted[0]
        upper += down @ np.where(seen, self.x, high).T
        lower += down @ np.where(seen, self.x, low).T
        return lower, upper

    def read_on(self, query: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, int]:
        """The components of few candidates as the query's lists hold them, and the depth at which the last of these lies."""
        ranks = self.rank[few]
        places = np.where(query >= 0, ranks, len(self.x) - 1 - ranks)[:, query != 0]
        return np.take_along_axis(self.sorted, ranks, axis=0), int(places.max(initial=-1)) + 1


def resolve(query: np.ndarray, vectors: np.ndarray) -> list[int]:
    """Exact scores, in integers of any size."""
    if len(query) * np.abs(query).max(initial=0) * np.abs(vectors).max(initial=0) < 2**52:
        return [int(s) for s in vectors @ query]
    whole = [int(v) for v in query]
    return [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in vectors]


def search(ids: np.ndarray, lists: Lists, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(query's position, vec_id, score, entries of each list read) of each query's k best in the shard."""
    n = len(ids)
    active = np.arange(len(queries))
    depth = min(n, max(k + 1, int(n * FIRST)))
    while len(active):
        lower, upper = lists.bounds(queries[active], depth)
        own = query_ids[active][:, None] == ids[None, :]
        lower[own], upper[own] = -np.inf, -np.inf
        # doubles round: bounds are only trusted up to a relative error
        slack = 1e-12 * (np.abs(queries[active]) @ np.abs(lists.x).max(axis=0))
        m = min(k, n)
        kth = -np.partition(-lower, m - 1, axis=1)[:, m - 1]
        stay, wide = [], 0
        for r, q in enumerate(active):
            inside = np.flatnonzero((upper[r] >= kth[r] - slack[r]) & ~own[r])
            if len(inside) > k and depth < n:
                stay.append(q)
                wide += len(inside)
                continue
            found, last = lists.read_on(queries[q], inside)
            best = sorted(zip((-s for s in resolve(queries[q], found)), ids[inside].tolist(), strict=True))[:k]
            for s, i in best:
                yield int(q), i, -s, max(depth, last)
        active, depth = np.array(stay, np.int64), n if wide > n * len(stay) // 2 else min(n, 2 * depth)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = 256) -> DataFrame:
    """query_id, asked, rank, vec_id, score, list_depth. Both inputs: vec_id, embedding."""
    ready = lambda df: df.select("vec_id", whole_components(F.col("embedding"), scale).alias("v")).where("v is not null and vec_id is not null")
    candidates, asked = ready(vectors), ready(queries).distinct()
    shards = max(1, -(-candidates.count() // SHARD))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    # equal rows are counted before the exchange: however many there are, a query's k best hold k of them at most
    copies = candidates.groupBy("vec_id", "v").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))))
    left = copies.select(F.pmod(F.xxhash64("vec_id", "v", "copy"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    right = asked.select(every.alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stream of shards, each with its candidates before its queries."""
        held: list[tuple[int, list]] = []
        of, asking, lists, ids, place = None, False, None, None, 0

        def dense(vectors: list, width: int) -> np.ndarray:
            return np.array([np.pad(np.asarray(v, float), (0, width - len(v))) for v in vectors]).reshape(len(vectors), width)

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal lists, ids, place
            if not held:
                return
            names, vectors = np.array([i for i, _ in held], np.int64), [v for _, v in held]
            held.clear()
            if not asking:
                lists, ids = vectors, names
                return
            if lists is None:
                return
            width = max(map(len, vectors))
            if isinstance(lists, list):
                lists = Lists(dense(lists, max(width, *map(len, lists))) if len(lists) > 1 else dense(lists, max(width, len(lists[0]))))
            elif lists.x.shape[1] < width:
                lists = Lists(np.pad(lists.x, ((0, 0), (0, width - lists.x.shape[1]))))
            found = list(search(ids, lists, names, dense(vectors, lists.x.shape[1]), k))
            at, who, score, depth = zip(*found, strict=True) if found else ((), (), (), ())
            at = np.array(at, np.int64)
            columns = [names[at], at + place, np.array(who, np.int64), [min(max(s, -(2**63)), 2**63 - 1) for s in score]]
            place += len(names)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(depth, pa.int32())], names=["query_id", "place", "vec_id", "score", "list_depth"])

        for b in batches:
            for shard, asks, vec, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (shard, asks) != (of, asking) or (asks and len(held) >= QUERIES):
                    yield from finish()
                    if shard != of:
                        lists, ids, place = None, None, 0
                    of, asking = shard, asks
                held.append((vec, v))
        yield from finish()

    both = left.unionByName(right).repartition("shard").sortWithinPartitions("shard", "asks", "vec_id", "v")  # queries have the same places in every shard
    found = both.mapInArrow(run, "query_id long, place long, vec_id long, score long, list_depth int")
    place = F.row_number().over(W.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("place").alias("asked"), "rank", "vec_id", "score", "list_depth")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0")).drop("asked", "list_depth")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, unnest(range(1, len(e) + 1)) AS d, unnest(e) AS x FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
