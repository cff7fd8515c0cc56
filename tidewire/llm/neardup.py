"""Operator 3: near-duplicate groups by b-bit MinHash, with exact confirmation.

1. Every document becomes a set of word shingles; its b-bit signature holds the low byte of ``ROWS * BANDS``
   (padded to whole words) minima. Documents of equal sets share one representative, their smallest doc_id.
2. Bands of the packed signature give candidate buckets. With 5 rows and 44 bands a pair of similarity 0.8 shares no
   bucket with probability 3e-8; no bucket is capped.
3. In each bucket members are paired with its smallest member only. Pairs whose collision-corrected estimate is 6
   standard deviations too low are dropped; each document's best pair is confirmed on the full sets of both
   texts, then all others that join two components; confirmed links are joined to components.
4. Buckets of three and more that still hold several components are settled exactly: their members are compared by signature in
   blocks, those with a promising partner in another component get their texts, and full sets are
   compared in the same blocks; a block emits a spanning forest of its links, never all pairs.
5. Components of all links, by contraction.

Defined cases: null and wordless texts have no shingles and are linked with nothing; fewer words than a shingle
form one; rows of one doc_id are one node with several texts; a null doc_id is linked with nothing,
has no component and is kept; an empty table gives an empty result; other columns are carried or not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash as mh
from .bpe import slices
from .common import SMALL, Scratch, id_and_text, release, sized, table
from .components import components

LANES = -(-mh.ROWS * mh.BANDS // 8) * 8
#: Members of a bucket in a block, and the shingles that they hold together.
BLOCK, BLOCK_SHINGLES = 1000, 500_000
#: Nodes that one copy of a hub's text is compared with.
STREAM = 1000


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set, null if empty), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for b in slices(whole, 1, 1 << 20):
                sets = [mh.shingles(mh.word_hashes(t, known), words) for t in b.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, sigs = [None] * len(sets), [None] * len(sets)
                if full:
                    for i, row in zip(full, mh.signatures([sets[i] for i in full], LANES), strict=True):
                        keys[i], sigs[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "sig"],
                )
        release()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def rows_of(column: pa.Array) -> np.ndarray:
    """Signatures of a batch as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def promising(pairs: DataFrame, similarity: float) -> DataFrame:
    """a, b, estimate of the pairs (a, b, sig_a, sig_b) that may be links."""
    least = mh.least_estimate(similarity, LANES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = mh.estimates(rows_of(b.column(2)), rows_of(b.column(3)))
                out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], names=["a", "b", "estimate"])
                yield out.filter(pa.array(found >= least))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, estimate double")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. texts: doc_id, text.

    Every text is sent to the nodes a that it is compared with, and meets them in a stream ordered by a; a node a
    that many others meet is dealt out, with ``STREAM`` of them at a time.
    """
    pairs, _ = scratch.save(pairs.select("a", "b"))
    parts = pairs.groupBy("a").agg(F.floor(F.count("*") / STREAM).cast("int").alias("last"))
    hubs = parts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), "last")).alias("part"), F.lit(True).alias("hub"))
    others = pairs.join(parts, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("last") + 1).cast("int").alias("part"), F.lit(False).alias("hub"))
    routes, _ = scratch.save(hubs.unionByName(others))
    routes = sized(routes, SMALL // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        last, own = None, []
        for whole in batches:
            for b in slices(whole, 4):
                found: list[tuple[int, int]] = []
                for a, part, hub, node, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (a, part) != last:
                        last, own = (a, part), []
                    mine = mh.shingles(mh.word_hashes(text, known), words)
                    if hub:
                        own.append(mine)
                    elif any(mh.linked(x, mine, percent) for x in own):
                        found.append((a, node))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])
        release()

    met = texts.join(routes, texts["doc_id"] == routes["node"]).select("a", "part", "hub", "node", "text")
    met = met.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("hub"))
    return met.mapInArrow(run, "a long, b long")


def blocks(members: DataFrame, *carried: str) -> DataFrame:
    """The members of each bucket (key, band, n, n_shingles, node, component, ...) once for every two blocks that they meet in: i <= j."""
    count = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    met = members.select("key", "band", "node", "component", *carried, own.alias("own"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
    return met.select("key", "band", "node", "component", *carried, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def cross_pairs(g: pd.DataFrame, sig: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a block pair, the later rows of other components that may be links and share no earlier band."""
    band, split = int(g["band"].iat[0]), g["i"].iat[0] != g["j"].iat[0]
    own, comp = g["own"].to_numpy(), g["component"].to_numpy()
    earlier = sig[:, : band * mh.ROWS].reshape(len(g), band, mh.ROWS)
    for r in range(len(g) - 1):
        to = np.arange(r + 1, len(g))
        to = to[(comp[to] != comp[r]) & ((own[to] != own[r]) if split else True)]
        if len(to):
            to = to[mh.estimates(np.broadcast_to(sig[r], (len(to), sig.shape[1])), sig[to]) >= least]
        if len(to) and band:
            to = to[~(earlier[to] == earlier[r]).all(axis=2).any(axis=1)]
        if len(to):
            yield r, to


def involved(members: DataFrame, similarity: float) -> DataFrame:
    """The members (key, i, j, node) of block pairs in which they may have links into other components."""
    least = mh.least_estimate(similarity, LANES)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(len(g), -1)
        on = np.zeros(len(g), bool)
        for r, to in cross_pairs(g, sig, least):
            on[r] = on[to] = True
        return g.loc[on, ["key", "band", "i", "j", "own", "node", "component", "sig"]]

    schema = "key long, band int, i int, j int, own int, node long, component long, sig binary"
    return blocks(members, "sig").groupBy("key", "i", "j").applyInPandas(run, schema)


def settled(members: DataFrame, similarity: float, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components, a spanning forest of each block pair. members: of ``involved``, with text."""
    least = mh.least_estimate(similarity, LANES)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        sig = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(len(g), -1)
        sets = [mh.shingles(mh.word_hashes(t, known), words) for t in g["text"]]
        node, found = g["node"].to_numpy(), []
        top = {c: c for c in g["component"]}

        def root(c: int) -> int:
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        comp = g["component"].to_numpy()
        for r, to in cross_pairs(g, sig, least):
            for x in to:
                if (p := root(comp[r])) != (q := root(comp[x])) and mh.linked(sets[r], sets[x], percent):
                    top[max(p, q)] = min(p, q)
                    found.append((node[r], node[x]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return members.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each row of ``docs``."""
    spark, similarity = docs.sparkSession, percent / 100
    scratch = Scratch(spark, "neardup")
    texts = id_and_text(docs, id_col, text_col)
    wide, wide_path = scratch.save(signed(texts, words))
    sets = wide.where("set_key is not null and doc_id is not null").groupBy("set_key")
    sets = sets.agg(F.min(F.struct("doc_id", "sig", "n_shingles")).alias("m"))
    sets, _ = scratch.save(sets.select("set_key", F.col("m.doc_id").alias("node"), "m.sig", "m.n_shingles"))
    rows, _ = scratch.save(wide.drop("sig"))
    scratch.drop(wide_path)
    sigs = sets.select("node", "sig")

    band = F.expr(f"posexplode(transform(sequence(0, {mh.BANDS - 1}), i -> xxhash64(i, substring(sig, i * {mh.ROWS} + 1, {mh.ROWS}))))")
    bands = sigs.select("node", band.alias("band", "key"))
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count("*").alias("n")).where("hub < top")
    buckets, _ = scratch.save(bands.join(hubs.select("key", "hub", "n"), "key"))

    stars = buckets.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    of = lambda c: sigs.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    stars = promising(stars.join(of("b"), "b").join(of("a"), "a"), similarity)
    stars, stars_path = scratch.save(stars)
    # all texts are shuffled once, for those that any later step may compare
    wanted = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).unionByName(buckets.where("n > 2").select("node")).distinct()
    wanted, _ = scratch.save(wanted)
    texts, _ = scratch.save(texts.join(sized(wanted), texts["doc_id"] == wanted["node"], "left_semi"))
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))
    links, _ = scratch.save(confirmed(best, texts, words, percent, scratch))
    labels = components(links, scratch)
    named = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    apart = stars.join(named("a"), "a", "left").join(named("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    apart = apart.select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti")
    links, _ = scratch.save(links.unionByName(confirmed(apart, texts, words, percent, scratch)))
    scratch.drop(stars_path)
    labels = components(links, scratch)

    inside = buckets.where("n > 2").join(labels, "node", "left").select("key", "band", "n", "node", F.coalesce("component", "node").alias("component"))
    mixed = inside.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    open_, _ = scratch.save(inside.join(mixed, "key", "left_semi").join(sets.select("node", "n_shingles"), "node"))
    open_ = open_.join(open_.groupBy("key").agg(F.sum("n_shingles").alias("shingles")), "key").join(sigs, "node")
    members, _ = scratch.save(involved(open_, similarity))
    more = settled(members.join(texts.withColumnRenamed("doc_id", "node"), "node"), similarity, words, percent)
    more, _ = scratch.save(more.unionByName(links))
    final = components(more, scratch)

    nodes = sets.select("set_key", "node").join(final, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    placed = rows.join(nodes, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those whose group has one of smaller id; each row of a kept id stays."""
    found = near_duplicates(docs, id_col=id_col, **options)
    gone, _ = Scratch(docs.sparkSession, "copies").save(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(sized(gone), docs[id_col].cast("long") == gone["_gone"], "left_anti")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reach FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id,
  d.doc_id = coalesce(m.c, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
