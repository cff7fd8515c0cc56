"""Operator 13: a Merkle manifest of a table, by superblock reduction.

Every row is a leaf: a SHA-256 over its columns. Leaves are numbered without gaps inside their group (a language) in order of id:
rows of digests, never texts, are sorted over all partitions at once, so a group may be of any size, and the numbers follow from the
partitions' counts. Indices are then cut into buckets of ``fanout ** LEVELS``; ``applyInPandas`` collapses that many levels of a bucket at a time,
and gives each node its siblings on the way and the bucket one node. The buckets' nodes are reduced in the same way until each group has one
bucket left; the groups' roots are reduced to the root. A row's proof is the lower one with the upper ones behind it,
joined by bucket from the top down. No task holds more than a bucket.

Defined cases: a null column counts as ``-`` (an empty text as ``0:``); a null group or id is a value of its own and comes first; rows of one id are
ordered by their leaves, repeated rows are leaves each; in a group of one row the leaf is its subroot, in a table of one group the subroot is
the root; an empty table gives an empty result; texts of any length are hashed whole; other columns aren't read; a null id is never tampered with.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, sized, table

FANOUT = 2
#: Leaves of a superblock, at most.
BLOCK = 1024
#: Rows of buckets with their proofs, some kilobytes each, that are broadcast instead of joined by a shuffle.
SENT = 10_000


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def told(column: Column) -> Column:
    """``-`` for null, else its UTF-8 bytes' count, a colon, and itself."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*columns: Column) -> Column:
    return digest(F.concat(*map(told, columns)))


def indexed(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """Adds ``idx``, the place in the group from 0, and ``n``, the group's rows. Rows are told apart by place in the end, so equal ones don't pile up."""
    tied, first = scratch.save(rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())))
    keys = [group, *order, "_tie"]
    placed = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed, _ = scratch.save(placed.withColumn("_at", F.monotonically_increasing_id()))
    scratch.drop(first)
    part = F.shiftright("_at", 33)
    counts, _ = scratch.save(placed.groupBy(F.col(group).alias("_g"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    w = W.partitionBy("_g")  # a row for each partition that the group reaches into
    starts = counts.select("_g", "_part", "_first", (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_start"), F.sum("_n").over(w).alias("n"))
    here = placed[group].eqNullSafe(F.col("_g")) & (part == F.col("_part"))
    small = counts.count() <= 100_000
    joined = placed.join(F.broadcast(starts) if small else starts, here)
    return joined.select(*[c for c in placed.columns if c != "_at"], (F.col("_at") - F.col("_first") + F.col("_start")).alias("idx"), "n")


def height(n: int, fanout: int) -> int:
    """Levels over n nodes: a run is also made of one node while others remain beside it."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapse(nodes: list[str], levels: int, fanout: int) -> tuple[list[str], list[list[str]], list[list[str]]]:
    """The nodes that are left after so many levels, and for each given node, level by level, its siblings' digests before and after it."""
    before, after = [[] for _ in nodes], [[] for _ in nodes]
    width, total = 1, len(nodes)
    for _ in range(levels):
        over = []
        for start in range(0, len(nodes), fanout):
            run = nodes[start : start + fanout]
            for place in range(len(run)):
                left, right = "".join(run[:place]), "".join(run[place + 1 :])
                for leaf in range((start + place) * width, min((start + place + 1) * width, total)):
                    before[leaf].append(left)
                    after[leaf].append(right)
            over.append(hashlib.sha256("".join(run).encode()).hexdigest())
        nodes, width = over, width * fanout
    return nodes, before, after


PROOF = "before array<string>, after array<string>, top string"


def superblocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes: g, idx, n, node and others. Adds bucket, the proof inside it, and the bucket's node ``top``."""
    size = fanout**levels

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        tops, before, after = collapse(block["node"].tolist(), min(levels, height(int(block["n"].iloc[0]), fanout)), fanout)
        return block.assign(before=before, after=after, top=tops[0])

    rows = nodes.withColumn("bucket", F.floor(F.col("idx") / size))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("g", "bucket").applyInPandas(run, f"{schema}, {PROOF}")


def proofs(nodes: DataFrame, scratch: Scratch, fanout: int = FANOUT, block: int = BLOCK, roots: bool = True) -> DataFrame:
    """nodes: g (string, may be null), idx, n, node and others. Adds before and after, the siblings up to the root, and subroot and root.

    Without ``roots``, up to the group's own root.
    """
    levels = max(1, height(block, fanout))
    size, steps = fanout**levels, []
    while True:
        saved, _ = scratch.save(superblocks(nodes, fanout, levels))
        steps.append(saved)
        if saved.where(F.col("n") > size).isEmpty():
            break
        nodes = saved.where(F.col("idx") % size == 0).select("g", F.col("bucket").alias("idx"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node"))
    done = steps.pop().withColumn("subroot", F.col("top")).withColumn("root", F.col("top"))
    if roots:  # here a group is one bucket, so none is hot in this join
        tops = done.where("idx = 0").select(F.col("g").alias("of"), F.col("top").alias("node")).withColumn("g", F.lit(None).cast("string"))
        over = proofs(indexed(tops, "g", ["of"], scratch), scratch, fanout, block, roots=False)
        over, _ = scratch.save(over.select(F.col("of").alias("up_g"), *upper(), F.col("root").alias("up_root")))
        done = done.join(sized(over, SENT), done["g"].eqNullSafe(over["up_g"]), "left")
        done = done.withColumns({**longer(), "root": F.col("up_root")}).drop(*over.columns)
    while steps:
        over, _ = scratch.save(done.select(F.col("g").alias("up_g"), F.col("idx").alias("up_block"), *upper(), F.col("subroot").alias("up_subroot"), F.col("root").alias("up_root")))
        done = steps.pop()
        done = done.join(sized(over, SENT), done["g"].eqNullSafe(over["up_g"]) & (done["bucket"] == over["up_block"]), "left")
        done = done.withColumns({**longer(), "subroot": F.col("up_subroot"), "root": F.col("up_root")}).drop(*over.columns)
    return done.drop("bucket", "top")


def upper() -> list[Column]:
    return [F.col(c).alias(f"up_{c}") for c in ("before", "after")]


def longer() -> dict[str, Column]:
    """Lower proofs with the upper ones behind them."""
    return {c: F.concat(c, f"up_{c}") for c in ("before", "after")}


def siblings(rows: DataFrame) -> Column:
    return F.arrays_zip(rows["before"], rows["after"])


def proof_digest(rows: DataFrame) -> Column:
    return digest(F.array_join(F.transform(siblings(rows), lambda s: F.concat(s["before"], s["after"])), ""))


def folded(rows: DataFrame, leaf: Column) -> Column:
    """The root that the siblings give for a leaf."""
    return F.aggregate(siblings(rows), leaf, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def manifest(docs: DataFrame, group_col: str, columns: list[str], id_col: str = "doc_id", shown: Column | None = None, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, shown_leaf, before, after, subroot, root. ``shown``: the leaf of the row as it is shown to a verifier; its own, if not given."""
    scratch = Scratch(docs.sparkSession, "manifest")
    leaf = leaf_of(*[docs[c] for c in columns])
    rows = docs.select(docs[group_col].cast("string").alias("g"), docs[id_col].alias("doc_id"), leaf.alias("node"), (leaf if shown is None else shown).alias("shown_leaf"))
    done = proofs(indexed(rows, "g", ["doc_id", "node"], scratch), scratch, fanout, block)
    return done.select("doc_id", F.col("node").alias("leaf"), "shown_leaf", "before", "after", "subroot", "root")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0, F.lit(False))
    more = docs["n_chars"].cast("decimal(20,0)") + 1
    shown = leaf_of(*[F.when(tampered, more).otherwise(docs[c].cast("decimal(20,0)")) if c == "n_chars" else docs[c] for c in columns])
    rows = manifest(docs, "lang", columns, shown=shown)
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(rows).alias("proof_sha256"), folded(rows, rows["shown_leaf"]).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of the decimal id by its table, as DuckDB has none; trees and proofs level by level.
ORACLE = """
WITH RECURSIVE steps AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS tab
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))),
c AS (
  SELECT d.*, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda j: CAST(ascii(substr(CAST(doc_id AS VARCHAR), j, 1)) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]))) AS crc
  FROM documents d, steps),
e AS (
  SELECT doc_id, lang, coalesce(crc % 7 = 0, false) AS tampered,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM c),
h AS (SELECT doc_id, lang, sha256(head || chars || tail) AS leaf,
  sha256(head || CASE WHEN tampered THEN more ELSE chars END || tail) AS shown FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM h),
t AS (
  SELECT lang, 0 AS level, idx, n, leaf AS node FROM l
  UNION ALL
  SELECT lang, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY lang, level, idx // 2, n),
s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, idx, n, subroot AS node FROM s
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 2, n),
x AS (
  SELECT lang, doc_id, leaf, shown AS node, idx, n, 0 AS level, '' AS proof FROM l
  UNION ALL
  SELECT x.lang, doc_id, leaf,
    sha256(CASE WHEN t.node IS NULL THEN x.node WHEN x.idx % 2 = 1 THEN t.node || x.node ELSE x.node || t.node END),
    x.idx // 2, (x.n + 1) // 2, x.level + 1, proof || coalesce(t.node, '')
  FROM x LEFT JOIN t ON t.lang IS NOT DISTINCT FROM x.lang AND t.level = x.level AND t.idx = xor(x.idx, 1::BIGINT) WHERE x.n > 1),
y AS (
  SELECT doc_id, leaf, subroot, x.node, s.idx, s.n, 0 AS level, proof FROM x JOIN s ON s.lang IS NOT DISTINCT FROM x.lang WHERE x.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot,
    sha256(CASE WHEN u.node IS NULL THEN y.node WHEN y.idx % 2 = 1 THEN u.node || y.node ELSE y.node || u.node END),
    y.idx // 2, (y.n + 1) // 2, y.level + 1, proof || coalesce(u.node, '')
  FROM y LEFT JOIN u ON u.level = y.level AND u.idx = xor(y.idx, 1::BIGINT) WHERE y.n > 1)
SELECT doc_id, leaf, subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root,
  node = (SELECT node FROM u WHERE n = 1) AS verified
FROM y WHERE n = 1
"""
