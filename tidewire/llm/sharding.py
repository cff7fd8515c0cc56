"""Operator 6: byte-balanced sharding by histogram sort (DataFrame functions only).

Every document gets a 60-bit sort key (20 bits of its text's digest, then 40 bits of its
id's digest): equal texts lie together but for those that a splitter divides, and a text held by a third of all rows still spreads
over 2**40 keys. Rows equal in doc_id and text share a key; ``tie``, a number by the row's place, tells them apart.
Splitters are found by histogram refinement: each round counts the exact
bytes in ``2**BITS`` probe intervals of the key range that still holds each splitter, keeps the
interval in which the byte target falls and divides it again, until the interval's bytes are
within ``tolerance`` or it holds a single key; if many rows have that key, ties are divided in the same way. Only counts reach the
driver: at most ``shards - 1`` ranges of ``2**BITS`` intervals. After that every row knows its shard, and one
exchange brings the rows to (shard, piece), where they are numbered; a piece holds about
``piece_bytes``, so no task gets a whole shard. The numbered rows are written, counted by piece, and get their slots
where they lie: the pieces' starts are written, counted, and sent out.

Defined cases: null text has size 1 and the key of the empty text; a null doc_id has the key of
the empty id; rows equal in doc_id and text get different slots, and different shards where they are many;
how evenly these are divided is exact where the input has its rows in the same places whenever it is read, as files have, and by chance
otherwise; an empty table gives an empty result; extra columns are carried whatever their names, and an input column named like an
output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, sized, table

SHARDS = 16
BITS = 12
KEY_BITS = 60
LOW = (1 << 40) - 1
TIE_BITS = 20
OUTPUTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def sort_key(doc_id: Column, text: Column) -> Column:
    """60 bits: the first 5 hex digits of md5(text), then the first 10 of md5(doc_id)."""
    digits = F.concat(
        F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 5),
        F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 10),
    )
    return F.conv(digits, 16, 10).cast("long")


def tie() -> Column:
    """A number by the row's place in the input."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << TIE_BITS)).cast("int")


def find_splitters(keyed: DataFrame, shards: int, tolerance: int = 0) -> list[tuple[int, int]]:
    """The last keys and ties of shards 0..shards-2. ``keyed``: key, tie, size.

    Splitter i is the smallest key such that the rows of smaller keys and its own hold at least i/shards
    of all bytes, or with a tolerance a key that misses this target by so many bytes at most;
    shard i begins after it. Of a key that several rows have, only those of the smallest ties that reach the target count.
    """
    total = keyed.agg(F.sum("size")).first()[0]
    if not total:
        return []
    targets = {i: -(-i * total // shards) for i in range(1, shards)}
    # range of a target: (lowest key, bits of its width, bytes below it)
    ranges = {i: (0, KEY_BITS, 0) for i in targets}
    found: dict[int, tuple[int, int]] = {}
    shared: dict[int, tuple[int, int]] = {}  # of a key with several rows: the key, bytes below it
    while ranges:
        bits = max(b for _, b, _ in ranges.values())
        step = max(0, bits - BITS)
        lows = sorted({low for low, _, _ in ranges.values()})
        inside = F.lit(False)
        for low in lows:
            inside = inside | F.col("key").between(low, low + (1 << bits) - 1)
        counts = (
            keyed.where(inside)
            .groupBy(F.shiftright("key", step).alias("cell"))
            .agg(F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
            .collect()
        )
        cells: dict[int, list] = {low: [] for low in lows}
        for c in sorted(counts):
            cells[(c["cell"] << step) >> bits << bits].append(c)
        for i, (low, _, below) in list(ranges.items()):
            for c in cells[low]:
                if below + c["bytes"] >= targets[i]:
                    break
                below += c["bytes"]
            over = below + c["bytes"] - targets[i]
            if over <= tolerance or (c["first"] == c["last"] and c["n"] == 1):
                found[i] = c["last"], 1 << TIE_BITS
            elif c["first"] == c["last"]:
                shared[i] = c["last"], below
            else:
                ranges[i] = (c["cell"] << step, step, below)
                continue
            del ranges[i]
    step = TIE_BITS - BITS
    same = F.col("key").isin([key for key, _ in shared.values()])
    counts = sorted(keyed.where(same).groupBy("key", F.shiftright("tie", step).alias("cell")).agg(F.sum("size").alias("bytes")).collect()) if shared else []
    for i, (key, below) in shared.items():
        for c in (c for c in counts if c["key"] == key):
            below += c["bytes"]
            if below >= targets[i]:
                break
        found[i] = key, (c["cell"] + 1 << step) - 1
    return [found[i] for i in sorted(found)]


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: int = 0,
    piece_bytes: int = 64 << 20,
    carry: list[str] | None = None,
) -> DataFrame:
    """The documents (of their columns ``carry``, or all) with size, text_crc32, law, shard, slot and grown_shard; see the module's text."""
    scratch = Scratch(docs.sparkSession, "shards")
    doc_id, text = docs[id_col], docs[text_col].cast("string")
    narrow = docs.select(sort_key(doc_id, text).alias("key"), tie().alias("tie"), row_size(text).alias("size"))
    keyed, keyed_path = scratch.save(narrow)  # 20 bytes a row: the rounds don't read texts again
    splitters = find_splitters(keyed, shards, tolerance)

    def shard(key: Column, tie: Column) -> Column:
        out = F.lit(0)
        for k, t in splitters:
            out = out + ((key > k) | ((key == k) & (tie > t))).cast("int")
        return out.cast("int")

    # A shard's pieces are equal ranges of the id's 40 bits, which a text that many rows share doesn't skew.
    low = lambda key: key.bitwiseAND(F.lit(LOW))
    largest = keyed.agg(F.sum("size")).first()[0] or 0
    span = max(1, (LOW + 1) // max(1, -(-largest // (shards * piece_bytes))))
    piece = lambda key: F.floor(low(key) / span).cast("int")
    in_pieces = keyed.groupBy(shard(F.col("key"), F.col("tie")), piece(F.col("key"))).agg(F.sum("size").alias("bytes"))
    # ties divide pieces that equal rows have made much too large
    parts = max(1, (in_pieces.agg(F.max("bytes")).first()[0] or 0) // (4 * piece_bytes))
    carried = [docs[c] for c in (docs.columns if carry is None else carry) if c not in OUTPUTS]
    rows = docs.select(
        *([F.struct(*carried).alias("row")] if carried else []),
        row_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        sort_key(doc_id, text).alias("key"),
        tie().alias("tie"),
    ).withColumns({"shard": shard(F.col("key"), F.col("tie")), "piece": piece(F.col("key")), "part": F.floor(F.col("tie") * F.lit(parts) / (1 << TIE_BITS)).cast("int")})
    place = F.row_number().over(W.partitionBy("shard", "piece", "part").orderBy(low(F.col("key")), "key", "size", "text_crc32", "tie")) - 1
    rows, _ = scratch.save(rows.withColumn("place", place.cast("long")).drop("key", "tie"))
    scratch.drop(keyed_path)
    sizes, sizes_path = scratch.save(rows.groupBy("shard", "piece", "part").agg(F.count("*").alias("n")))  # a row for each piece
    starts, _ = scratch.save(sizes.select("shard", "piece", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("piece", "part")) - F.col("n")).alias("start")))
    scratch.drop(sizes_path)
    out = rows.join(sized(starts), ["shard", "piece", "part"]).withColumn("slot", F.col("place") + F.col("start"))
    return out.select(*(["row.*"] if carried else []), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), carry=["doc_id"])


#: CRC-32 of the bytes, by its table (crc 0xEDB88320), as DuckDB has none.
ORACLE = """
WITH steps AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS tab
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))),
k AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS hx,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 5)
         || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT) AS key
  FROM documents),
c AS (SELECT key, sum(sum(size)) OVER (ORDER BY key) AS upto FROM k GROUP BY key),
t AS (SELECT max(upto) AS total FROM c),
s AS (SELECT i, min(key) AS splitter FROM c, t, range(1, 16) r(i)
      WHERE upto * 16 >= i * total GROUP BY i),
p AS (SELECT k.*, (SELECT count(*) FROM s WHERE k.key > s.splitter) AS shard FROM k),
q AS (SELECT p.*, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
        list_transform(range(1, size), lambda j: CAST('0x' || substr(hx, CAST(2 * j - 1 AS INTEGER), 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]))) AS crc
      FROM p, steps)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY key % 1099511627776, key, size, crc) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM q
"""
