"""Operator 5: byte-level BPE encoding and decoding in padded numpy matrices.

``encode`` splits every whole text by a pattern, looks distinct pieces up in a bounded table of
pieces already seen by the worker, and merges the new ones in bulk: pieces are put into buckets
by length, each bucket is a matrix of ids padded with -1, and in every round each row merges its
leftmost pair of minimum rank. Ranks come from an open-addressing hash table of pairs; the merged
column is squeezed out of every row at once, and rows without a pair leave the matrix. Rows of more
than ``LONG`` bytes merge all non-overlapping occurrences of their minimum pair in a round, from the left, where
the merged token only forms pairs of higher rank (else the leftmost alone): the same result, in a
number of rounds that doesn't follow the length. ``decode`` gathers the bytes of the ids.

The rank file's path is a parameter; it is read on the driver, and its tables (some MB for 50k ranks,
refused above ``MAX_RANKS``) are broadcast. No special tokens.

Defined cases: null text encodes as an empty list, an empty text too; a null doc_id is carried; each
row is encoded by itself, so repeated rows give repeated results; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, table

MAX_RANKS = 1 << 20
#: Rows longer than this merge all occurrences of their minimum pair in a round.
LONG = 256
#: Pieces known to a worker at most; the table starts afresh beyond it.
KNOWN = 200_000
#: Pieces handled at a time.
AT_ONCE = 300_000
NONE = np.int32(2**31 - 1)
SALT = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, blank, rank), by rank."""
    with open(path, "rb") as f:
        found = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    if sorted(found) != list(range(len(found))) or len(found) > MAX_RANKS:
        raise ValueError(f"{path}: ranks must be 0..n-1, n at most {MAX_RANKS}")
    return [found[i] for i in range(len(found))]


class PairTable:
    """Hashed lookup: pair of ids -> id of the merged token, or NONE."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        pairs = [
            (a, b, r)
            for t, r in rank.items()
            for k in range(1, len(t))
            if (a := rank.get(t[:k])) is not None and (b := rank.get(t[k:])) is not None
        ]
        #: tokens that form a pair of lower rank than their own
        self.early = {x for a, b, r in pairs for x in (a, b) if r < x}
        a, b, r = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        keys = a << 20 | b
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.vals = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        slot, left, self.probes = self.slots(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] < 0
            at, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.keys[at], self.vals[at] = keys[won], r[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (size - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * SALT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where either id is negative (padding), NONE."""
        out = np.full(a.shape, NONE, np.int32)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a.ravel()[at].astype(np.int64) << 20 | b.ravel()[at]
        slot, flat = self.slots(keys), out.ravel()
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == keys
            flat[at[hit]] = self.vals[slot[hit]]
            on = ~hit & (there >= 0)
            if not on.any():
                break
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(a.shape)


class Codec:
    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.pairs = PairTable(tokens)
        self.of_byte = np.array([self.whole.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("every byte needs a rank")
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum([len(t) for t in tokens])
        self.lens = np.array([len(t) for t in tokens], np.int64)

    def merge_matrix(self, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids: a bucket's matrix, padded with -1 at the right; rows: their numbers.

        Yields rows that are done: their numbers, how many ids each has, and these one after the other.
        """
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(rows):
            n = np.arange(len(rows))
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            low = rank[n, at] if rank.shape[1] else np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                real = ids[done] >= 0
                yield rows[done], real.sum(axis=1), ids[done][real]
                go = ~done
                ids, rank, rows, at, low = ids[go], rank[go], rows[go], at[go], low[go]
                n = n[: len(rows)]
            if not len(rows):
                return
            ids[n, at] = low
            keep = np.ones(ids.shape, bool)
            keep[n, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            rank = rank[keep[:, 1:]].reshape(len(rows), -1)
            if rank.shape[1]:
                for j in (at - 1, at):  # the pairs beside the merged token
                    ok = (j >= 0) & (j < rank.shape[1])
                    rank[n[ok], j[ok]] = self.pairs.get(ids[n[ok], j[ok]], ids[n[ok], j[ok] + 1])

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row: each round merges every occurrence of the minimum pair, from the left, without overlaps."""
        rank = self.pairs.get(ids[:-1], ids[1:])
        while len(rank) and (low := rank.min()) != NONE:
            at = np.flatnonzero(rank == low)
            # overlapping occurrences follow each other directly (a a a): of each such run every second counts
            begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            run = np.repeat(begins, np.diff(begins, append=len(at)))
            at = at[(np.arange(len(at)) - run) % 2 == 0] if int(low) not in self.pairs.early else at[:1]
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep[1:]]
            new = at - np.arange(len(at))
            for j in (new - 1, new):
                j = j[(j >= 0) & (j < len(rank))]
                rank[j] = self.pairs.get(ids[j], ids[j + 1])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has."""
        whole = np.fromiter((self.whole.get(p, -1) for p in pieces), np.int32, len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        known = np.flatnonzero(whole >= 0)
        got = [(known, np.ones(len(known), np.int64), whole[known])]
        for i in np.flatnonzero((whole < 0) & (size > LONG)):
            ids = self.merge_long(self.of_byte[np.frombuffer(pieces[i], np.uint8)])
            got.append((np.array([i]), np.array([len(ids)]), ids))
        rest = np.flatnonzero((whole < 0) & (size <= LONG))
        width = np.int64(1) << np.ceil(np.log2(np.maximum(size[rest], 1))).astype(np.int64)
        for w in np.unique(width):
            members = rest[width == w]
            for k in range(0, len(members), step := max(1, (1 << 20) // int(w))):
                some = members[k : k + step]
                ids = np.full((len(some), w), -1, np.int32)
                ids[np.arange(w) < size[some][:, None]] = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)]
                got += self.merge_matrix(ids, some)
        rows, n, flat = (np.concatenate(x) for x in zip(*got, strict=True))
        starts, lens = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[rows], lens[rows] = np.cumsum(n) - n, n
        return flat[spread(starts, lens)], lens

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and how many each has."""
        n = self.lens[ids]
        return self.bytes[spread(self.ends[ids] - n, n)], n


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - n), n)


class PieceTable:
    """The ids of pieces met so far, in one flat array."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        if len(self.at) > KNOWN:
            self.clear()
        new = [p for p in set(pieces) if p not in self.at]
        if new:
            found, lens = self.codec.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.ids = np.concatenate([self.ids, found])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        which = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        n = self.lens[which]
        return self.ids[spread(self.starts[which], n)], n


_codec: list = [None, None]


def codec_of(shared) -> Codec:
    """A worker keeps the codec of the vocabulary that it used last."""
    if _codec[0] is not shared.value:
        _codec[:] = shared.value, Codec(shared.value)
    return _codec[1]


def encode_texts(texts: list[str | None], pattern, known: PieceTable) -> list[np.ndarray]:
    """The ids of each text. Many short texts, or parts of a long one, are handled at a time."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[str] = []
    owner: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            ids, n = known.encode(held)
            ends = np.concatenate([[0], np.cumsum(n)])
            k = 0
            for i, m in owner:
                parts[i].append(ids[ends[k] : ends[k + m]])
                k += m
        held.clear()
        owner.clear()

    for i, text in enumerate(texts):
        found = (m.group() for m in pattern.finditer(text or "")) if len(text or "") > 4 * AT_ONCE else iter(pattern.findall(text or ""))
        while some := list(islice(found, AT_ONCE)):
            held += some
            owner.append((i, len(some)))
            if len(held) >= AT_ONCE:
                flush()
    flush()
    return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in parts]


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``most`` bytes."""
    rows = max(1, int(most / max(1, batch.column(column).nbytes / max(1, batch.num_rows))))
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the token ids of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = regex.compile(pattern), PieceTable(codec_of(shared))
        for whole in batches:
            for b in slices(whole, 1):
                ids = encode_texts(b.column(1).to_pylist(), split, known)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with decoded (binary): the bytes of the ids. Null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for whole in batches:
            for b in slices(whole, 1):
                lists = b.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                data, each = codec.decode_flat(flat)
                upto = np.concatenate([[0], np.cumsum(each)])
                ends = upto[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
                got = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([b.column(0), lists, got], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_vocabulary()
    return digests(decode(encode(table(spark, sf_dir, "documents"), path, pattern), path))
