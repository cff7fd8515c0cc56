"""Operator 4: line dedup by pairwise alignment.

Lines are hashed (trimmed, blank ones left out). A document is aligned with the earlier ones by patience diff on the
lines that both hold: equal heads and tails, then lines unique on both sides in longest increasing order, then the gaps
between them; a gap without such lines is aligned by a longest common subsequence. Lines aligned with any earlier document are put together, and those that form blocks of
consecutive lines with at least ``MIN_WORDS`` words are deleted from it, the later document.

With ``whole`` the result is that of the alignment with every earlier document; pairs that can't add to it are left out:
lines of one document play no part; of documents with equal sequences of shared lines only the first is aligned
with later ones, and its later copies lose all these lines; a document meets the first holders of its lines, and then
only documents that hold a line of it that is still open, those that hold it most often first, in growing
rounds until no line is open or no holder is left; blank lines don't end a block. Without ``whole`` they do, and a line pairs its document with the line's first holder only, on the
lines for which they were paired.

Defined cases: null text stays null and empty text empty; "later" is the larger doc_id, so rows of one doc_id don't
shorten each other, and rows without a doc_id neither lose nor give lines; equal rows lose the same lines; a document whose last
non-blank line goes is left with empty or blank text (``drop_emptied`` takes such documents out); an empty table
gives an empty result; other columns are carried whatever their names. Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import Scratch, joined_where_needed, sized, table

MIN_WORDS = 5
#: Partners that one row carries to an alignment.
PARTNERS = 64

DELETED = "deleted array<int>, flags array<boolean>, partners array<long>"


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs sorted by their first place, the longest run whose second places rise (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[pile], at[pile] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of a with each head of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def longest(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in memory that grows with the two lengths only (Hirschberg)."""
    codes = {x: k for k, x in enumerate(set(a) & set(b))}
    at, bt = [i for i, x in enumerate(a) if x in codes], [j for j, x in enumerate(b) if x in codes]
    u, v = np.array([codes[a[i]] for i in at], np.int64), np.array([codes[b[j]] for j in bt], np.int64)
    out, todo = [], [(0, len(u), 0, len(v))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and u[i] == v[j]:
            out.append((at[i], bt[j]))
            i, j = i + 1, j + 1
        if i == m or j == n:
            continue
        if m - i == 1:
            hit = np.flatnonzero(v[j:n] == u[i])
            if len(hit):
                out.append((at[i], bt[j + int(hit[0])]))
            continue
        half = (i + m) // 2
        cut = j + int(np.argmax(lengths(u[i:half], v[j:n]) + lengths(u[half:m][::-1], v[j:n][::-1])[::-1]))
        todo += [(i, half, j, cut), (half, m, cut, n)]
    return sorted(out)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of two sequences."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(a[i:m], i) if in_a[x] == 1 and in_b.get(x) == 1}
        anchors = increasing([(k, place[x]) for k, x in enumerate(b[j:n], j) if x in place])
        if anchors:
            i0, j0 = i, j
            for y, x in [*anchors, (n, m)]:
                todo.append((i0, x, j0, y))
                if y < n:
                    out.append((x, y))
                i0, j0 = x + 1, y + 1
        else:
            out += [(i + x, j + y) for x, y in longest(a[i:m], b[j:n])]
    return sorted(out)


def blocks_to_delete(lines: list[tuple[int, int]], min_words: int) -> list[int]:
    """Of aligned lines (place, words), those in blocks of consecutive places with enough words."""
    out: list[int] = []
    block: list[tuple[int, int]] = []
    for line in [*sorted(set(lines)), (-9, 0)]:
        if block and line[0] != block[-1][0] + 1:
            if sum(w for _, w in block) >= min_words:
                out += [p for p, _ in block]
            block = []
        block.append(line)
    return out


def aligned(documents: DataFrame, min_words: int) -> DataFrame:
    """doc_id, print, deleted (places), flags (of all places up to the last), partners. documents: shared: array of (first, hash, words, here, there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            deleted, flags, partners = [], [], []
            for shared in b.column(2).to_pylist():
                by: dict[int, list[dict]] = {}
                for s in shared:
                    by.setdefault(s["first"], []).append(s)
                gone, of = [], {}
                for first, mine in by.items():
                    here = sorted((p, s["hash"]) for s in mine for p in s["here"])
                    there = sorted((p, s["hash"]) for s in mine for p in s["there"])
                    words = {s["hash"]: s["words"] for s in mine}
                    for _, y in patience([h for _, h in there], [h for _, h in here]):
                        gone.append((here[y][0], words[here[y][1]]))
                        of[here[y][0]] = first
                places = blocks_to_delete(gone, min_words)
                deleted.append(places)
                chosen = set(places)
                flags.append([p in chosen for p in range(max(places, default=-1) + 1)])
                partners.append(sorted({of[p] for p in places}))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(deleted, pa.list_(pa.int32())), pa.array(flags, pa.list_(pa.bool_())), pa.array(partners, pa.list_(pa.int64()))],
                names=["doc_id", "print", "deleted", "flags", "partners"],
            )

    return documents.select("doc_id", "print", "shared").mapInArrow(run, f"doc_id long, print long, {DELETED}")


def met(documents: DataFrame) -> DataFrame:
    """doc_id, print, places, partners: aligned places and the first partner of each. documents: core, open (places), theirs: array of (e, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 4):
                places, partners = [], []
                for core, wanted, theirs in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    own, left, of = {c["hash"] for c in core}, set(wanted), {}
                    for e in sorted(theirs, key=lambda e: e["e"]["doc_id"]):
                        there = [h for h in e["hashes"] if h in own]
                        both = set(there)
                        here = [(c["place"], c["hash"]) for c in core if c["hash"] in both]
                        for _, y in patience(there, [h for _, h in here]):
                            of.setdefault(here[y][0], e["e"]["doc_id"])
                            left.discard(here[y][0])
                        if not left:
                            break
                    places.append(list(of))
                    partners.append(list(of.values()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(places, pa.list_(pa.int32())), pa.array(partners, pa.list_(pa.int64()))], names=["doc_id", "print", "places", "partners"]
                )

    return documents.select("doc_id", "print", "core", "open", "theirs").mapInArrow(run, "doc_id long, print long, places array<int>, partners array<long>")


def meet(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """``met`` for documents and arrays of their partners. pairs: doc_id, print, open, es; told: as in ``repeated_passages``."""
    pairs = pairs.select("doc_id", "print", "open", F.posexplode("es").alias("n", "e")).withColumn("part", F.floor(F.col("n") / PARTNERS))
    reps = told.where("rep.doc_id = doc_id and rep.print = print").select(F.col("rep").alias("e"), F.col("core.hash").alias("hashes"))
    theirs = pairs.join(reps, "e").groupBy("doc_id", "print", "part").agg(F.first("open").alias("open"), F.collect_list(F.struct("e", "hashes")).alias("theirs"))
    return met(theirs.join(told.select("doc_id", "print", "core"), ["doc_id", "print"]))


def chosen(documents: DataFrame, min_words: int) -> DataFrame:
    """As ``aligned``. documents: core, found: array of (places, partners), rep (null in found: all lines are aligned with it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            deleted, flags, partners = [], [], []
            for core, found, rep in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                of: dict[int, int] = {}
                for f in found if found is not None else [{"places": [c["place"] for c in core], "partners": [rep] * len(core)}]:
                    for p, e in zip(f["places"], f["partners"], strict=True):
                        of[p] = min(of.get(p, e), e)
                at = {c["rank"]: c["place"] for c in core if c["place"] in of}
                places = [at[r] for r in blocks_to_delete([(c["rank"], c["words"]) for c in core if c["place"] in of], min_words)]
                gone = set(places)
                deleted.append(places)
                flags.append([p in gone for p in range(max(places, default=-1) + 1)])
                partners.append(sorted({of[p] for p in places}))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(deleted, pa.list_(pa.int32())), pa.array(flags, pa.list_(pa.bool_())), pa.array(partners, pa.list_(pa.int64()))],
                names=["doc_id", "print", "deleted", "flags", "partners"],
            )

    return documents.select("doc_id", "print", "core", "found", F.col("rep.doc_id").alias("rep")).mapInArrow(run, f"doc_id long, print long, {DELETED}")


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, print, place, rank (place among those lines), hash, words of every line that isn't blank."""
    text = docs[text_col].cast("string")
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("place"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("line")))
    whole = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), F.posexplode(F.filter(lines, lambda x: x["line"] != "")).alias("rank", "at"))
    return whole.where("doc_id is not null").select("doc_id", "print", "at.place", "rank", F.xxhash64("at.line").alias("hash"), F.size(F.split("at.line", r"\s+")).alias("words"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """As ``repeated_lines``, from the alignment with every earlier document."""
    scratch = Scratch(docs.sparkSession, "passages")
    lines, raw = scratch.save(line_table(docs, id_col, text_col))
    owner = F.struct("doc_id", "print")
    firsts = lines.groupBy("hash").agg(F.min(owner).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    shared = lines.join(firsts.select("hash", "first"), "hash")
    core = shared.groupBy("doc_id", "print").agg(F.sort_array(F.collect_set(F.struct("place", "rank", "hash", "words", "first"))).alias("core"))
    core, cut = scratch.save(core.withColumns({"k1": F.xxhash64("core.hash"), "k2": F.xxhash64(F.lit(1), "core.hash")}))
    scratch.drop(raw)
    told, _ = scratch.save(core.join(core.groupBy("k1", "k2").agg(F.min(owner).alias("rep")), ["k1", "k2"]).drop("k1", "k2"))
    scratch.drop(cut)
    earlier = F.filter("core", lambda c: c["first"]["doc_id"] < F.col("doc_id"))
    own = told.where("rep.doc_id = doc_id").select("doc_id", "print", "core", earlier.alias("earlier")).where("size(earlier) > 0")
    pairs = own.select("doc_id", "print", F.col("earlier.place").alias("open"), F.array_distinct("earlier.first").alias("es"))
    found, _ = scratch.save(meet(pairs, told))
    known = found.groupBy("doc_id", "print").agg(F.flatten(F.collect_list("places")).alias("places"))
    left = own.join(known, ["doc_id", "print"], "left").withColumn("open", F.array_except("earlier.place", F.coalesce("places", F.array().cast("array<int>"))))
    left = left.where("size(open) > 0").select("doc_id", "print", F.explode(F.filter("earlier", lambda c: F.array_contains("open", c["place"]))).alias("c"))
    left, _ = scratch.save(left.select("doc_id", "print", "c.place", "c.hash"))
    all_found = found
    if not left.isEmpty():
        holders = told.where("rep.doc_id = doc_id and rep.print = print").select(F.col("rep").alias("e"), F.explode("core.hash").alias("hash"))
        holders = holders.join(left.select("hash").distinct(), "hash", "left_semi").groupBy("hash", "e").agg(F.count("*").alias("n"))
        holders, _ = scratch.save(holders.withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("n"), "e"))))
        last, low = holders.agg(F.max("rank")).first()[0], 1
        while low <= last:
            some = holders.where((F.col("rank") >= low) & (F.col("rank") < 8 * low))
            tried = left.join(some, "hash").where("e.doc_id < doc_id").groupBy("doc_id", "print").agg(F.collect_set("place").alias("open"), F.collect_set("e").alias("es"))
            found, _ = scratch.save(meet(tried, told))
            all_found = all_found.unionByName(found)
            left, _ = scratch.save(left.join(found.select("doc_id", "print", F.explode("places").alias("place")), ["doc_id", "print", "place"], "left_anti"))
            low *= 8
            if left.isEmpty():
                break
    grouped = all_found.where("size(places) > 0").groupBy("doc_id", "print").agg(F.collect_list(F.struct("places", "partners")).alias("found"))
    both = told.join(grouped, ["doc_id", "print"], "left").where("rep.doc_id < doc_id or found is not null")
    return chosen(both, min_words).where("size(deleted) > 0")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, print (hash of the text), deleted, partners of the documents with lines to delete."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines, _ = scratch.save(line_table(docs, id_col, text_col))
    owner = F.struct("doc_id", "print")
    firsts = lines.groupBy("hash").agg(F.min(owner).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    shared, _ = scratch.save(lines.join(firsts.select("hash", "first"), "hash"))
    there = shared.where((F.col("doc_id") == F.col("first.doc_id")) & (F.col("print") == F.col("first.print")))
    there = there.groupBy("hash").agg(F.collect_set("place").alias("there"))
    here = shared.where(F.col("doc_id") > F.col("first.doc_id")).groupBy("doc_id", "print", "hash", F.col("first.doc_id").alias("first"))
    here = here.agg(F.collect_set("place").alias("here"), F.first("words").alias("words"))
    both = here.join(there, "hash").groupBy("doc_id", "print")
    grouped = both.agg(F.collect_list(F.struct("first", "hash", "words", "here", "there")).alias("shared"))
    return aligned(grouped, min_words).where("size(deleted) > 0")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """``row`` (a struct of the document's columns, its text shortened), n_lines, deleted and partners."""
    scratch = Scratch(docs.sparkSession, "deleted")
    found, _ = scratch.save((repeated_passages if whole else repeated_lines)(docs, id_col, text_col, min_words))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("print").alias("_print"), "deleted", "flags", "partners")
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs[id_col].cast("long").alias("_of"), F.xxhash64(docs[text_col].cast("string")).alias("_own"))
    rows = joined_where_needed(rows, "_of", found, (F.col("_of") == F.col("found_id")) & (F.col("_own") == F.col("_print")), scratch)
    rows = rows.withColumn("_text", F.col("row")[text_col].cast("string"))
    lines, last = F.split("_text", "\n"), F.size("flags")
    left = F.array_join(F.filter(lines, lambda _, i: (i >= last) | ~F.get("flags", i)), "\n")
    text = F.when(F.col("flags").isNull(), F.col("_text")).otherwise(left)
    return rows.select(
        F.struct(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns)).alias("row"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"),
        F.coalesce("partners", F.array().cast("array<long>")).alias("partners"),
    )


def drop_emptied(deduped: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents of ``dedup_lines`` without those of which every non-blank line was deleted."""
    return deduped.where((F.size("deleted") == 0) | F.col("row")[text_col].rlike(r"\S")).select("row.*")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return found.select(
        "row.doc_id",
        "n_lines",
        F.size("deleted").cast("long").alias("n_deleted"),
        F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted"),
        "partners",
        F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"),
    )
