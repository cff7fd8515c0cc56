"""Operator 9: language identification, multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of every labelled text: each task adds up its texts in one row of
``BUCKETS`` for each language and emits the sums, so the shuffle carries a row per task, language and bucket. The
log-probability matrix is broadcast for ``LANGS`` languages at a time (16 MB); more languages are further passes, each of which
keeps the best language so far: the result doesn't depend on how many there are. Texts are scored in batches as sparse rows:
each (text, bucket) once with its count, times the matrix, in pieces of bounded size.

Defined cases: null text or text without a letter is ``und`` with score 0, as are all texts if nothing was
learned; rows with null lang or text teach nothing; of equal scores the first language in order wins; a
null doc_id counts as the empty string for the fold; texts of any length are taken in pieces; every row is judged by itself;
other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import Scratch, table

BUCKETS = 1 << 16
#: Languages of one pass.
LANGS = 32
#: Characters of a piece, and numbers of the matrix gathered at a time.
PIECE, CELLS = 1 << 18, 1 << 21
ORDERS = (1, 2, 3)
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
LETTER = regex.compile(r"\p{L}")
#: Languages added up by a task before it emits their sums.
HELD = 64


def grams(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces: the text and the bucket of every n-gram of the lower-cased texts."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(p) for p in points], np.int64)
    if not size.sum():
        return
    codes, owners = np.concatenate(points), np.repeat(np.arange(len(texts)), size)
    ends = np.cumsum(size)
    for at in range(0, len(codes), PIECE):
        n = min(PIECE, len(codes) - at)
        flat = codes[at : at + n + max(ORDERS) - 1].astype(np.uint64)
        owner = owners[at : at + n]
        left = ends[owner] - np.arange(at, at + n)
        h = np.zeros(n, np.uint64)
        who, what = [], []
        with np.errstate(over="ignore"):
            for j, k in enumerate(ORDERS):
                ahead = np.zeros(n, np.uint64)
                ahead[: len(flat) - k + 1] = flat[k - 1 : k - 1 + n]
                h = (h + ahead + np.uint64(k)) * MULTIPLIERS[j]
                h ^= h >> np.uint64(29)
                inside = left >= k  # n-grams don't run over a text's end
                who.append(owner[inside])
                what.append((h[inside] % np.uint64(buckets)).astype(np.int64))
        yield np.concatenate(who), np.concatenate(what)


def sparse_scores(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """The sums of the log probabilities of each text's n-grams in each language (columns of ``logs``)."""
    out = np.zeros((len(texts), logs.shape[1]))
    step = max(1, CELLS // max(1, logs.shape[1]))
    for who, what in grams(texts, len(logs)):
        keys = np.sort(who * len(logs) + what)
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.diff(first, append=len(keys)).astype(float)
        text, bucket = np.divmod(keys[first], len(logs))
        for k in range(0, len(text), step):
            some = text[k : k + step]
            begins = np.flatnonzero(np.diff(some, prepend=-1))
            out[some[begins]] += np.add.reduceat(logs[bucket[k : k + step]] * counts[k : k + step, None], begins, axis=0)
    return out


def count(labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """lang, bucket, n, with the number of texts in bucket -1. labelled: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, sums in held.items():
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32) - 1), pa.array(sums[at])], names=["lang", "bucket", "n"]
                )
            held.clear()

        for whole in batches:
            for b in slices(whole, 1):
                langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    mine = [t for g, t in zip(langs, texts, strict=True) if g == lang and t]
                    if not mine:
                        continue
                    sums = held.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    for _, found in grams(mine, buckets):
                        sums += np.bincount(found + 1, minlength=buckets + 1)
                    sums[0] += len(mine)
                if len(held) >= HELD:
                    yield from emit()
        yield from emit()

    counted = labelled.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The model: lang, bucket, n, with the number of texts in bucket -1; ``BUCKETS`` rows a language at most."""
    labelled = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    return Scratch(docs.sparkSession, "languages").save(count(labelled.where("lang is not null and text is not null and text != ''")))[0]


def matrices(model: DataFrame, langs_at_once: int = LANGS) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """For so many languages at a time, in order: their names, the log probability of each bucket (rows) in each, and the log priors."""
    texts = {r["lang"]: r["n"] for r in model.where("bucket = -1").collect()}  # a row for each language
    langs = sorted(texts)
    for k in range(0, len(langs), langs_at_once):
        some = langs[k : k + langs_at_once]
        rows = model.where(F.col("lang").isin(some) & (F.col("bucket") >= 0)).toArrow()
        sums = np.zeros((BUCKETS, len(some)))
        at = np.searchsorted(np.array(some, object), np.array(rows.column("lang").to_pylist(), object))
        sums[rows.column("bucket").to_numpy(), at] = rows.column("n").to_numpy()
        prior = np.log(np.array([texts[x] for x in some]) / sum(texts.values()))
        yield some, np.log((sums + 0.5) / (sums.sum(axis=0) + 0.5 * BUCKETS)), prior


STATE = "lang_pred string, top double, total double"


def predict(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", langs_at_once: int = LANGS) -> DataFrame:
    """doc_id, lang_pred, score: the winner's posterior probability."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "predicted")
    frame = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    frame = frame.selectExpr("doc_id", "text", "'und' as lang_pred", "cast(null as double) as top", "cast(null as double) as total")
    old = None
    for k, part in enumerate(matrices(model, langs_at_once)):
        if k:
            last, (frame, old) = old, scratch.save(frame)
            if last:
                scratch.drop(last)
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            langs, logs, prior = shared.value
            for whole in batches:
                for b in slices(whole, 1, PIECE):
                    texts, told = b.column(1).to_pylist(), b.column(2).to_pylist()
                    top, total = (b.column(c).fill_null(-np.inf).to_numpy(zero_copy_only=False).copy() for c in (3, 4))
                    real = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
                    if real:
                        sums = sparse_scores([texts[i] for i in real], logs) + prior
                        best = sums.argmax(axis=1)
                        most = sums.max(axis=1)
                        total[real] = np.logaddexp(total[real], most + np.log(np.exp(sums - most[:, None]).sum(axis=1)))
                        for i, at, x in zip(real, best, most, strict=True):
                            if x > top[i]:
                                told[i], top[i] = langs[at], x
                    numbers = [pa.array(x, pa.float64(), mask=np.isneginf(x)) for x in (top, total)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(told, pa.string()), *numbers], names=["doc_id", "text", "lang_pred", "top", "total"])

        frame = frame.mapInArrow(run, f"doc_id long, text string, {STATE}")
    return frame.select("doc_id", "lang_pred", F.when(F.col("top").isNull(), 0.0).otherwise(F.least(F.exp(F.col("top") - F.col("total")), F.lit(1.0))).alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
