"""Operator 12: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt from labelled texts: words, and heads of words for languages that build many forms, weighed by the log ratio of
their shares of toxic and other texts. The features are densities of light and strong lexicon words, their nearness to words in the second
person, capitals, punctuation, repeated letters and obfuscated words (letters replaced by digits and signs, or spread by dots), and whether these
spell a lexicon word. Trees and calibration are Spark's own.

A classifier of this kind needs no more than ``MAX_LABELLED`` labelled texts, the documented bound of its sample (those of the smallest hashes;
lexicon and fit read nothing else). Of texts that share a sketch (the smallest hash of their runs of three words: copies
and most near copies do) one teaches, so a group of copies is one voice. The sketch also deals the texts into ``FOLDS``: a
text's features are those of the lexicon of the other folds, and the calibration is fitted to the scores of trees grown on the other folds, so neither
has seen the text. Scoring is one pass over the documents where they lie.

Defined cases: null and empty texts have no words and are scored like any other; labels that are null or have no document or a null id teach nothing; a document
labelled both ways is toxic; of documents of one id each different sketch teaches; where the sample has texts of one class only, all scores are the
share of toxic ones, and 0 without any; an empty table gives an empty result; every row is judged by itself; texts of any length are
taken whole, in pieces of ``PIECE`` characters (nearness isn't seen across two pieces); other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import Scratch, table

MAX_LABELLED = 10_000
FOLDS = 3
THRESHOLD = 0.7
TREES, DEPTH, STEP = 12, 3, 0.3
#: The lengths of heads, and the toxic texts that a lexicon word must be in.
HEADS, SEEN = (4, 5, 6, 7, 8), 3
#: Log ratios from which a word is a light or a strong one.
LIGHT, STRONG = 2.0, 4.0
#: Words between a lexicon word and one in the second person, at most.
NEAR = 6
PIECE = 1 << 19
#: Words that a worker keeps the weights of, and marks that it holds before it emits their counts.
KNOWN, HELD = 200_000, 1_000_000
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros".split())
WORD = re.compile(r"[^\W\d_]+")
#: Letters around or after digits and signs, and letters spread by dots.
DISGUISED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]++[0-9@$*!|]++[^\W\d_][\w@$*!|]*+|(?<![\w@$])[@$0-9]++[^\W\d_]{2}[\w@$!|]*+|(?:[^\W\d_][.*_-]){3,}+[^\W\d_](?![^\W\d_]))")
PLAIN = str.maketrans("013457@$!|", "oieastasii")

UNITS = np.array([chr(c).isalpha() for c in range(0x3000)]), np.array([chr(c).isupper() for c in range(0x3000)]), np.array([not chr(c).isalnum() and not chr(c).isspace() and c > 32 for c in range(0x3000)])
NAMES = ("length", "light", "strong", "heads", "weight", "largest", "hits", "different", "near_you", "you", "capitals", "capital_runs", "punctuation", "shouting", "stretched", "disguised", "unmasked")


def parts(text: str | None) -> Iterator[str]:
    """Pieces of the lower-cased text, cut between words where that is possible."""
    text, start = text or "", 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            gap = max(text.rfind(" ", start + PIECE // 2, end), text.rfind("\n", start + PIECE // 2, end))
            end = gap + 1 if gap > 0 else end
        yield text[start:end]
        start = end


def marks(text: str) -> set[str]:
    """The text's distinct words, and their heads."""
    words: set[str] = set()
    for piece in parts(text):
        words.update(WORD.findall(piece.lower()))
    return words | {w[:k] + "*" for w in words for k in HEADS if len(w) >= k}


def sketch(text: str) -> int:
    """The smallest hash of three words in a row (of all, if fewer); 0 without words."""
    least = None
    for piece in parts(text):
        words = WORD.findall(piece.lower())
        runs = zip(words, islice(words, 1, None), islice(words, 2, None), strict=False) if len(words) > 2 else [words] if words else []
        low = min((zlib.crc32(" ".join(r).encode("utf-8", "surrogatepass")) for r in runs), default=None)
        least = low if least is None else least if low is None else min(least, low)
    return least or 0


class Features:
    """The dense features of texts under a lexicon: mark to weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def weights(self, word: str) -> tuple[float, float]:
        """The weights of a word and of its strongest head."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            get = self.lexicon.get
            found = self.known[word] = get(word, 0.0), max((get(word[:k] + "*", 0.0) for k in HEADS if len(word) >= k), default=0.0)
        return found

    def of(self, text: str | None) -> list[float]:
        n = letters = chars = upper = runs = signs = loud = stretched = you = near = light = strong = heads = disguised = unmasked = 0
        weight, largest, different = 0.0, 0.0, set()
        for piece in parts(text):
            codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.minimum(codes, 0x2FFF)
            letter, capital, sign = (u[at] for u in UNITS)
            chars, letters, upper, signs = chars + len(codes), letters + int(letter.sum()), upper + int(capital.sum()), signs + int(sign.sum())
            runs += int((capital[1:] & capital[:-1]).sum())
            loud += piece.count("!") + piece.count("?")
            stretched += int((letter[2:] & (codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])).sum())
            low = piece.lower()
            words = WORD.findall(low)
            n += len(words)
            hits, addressed = [], []
            for place, w in enumerate(words):
                own, head = self.weights(w)
                if w in SECOND_PERSON:
                    addressed.append(place)
                most = max(own, head)
                if most >= LIGHT:
                    light += own >= LIGHT
                    heads += head >= STRONG
                    weight += most
                    largest = max(largest, most)
                    if most >= STRONG:
                        strong += own >= STRONG
                        different.add(w)
                        hits.append(place)
            you += len(addressed)
            if hits and addressed:
                others = np.array([-(2**60), *addressed, 2**60])
                after = np.searchsorted(others, hits)
                near += int((np.minimum(others[after] - hits, hits - others[after - 1]) <= NEAR).sum())
            for found in DISGUISED.findall(low):
                disguised += 1
                spelt = "".join(WORD.findall(found.translate(PLAIN)))
                unmasked += max(self.weights(spelt)) >= STRONG
        each, of_letters, of_chars = 1 / max(n, 1), 1 / max(letters, 1), 1 / max(chars, 1)
        return [
            float(np.log1p(n)), light * each, strong * each, heads * each, weight * each, largest, float(np.log1p(strong + heads)), float(np.log1p(len(different))), near * each, you * each,
            upper * of_letters, runs * of_letters, signs * of_chars, loud * of_chars, stretched * of_letters, disguised * each, unmasked * each,
        ]


def prints(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sampled(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """A written table of toxic, fold and text, of ``most`` rows at most. docs: doc_id, text; labels: doc_id, toxic, both never null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 3):
                drawn = pa.array([sketch(t or "") for t in b.column(3).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], drawn], names=["doc_id", "toxic", "print", "sketch"])

    ids = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids, _ = scratch.save(ids)
    known = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", prints(F.col("text")).alias("print"), "text")
    drawn = known.mapInArrow(run, "doc_id long, toxic int, print long, sketch long")
    one = drawn.groupBy("sketch").agg(F.max("toxic").alias("toxic"), F.min(F.struct((1 - F.col("toxic")).alias("no"), "doc_id", "print")).alias("row"))
    one = one.select("row.doc_id", "row.print", "toxic", F.pmod(F.xxhash64("sketch"), F.lit(FOLDS)).cast("int").alias("fold"))
    one, _ = scratch.save(one.orderBy(F.xxhash64("doc_id", "print"), "doc_id", "print").limit(most))
    texts = docs.select("doc_id", prints(F.col("text")).alias("print"), "text").join(F.broadcast(one), ["doc_id", "print"])
    return scratch.save(texts.groupBy("doc_id", "print", "toxic", "fold").agg(F.first("text").alias("text")).select("toxic", "fold", "text"))[0]


def lexicons(known: DataFrame) -> list[dict[str, float]]:
    """A lexicon from all texts but a fold's, for each fold, and one from all. The sample bounds their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Counter] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (toxic, fold), seen in held.items():
                n = len(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([toxic] * n, pa.int32()), pa.array([fold] * n, pa.int32()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                    names=["toxic", "fold", "mark", "c"],
                )
            held.clear()

        for whole in batches:
            for b in slices(whole, 2):
                for toxic, fold, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.setdefault((toxic, fold), Counter()).update(marks(text or ""))
                if sum(map(len, held.values())) > HELD:
                    yield from emit()
        yield from emit()

    texts = {(r["toxic"], r["fold"]): r["count"] for r in known.groupBy("toxic", "fold").count().collect()}
    seen = known.select("toxic", "fold", "text").mapInArrow(run, "toxic int, fold int, mark string, c long")
    each = [F.sum(F.when((F.col("toxic") == x) & (F.col("fold") == k), F.col("c")).otherwise(0)).alias(f"c{x}{k}") for x in (0, 1) for k in range(FOLDS)]
    rows = seen.groupBy("mark").agg(*each).where(" + ".join(f"c1{k}" for k in range(FOLDS)) + f" >= {SEEN}").toArrow()
    names = rows.column("mark").to_pylist()
    out = []
    for left_out in [*range(FOLDS), None]:
        folds = [k for k in range(FOLDS) if k != left_out]
        counts = [sum((rows.column(f"c{x}{k}").to_numpy().astype(float) for k in folds), np.zeros(len(names))) for x in (0, 1)]
        totals = [sum(texts.get((x, k), 0) for k in folds) for x in (0, 1)]
        value = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))
        out.append({names[i]: float(value[i]) for i in np.flatnonzero((value >= LIGHT) & (counts[1] >= SEEN))})
    return out


def featured(rows: DataFrame, lexicons: list[dict[str, float]], schema: str) -> DataFrame:
    """rows: others, fold, text. Others and ``features``; the fold says whose lexicon, null that of all."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [Features(x) for x in shared.value]
        for whole in batches:
            for b in slices(whole, b_text := whole.num_columns - 1):
                found = [each[-1 if k is None else k].of(t) for k, t in zip(b.column(b_text - 1).to_pylist(), b.column(b_text).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:b_text], pa.array(found, pa.list_(pa.float64()))], names=[*b.schema.names[:b_text], "features"])

    return rows.mapInArrow(run, f"{schema}, fold int, features array<double>").withColumn("features", array_to_vector("features"))


class Model:
    """A lexicon, trees and their calibration; or one score for all texts."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, score."""
        rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.lit(None).cast("int").alias("fold"), docs[text_col].cast("string").alias("text"))
        if self.trees is None:
            return rows.select("doc_id", F.lit(self.constant).alias("score"))
        told = margin(self.trees, featured(rows, [self.lexicon], "doc_id long"))
        told = self.calibration.transform(told) if self.calibration is not None else told.withColumn("calibrated", F.col("margin"))
        return told.select("doc_id", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)).alias("score"))


def margin(trees, rows: DataFrame) -> DataFrame:
    told = trees.transform(rows).withColumn("margin", vector_to_array("probability")[1])
    return told.drop("rawPrediction", "probability", "prediction")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("doc_id is not null")
    told = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["toxic"] == 1).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = sampled(rows, told, scratch, most)
    made = lexicons(known)
    data, _ = scratch.save(featured(known.select("toxic", "fold", "text"), made, "toxic int").withColumn("label", F.col("toxic").cast("double")))
    counts = {(r["fold"], r["toxic"]): r["count"] for r in data.groupBy("fold", "toxic").count().collect()}
    toxic, fine = (sum(c for (_, x), c in counts.items() if x == y) for y in (1, 0))
    if not toxic or not fine:
        scratch.drop(scratch.base)
        return Model(made[-1], constant=toxic / max(1, toxic + fine))
    data = data.coalesce(1).sortWithinPartitions(F.xxhash64(vector_to_array("features")), "toxic")  # of bounded size, and in one order, so one model
    grow = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=3, maxBins=64, seed=1)
    whole = [k for k in range(FOLDS) if all(any(counts.get((j, x)) for j in range(FOLDS) if j != k) for x in (0, 1))]
    with ThreadPool(FOLDS + 1) as pool:  # a fit is many small jobs
        trees, *others = pool.map(lambda k: grow.fit(data if k is None else data.where(F.col("fold") != k)), [None, *whole])
    judged = [margin(other, data.where(F.col("fold") == k)).select("margin", "label") for other, k in zip(others, whole, strict=True)]
    judged = reduce(DataFrame.unionByName, judged) if judged else None
    calibration = None
    if judged is not None and judged.agg(F.count_distinct("label")).first()[0] == 2:
        calibration = IsotonicRegression(featuresCol="margin", predictionCol="calibrated").fit(judged)
    scratch.drop(scratch.base)
    return Model(made[-1], trees, calibration)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.where(~held_out(docs["doc_id"])), labels.where(~held_out(labels["doc_id"])))
    scored = model.score(docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
