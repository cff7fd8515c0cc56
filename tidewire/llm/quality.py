"""Operator 8: quality classifier, an interpolated modified Kneser-Ney model of character n-grams.

The model is trained, for each language, on all trusted texts of one fold (documents labelled good and not toxic;
the fold is a bit of the text's hash, so copies share it): grams of ``ORDER`` characters are counted in numpy per task
and added up by Spark; lower orders count the distinct characters before a gram; discounts come from the counts of
counts; probabilities and back-off weights are joins of these sharded tables. Every character is told apart, and the
tables grow with the trusted texts.

Scoring: a model of at most ``MODEL_ROWS`` rows is sent to every executor once, and texts are scored where they
lie, without a shuffle. A larger one stays in its shards: the distinct grams of the documents are joined with the
tables, order by order, and each document's grams, counted, with the results; the sums are the same. Per-document
perplexity above the ``QUANTILE`` of its language's trusted texts of the other fold, which the model
hasn't seen, rejects a text.

Toxic texts are ordinary prose with marked words, which perplexity doesn't see. A second model weighs words and
their heads by the log ratio of their shares of the labelled toxic and of the trusted texts of the first fold; a text's ``toxicity`` is its
largest weight, and it is rejected, too, if that is above the same quantile of the trusted texts of the other fold.

So that a handful of characters don't decide, a text counts as continued by ``PRIOR`` characters of its
language's mean log probability (over the trusted texts of the other fold).

Defined cases: null and empty texts have no perplexity and are kept, as are texts of a language (null counts as one)
without trusted texts in both folds; labels without a document and null labels are ignored; a document labelled both ways is not
trusted; repeated rows are each judged, and each trusted row counts; an empty table gives an empty result;
texts of any length are taken in pieces of ``PIECE`` characters; other columns are carried or not read, whatever their names.
Grams are looked up by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import Scratch, mix64, release, sized, table

ORDER = 5
QUANTILE = 0.99
PRIOR = 40
#: Sums of doubles depend on their order by less than this part.
SLACK = 1e-9
#: Characters handled at a time.
PIECE = 1 << 19
#: Rows (a key and a number) of a model that is sent to every executor, about 80 MB; larger ones are joined.
MODEL_ROWS = 4_000_000
#: Grams that a task holds before it emits their counts.
HELD = 1_000_000
#: Words that a worker keeps the weights of; the table starts afresh beyond it.
KNOWN = 200_000
#: Stands before every text; a noncharacter, which texts don't hold.
PAD = "\U0010ffff"
#: The lengths of the heads of words, and the toxic texts that a word must be in.
HEADS, SEEN = (4, 5, 6, 7), 3
WORD = re.compile(r"[^\W\d_]+")
STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Pieces of texts: the text of each character, its codes and those before it, keys, and the characters' places.

    ``keys[k]`` holds at each place the 64-bit key of the k characters that end there.
    """
    size = np.array([len(t) for t in texts], np.int64)
    pad = PAD * (ORDER - 1)
    codes = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), size + ORDER - 1)
    real = np.ones(len(codes), bool)
    starts = np.cumsum(size + ORDER - 1) - size - ORDER + 1
    for k in range(ORDER - 1):
        real[starts + k] = False
    for begin in range(ORDER - 1, len(codes), PIECE):
        part = codes[begin - ORDER + 1 : begin + PIECE]
        keys = [np.zeros(len(part), np.uint64)]
        with np.errstate(over="ignore"):
            for k in range(1, ORDER + 1):
                key = np.zeros(len(part), np.uint64)
                key[k - 1 :] = mix64(keys[-1][k - 1 :] * STEP + part[: len(part) - k + 1] + np.uint64(k))
                keys.append(key)
        at = np.flatnonzero(real[begin : begin + PIECE]) + ORDER - 1
        yield owner[begin + at - ORDER + 1], part, keys, at


def keys_of(some: list[str]) -> np.ndarray:
    """The keys of whole grams."""
    out, size = np.zeros(len(some), np.uint64), np.array([len(g) for g in some], np.int64)
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        codes = np.frombuffer("".join(some[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, n + 1):
                h = mix64(h * STEP + codes[:, n - k] + np.uint64(k))
        out[at] = h
    return out.view(np.int64)


def top_counts(trusted: DataFrame) -> DataFrame:
    """lang, g, c: the counts of the highest order. trusted: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def added(lang: str) -> int:
            keys, first, at = np.unique(np.concatenate([x[0] for x in held[lang]]), return_index=True, return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([x[1] for x in held[lang]])).astype(np.int64)
            held[lang] = [(keys, c, np.concatenate([x[2] for x in held[lang]])[first])]
            return len(keys)

        def rows(lang: str) -> pa.RecordBatch:
            added(lang)
            _, c, codes = held[lang][0]
            flat = codes.tobytes().decode("utf-32-le", "surrogatepass")
            g = [flat[k : k + ORDER] for k in range(0, len(flat), ORDER)]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.string()), pa.array(c)], names=["lang", "g", "c"])

        for whole in batches:
            for b in slices(whole, 1, PIECE):
                langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    for _, codes, keys, at in grams([t for x, t in zip(langs, texts, strict=True) if x == lang]):
                        key, first, c = np.unique(keys[ORDER][at], return_index=True, return_counts=True)
                        window = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
                        held.setdefault(lang, []).append((key, c, window[at[first] - ORDER + 1]))
                    if len(held[lang]) >= 8:
                        added(lang)
                if sum(len(x[0]) for parts in held.values() for x in parts) > HELD:
                    if sum(map(added, list(held))) > HELD:
                        for lang in list(held):
                            yield rows(lang)
                        held.clear()
        for lang in list(held):
            yield rows(lang)
        held.clear()
        release()

    counted = trusted.select("lang", "text").mapInArrow(run, "lang string, g string, c long")
    return counted.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def marks(text: str) -> set[str]:
    """The distinct words of a text and their heads."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in HEADS if len(w) > k}


def mark_weights(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, mark, value: weights above 0 of words and heads. labelled: lang, toxic, text, never null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, toxic), seen in held.items():
                n = len(seen)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([toxic] * n), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "toxic", "mark", "c"])
            held.clear()

        for whole in batches:
            for b in slices(whole, 2):
                for lang, toxic, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.setdefault((lang, toxic), Counter()).update(marks(text))
                if sum(map(len, held.values())) > HELD:
                    yield from rows()
        yield from rows()

    count = lambda of, n: F.coalesce(F.sum(F.when(of, n)), F.lit(0)).cast("double")
    toxic, fine = F.col("toxic"), ~F.col("toxic")
    n, _ = scratch.save(labelled.groupBy("lang").agg(count(toxic, F.lit(1)).alias("n_toxic"), count(fine, F.lit(1)).alias("n_fine")))
    seen = labelled.select("lang", "toxic", "text").mapInArrow(run, "lang string, toxic boolean, mark string, c long")
    seen = seen.groupBy("lang", "mark").agg(count(toxic, F.col("c")).alias("t"), count(fine, F.col("c")).alias("f")).where(F.col("t") >= SEEN)
    value = F.log((F.col("t") + 0.5) / (F.col("n_toxic") + 1)) - F.log((F.col("f") + 0.5) / (F.col("n_fine") + 1))
    return scratch.save(seen.join(sized(n), "lang").select("lang", "mark", value.alias("value")).where("value > 0"))[0]


def model_tables(trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, kind, g (the key of a gram), value: of kind k the log probability of a gram of order k, of kind -k the log of the back-off
    weight of a context of a gram of order k; of kind 0 that of any character."""
    saved = [scratch.save(top_counts(trusted))]
    for k in range(ORDER - 1, 0, -1):
        saved.append(scratch.save(saved[-1][0].groupBy("lang", F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("c"))))
    counts = {k: df for k, (df, _) in zip(range(ORDER, 0, -1), saved, strict=True)}
    uniform, path = scratch.save(counts[1].groupBy("lang").agg((-F.log(F.count("*") + 1.0)).alias("value")))
    few = sized(uniform)  # a row for each language
    of = lambda n: F.count_if(F.col("c") == n)
    every = None
    for k, df in counts.items():
        part = df.select(F.lit(k).alias("k"), "lang", "c")
        every = part if every is None else every.unionByName(part)
    n1, n2, n3, n4 = (F.greatest(F.col(f"n{i}"), F.lit(1)).cast("double") for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    inside = lambda d, top: F.least(F.greatest(d, F.lit(0.05)), F.lit(top))
    drops = every.groupBy("k", "lang").agg(*(of(i).alias(f"n{i}") for i in (1, 2, 3, 4)))
    drops = drops.select("k", "lang", inside(1 - 2 * y * n2 / n1, 0.95).alias("d1"), inside(2 - 3 * y * n3 / n2, 1.95).alias("d2"), inside(3 - 4 * y * n4 / n3, 2.95).alias("d3"))
    drops, drops_path = scratch.save(drops)
    drops = sized(drops)  # a row for each order and language
    drop = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    tables = uniform.select("lang", F.lit(0).alias("kind"), F.lit("").alias("g"), "value")
    lower, used = None, [path, drops_path, *(p for _, p in saved)]
    for k in range(1, ORDER + 1):
        grams_ = counts[k].join(drops.where(F.col("k") == k), "lang").select("lang", "g", F.substring("g", 1, k - 1).alias("ctx"), "c", drop.alias("drop"))
        sums = grams_.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("drop").alias("dropped"))
        p = (F.col("c") - F.col("drop")) / F.col("total") + F.col("dropped") / F.col("total") * F.col("p_low")
        both = grams_.join(sums, ["lang", "ctx"])
        if k == 1:
            both = both.join(few.select("lang", F.exp("value").alias("p_low")), "lang")
        else:
            both = both.withColumn("low", F.substring("g", 2, k - 1)).join(lower, ["lang", "low"])
        probs, path = scratch.save(both.select("lang", "g", p.alias("p"), "ctx", F.log(F.col("dropped") / F.col("total")).alias("weight")))
        used.append(path)
        lower = probs.select("lang", F.col("g").alias("low"), F.col("p").alias("p_low"))
        weights = probs.groupBy("lang", "ctx").agg(F.first("weight").alias("value")).select("lang", F.lit(-k).alias("kind"), F.col("ctx").alias("g"), "value")
        tables = tables.unionByName(probs.select("lang", F.lit(k).alias("kind"), "g", F.log("p").alias("value"))).unionByName(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys_of(b.column(2).to_pylist())), b.column(3)], names=["lang", "kind", "g", "value"])

    tables, _ = scratch.save(tables.mapInArrow(run, "lang string, kind int, g long, value double"))
    scratch.drop(*used)
    return tables


class Lookup:
    """Values by 64-bit keys, which are hashes: sorted, and found from where keys with the same first bits begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        self.starts = np.searchsorted(self.keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.starts).max(initial=0))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the values of those."""
        first = (keys >> self.shift).astype(np.int64)
        at, end = self.starts[first], self.starts[first + 1]
        place = np.full(len(keys), -1, np.int64)
        on = np.flatnonzero(at < end)
        for _ in range(self.most):
            if not len(on):
                break
            hit = self.keys[at[on]] == keys[on]
            place[on[hit]] = at[on[hit]]
            on = on[~hit]
            at[on] += 1
            on = on[at[on] < end[on]]
        there = place >= 0
        return there, self.values[place[there]]


class Model:
    """The tables of one language."""

    def __init__(self, kinds: np.ndarray, keys: np.ndarray, values: np.ndarray, weights: dict[str, float] | None = None):
        self.of = {int(k): Lookup(keys[kinds == k], values[kinds == k]) for k in np.unique(kinds)}
        self.weights, self.known = weights or {}, {}

    def log_probabilities(self, keys: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Of the characters at these places of a piece of ``grams``."""
        out, left = np.zeros(len(at)), np.arange(len(at))
        for k in range(ORDER, 0, -1):
            hit, value = self.of[k].find(keys[k][at[left]])
            out[left[hit]] += value
            left = left[~hit]
            if not len(left):
                return out
            known, weight = self.of[-k].find(keys[k - 1][at[left] - 1])
            out[left[known]] += weight
        out[left] += self.of[0].values[0]
        return out

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log probability and the toxicity of each text."""
        sums = np.zeros(len(texts))
        for owner, _, keys, at in grams(texts):
            sums += np.bincount(owner, self.log_probabilities(keys, at), len(texts))
        return sums, np.array([self.toxicity(t) for t in texts])

    def toxicity(self, text: str) -> float:
        """The largest weight of a mark of the text. What is known of words that came before is kept."""
        if not self.weights:
            return 0.0
        if len(self.known) > KNOWN:
            self.known.clear()
        known, words = self.known, set(WORD.findall(text.lower()))
        for w in words.difference(known):
            known[w] = max((self.weights[m] for m in marks(w) if m in self.weights), default=0.0)
        return max(map(known.__getitem__, words), default=0.0)


def models(tables: DataFrame, weights: DataFrame) -> dict[str, Model]:
    """The models by language, on the driver, one language at a time."""
    marked: dict[str, dict[str, float]] = {}
    for r in weights.collect():
        marked.setdefault(r["lang"], {})[r["mark"]] = r["value"]
    out = {}
    for (lang,) in tables.where("kind = 0").select("lang").collect():
        rows = tables.where(F.col("lang") == lang).select("kind", "g", "value").toArrow()
        out[lang] = Model(*(rows.column(c).to_numpy() for c in ("kind", "g", "value")), marked.get(lang))
        del rows
        release()
    return out


SUMS = "struct<n_chars: bigint, log_sum: double, toxicity: double>"
ARROW_SUMS = pa.struct([("n_chars", pa.int64()), ("log_sum", pa.float64()), ("toxicity", pa.float64())])


def scores_in_place(tables: DataFrame, weights: DataFrame):
    """A function of the columns lang and text: ``SUMS``, null where the language has no model."""
    shared = tables.sparkSession.sparkContext.broadcast(models(tables, weights))
    release()

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for langs, texts in batches:
            whole = pa.RecordBatch.from_arrays([langs, texts], names=["lang", "text"])
            if not whole.num_rows:
                yield pa.array([], ARROW_SUMS)
            parts = []
            for b in slices(whole, 1, PIECE):
                of, some = b.column(0).to_pylist(), b.column(1).to_pylist()
                sums, most = np.full(len(some), np.nan), np.full(len(some), np.nan)
                for lang in set(of):
                    at = [i for i, (x, t) in enumerate(zip(of, some, strict=True)) if x == lang and t]
                    if at and (model := shared.value.get(lang)):
                        sums[at], most[at] = model.judge([some[i] for i in at])
                size = pa.array([len(t or "") for t in some], pa.int64())
                numbers = [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in (sums, most)]
                parts.append(pa.StructArray.from_arrays([size, *numbers], fields=list(ARROW_SUMS)))
            if parts:
                yield pa.chunked_array(parts).combine_chunks() if len(parts) > 1 else parts[0]

    # said to be non-deterministic, so that no filter on its result makes Spark compute it twice
    return F.arrow_udf(run, SUMS).asNondeterministic()


def scores_by_joins(texts: DataFrame, tables: DataFrame, weights: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, print, lang, found (``SUMS``) of distinct texts, by joins with the sharded tables. texts: doc_id, print, lang, text, none empty."""
    whole, _ = scratch.save(texts.dropDuplicates(["doc_id", "print", "lang"]))
    names = [f"k{k}" for k in range(1, ORDER + 1)] + [f"c{k}" for k in range(1, ORDER + 1)]

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1, PIECE):
                langs, some = b.column(0).to_pylist(), b.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    for _, _, keys, at in grams([t for x, t in zip(langs, some, strict=True) if x == lang]):
                        at = at[np.unique(keys[ORDER][at], return_index=True)[1]]
                        own = [keys[k][at] for k in range(1, ORDER + 1)] + [keys[k - 1][at - 1] for k in range(1, ORDER + 1)]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *(pa.array(x.view(np.int64)) for x in own)], names=["lang", *names])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 3, PIECE):
                some = b.column(3).to_pylist()
                for owner, _, keys, at in grams(some):
                    pair, c = np.unique(np.rec.fromarrays([owner, keys[ORDER][at].view(np.int64)]), return_counts=True)
                    rows = pa.array(pair.f0)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), pa.array(pair.f1), pa.array(c)], names=["doc_id", "print", "lang", "gram", "c"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 3, PIECE):
                found = [marks(t) for t in b.column(3).to_pylist()]
                rows = pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found]))
                flat = pa.array([m for f in found for m in f], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), flat], names=["doc_id", "print", "lang", "mark"])

    distinct = whole.select("lang", "text").mapInArrow(chains, "lang string, " + ", ".join(f"{n} long" for n in names)).dropDuplicates(["lang", f"k{ORDER}"])
    steps = F.array(*(F.struct(F.lit(s * k).alias("kind"), F.col(f"{c}{k}").alias("g")) for k in range(1, ORDER + 1) for s, c in ((1, "k"), (-1, "c"))), F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("g")))
    asked = distinct.select("lang", F.col(f"k{ORDER}").alias("gram"), F.explode(steps).alias("s")).select("lang", "gram", "s.kind", "s.g")
    met = asked.join(tables, ["lang", "kind", "g"])
    # the highest order found, and the weights of the contexts above it
    top = F.max(F.when(F.col("kind") >= 0, F.struct("kind", "value")))
    contexts = F.collect_list(F.when(F.col("kind") < 0, F.struct((-F.col("kind")).alias("k"), "value")))  # of ORDER rows at most
    above = F.aggregate(F.array_sort("contexts"), F.lit(0.0), lambda a, w: a + F.when(w["k"] > F.col("top.kind"), w["value"]).otherwise(0.0))
    value = met.groupBy("lang", "gram").agg(top.alias("top"), contexts.alias("contexts")).select("lang", "gram", (F.col("top.value") + above).alias("value"))
    value, _ = scratch.save(value)
    each = whole.select("doc_id", "print", "lang", "text").mapInArrow(counted, "doc_id long, print long, lang string, gram long, c long")
    sums = each.join(value, ["lang", "gram"]).groupBy("doc_id", "print", "lang").agg(F.sum(F.col("c") * F.col("value")).alias("log_sum"))
    worst = whole.select("doc_id", "print", "lang", "text").mapInArrow(marked, "doc_id long, print long, lang string, mark string")
    worst = worst.join(weights, ["lang", "mark"]).groupBy("doc_id", "print", "lang").agg(F.max("value").alias("toxicity"))
    sums, _ = scratch.save(sums.select("print", "lang", "doc_id", "log_sum"))
    worst, _ = scratch.save(worst)
    of = lambda df, *more: df.select(F.col("doc_id").alias("d"), F.col("print").alias("p"), F.col("lang").alias("l"), *more)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")) & (F.col("lang") == F.col("l"))
    out = whole.select("doc_id", "print", "lang", F.char_length("text").cast("long").alias("n_chars"))
    out = out.join(of(sums, "log_sum"), same, "left").drop("d", "p", "l").join(of(worst, F.col("toxicity").alias("most")), same, "left")
    toxicity = F.when(F.col("log_sum").isNotNull(), F.coalesce("most", F.lit(0.0)))
    return out.select("doc_id", "print", "lang", F.struct("n_chars", "log_sum", toxicity.alias("toxicity")).alias("found"))


def scorer(tables: DataFrame, weights: DataFrame, scratch: Scratch, model_rows: int):
    """A function of rows (row, doc_id, print, lang, text), which get found (``SUMS``). The model is sent out once, whatever it is used for."""
    if tables.count() + weights.count() <= model_rows:
        in_place = scores_in_place(tables, weights)
        return lambda rows: rows.withColumn("found", in_place("lang", "text"))

    def by_joins(rows: DataFrame) -> DataFrame:
        told = scores_by_joins(rows.where("text != ''").select("doc_id", "print", "lang", "text"), tables, weights, scratch)
        told, _ = scratch.save(told.select(F.col("doc_id").alias("d"), F.col("print").alias("p"), F.col("lang").alias("l"), "found"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("print").eqNullSafe(F.col("p")) & (F.col("lang") == F.col("l"))
        return rows.join(told, same, "left").drop("d", "p", "l")

    return by_joins


def judged(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model_rows: int = MODEL_ROWS
) -> DataFrame:
    """``row`` (a struct of the document's columns), doc_id, lang, print (hash of the text), n_chars, perplexity, threshold, rejected."""
    scratch = Scratch(docs.sparkSession, "quality")
    text = docs[text_col].cast("string")
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"), F.xxhash64(text).alias("print"), text.alias("text")
    )
    fine = (F.col("quality") == 1) & (F.col("toxic") == 0)
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("good_id")).agg(
        F.min(F.coalesce(fine, F.lit(False))).alias("trusted"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    good, _ = scratch.save(good.where("trusted or toxic"))
    known = rows.where("text != ''").join(sized(good), F.col("doc_id") == F.col("good_id")).select(
        F.lit(None).cast("string").alias("row"), "doc_id", "lang", "print", "text", "trusted", "toxic", F.pmod("print", F.lit(2)).cast("int").alias("fold")
    )
    known, path = scratch.save(known)
    tables = model_tables(known.where("trusted and fold = 0"), scratch)
    weights = mark_weights(known.where("fold = 0").select("lang", "toxic", "text"), scratch)
    scored = scorer(tables, weights, scratch, model_rows)
    unseen = scored(known.where("trusted and fold = 1")).select("lang", "found.*")
    unseen, unseen_path = scratch.save(unseen.where("log_sum is not null"))
    means, _ = scratch.save(unseen.groupBy("lang").agg((F.sum("log_sum") / F.sum("n_chars")).alias("mean")))
    perplexity = lambda s: F.exp(-(s("log_sum") + PRIOR * F.col("mean")) / (s("n_chars") + PRIOR))
    limits = unseen.join(sized(means), "lang").groupBy("lang").agg(
        F.percentile_approx(perplexity(F.col), F.lit(quantile), F.lit(10_000)).alias("threshold"), F.first("mean").alias("mean"), F.percentile_approx("toxicity", F.lit(quantile), F.lit(10_000)).alias("most")
    )
    limits, _ = scratch.save(limits)
    scratch.drop(path, unseen_path)
    found = lambda name: F.col(f"found.{name}")
    told = scored(rows).join(sized(limits), "lang", "left")
    told = told.select("row", "doc_id", "lang", "print", F.coalesce(found("n_chars"), F.lit(0)).alias("n_chars"), perplexity(found).alias("perplexity"), F.when(found("log_sum").isNotNull(), F.col("threshold")).alias("threshold"), (found("toxicity") > F.col("most")).alias("foul"))
    return told.select(*(c for c in told.columns if c != "foul"), F.coalesce((F.col("perplexity") > (1 + SLACK) * F.col("threshold")) | F.col("foul"), F.lit(False)).alias("rejected"))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, lang, print (hash of the text), n_chars, perplexity, threshold, rejected: a row for each row of ``docs``."""
    return judged(docs, labels, **options).drop("row")


def drop_rejected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents without the rejected ones."""
    return judged(docs, labels, **options).where("not rejected").select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
