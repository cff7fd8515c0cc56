"""Extractive summaries: sentence graph, TextRank, and the choice of what to summarise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from tidewire.functions.rules import STOP_WORDS
from tidewire.functions.segment import Dictionary, tokens_of_all
from tidewire.functions.slices import by_slices, slices
from tidewire.functions.text import ellipsis, is_cjk, strip, tokens, useful_sentences
from tidewire.operators.scoring import computed, let

TOP = 5
MOST = 500
TRANSLATED = 1500
#: Numbers of a block of a text's sentence graph, and weights that are kept: some 100 MB.
CELLS, KEPT = 2_000_000, 4_000_000


def tokens_of(sentences: Column, dictionary: Dictionary | None) -> Column:
    """The tokens of each sentence of an array; Chinese ones by the dictionary, or bigrams without one."""
    return F.transform(sentences, lambda s: tokens(s, STOP_WORDS)) if dictionary is None else tokens_of_all(sentences, STOP_WORDS, dictionary)


def sentence_table(docs: DataFrame, text: str = "text", dictionary: Dictionary | None = None) -> DataFrame:
    """ord, pos, sentence, tokens: a row for each useful sentence."""
    rows = docs.select("ord", F.posexplode(useful_sentences(F.coalesce(text, F.lit("")))).alias("pos", "sentence"))
    if dictionary is None:
        return rows.withColumn("tokens", tokens(F.col("sentence"), STOP_WORDS))
    return rows.withColumn("tokens", F.get(tokens_of(F.array("sentence"), dictionary), 0))


class Sentences:
    """The sentences of many texts, numbered through: their ``text``, ``size`` in words, words (by ``owner``) and place in their text."""

    def __init__(self, texts: pa.Array):
        many = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sentences = texts.flatten()
        self.n, self.texts = len(sentences), len(texts)
        self.of_text = np.concatenate([[0], np.cumsum(many)])
        self.text = np.repeat(np.arange(len(many)), many)
        self.place = np.arange(self.n) - self.of_text[self.text]
        self.size = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = np.repeat(np.arange(self.n), self.size)
        self.words = sentences.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of pairs (i before j) of a text's sentences that share a word, with their Jaccard weights, by i and j.

        Sentences meet over their words, ``CELLS`` times in a block at most, or in one sentence's row.
        """
        if not len(self.words):
            return
        key = self.text[self.owner] * (self.words.max() + 1) + self.words
        order = np.argsort(key, kind="stable")
        holders, key = self.owner[order], key[order]
        bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        next_, later = np.empty((2, len(key)), np.int64)
        next_[order] = np.arange(1, len(key) + 1)
        later[order] = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(1, len(key) + 1)  # sentences behind this one that hold the word
        of_sentence = np.concatenate([[0], np.cumsum(self.size)])
        met = np.concatenate([[0], np.cumsum(later)])[of_sentence]
        start = 0
        while start < self.n:
            end = max(start + 1, int(np.searchsorted(met, met[start] + CELLS, "right")) - 1)
            some = np.arange(of_sentence[start], of_sentence[end])
            reached = lambda part: holders[np.repeat(next_[part] - np.cumsum(later[part]) + later[part], later[part]) + np.arange(later[part].sum())]
            if met[end] - met[start] > CELLS:
                row = np.zeros(self.of_text[self.text[start] + 1] - start, np.int64)
                for part in np.array_split(some, -(-int(met[end] - met[start]) // CELLS)):
                    row += np.bincount(reached(part) - start, minlength=len(row))
                j = np.flatnonzero(row)
                i, j, common = np.full(len(j), start), j + start, row[j]
            else:
                both, common = np.unique(np.repeat(self.owner[some], later[some]) * self.n + reached(some), return_counts=True)
                i, j = np.divmod(both, self.n)
            if len(i):
                yield i, j, common / (self.size[i] + self.size[j] - common)
            start = end


def sentence_similarity(docs: DataFrame, text: str = "text", dictionary: Dictionary | None = None) -> DataFrame:
    """ord, i, j, weight: Jaccard similarity of each document's pairs of sentences that share a token.

    Sentences meet over their tokens, within their document, so pairs without a common token are never made; documents aren't exchanged for that.
    """
    rows = docs.where("ord is not null").select("ord", useful_sentences(F.coalesce(text, F.lit(""))).alias("_sentences"))
    rows = computed(rows, F.struct(tokens_of(F.col("_sentences"), dictionary).alias("_tokens"))).select("ord", "_tokens")
    kind = StructType([docs.schema["ord"]]).add("i", IntegerType()).add("j", IntegerType()).add("weight", DoubleType())

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ords, words in slices((batch.column(0), batch.column(1))):
                every = Sentences(words)
                for i, j, weight in every.pairs():
                    columns = [ords.take(pa.array(every.text[i])), pa.array(every.place[i].astype(np.int32)), pa.array(every.place[j].astype(np.int32)), pa.array(weight)]
                    yield pa.RecordBatch.from_arrays(columns, ["ord", "i", "j", "weight"])

    return rows.mapInArrow(paired, kind)


class Graph:
    """The Jaccard weights of a text's sentences: only pairs that share a token have one.

    Rows are made a block at a time, of ``CELLS`` numbers at most. Up to ``KEPT`` weights are kept between the rounds; a text with more makes
    its rows anew in each, so memory is bounded whatever the text.
    """

    def __init__(self, sets: list[set]):
        self.n = len(sets)
        ids: dict[str, int] = {}
        words = np.array([ids.setdefault(w, len(ids)) for s in sets for w in s], np.int64)
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(self.n), self.size)
        order = np.argsort(words, kind="stable")
        # by sentence its words, and by word its sentences
        self.words, self.of_sentence = words, np.concatenate([[0], np.cumsum(self.size)])
        self.owner, self.of_word = owner[order], np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(ids)))])
        self.step = max(1, CELLS // max(1, self.n))
        self.kept, pairs = [], 0
        for block in self.blocks():
            pairs += len(block[2])
            if pairs > KEPT:
                self.kept = None
                break
            self.kept.append(block)
        self.sums = np.zeros(self.n)
        for start, rows, columns, weights in self.rows():
            self.sums += np.bincount(columns, weights, self.n)

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        return iter(self.kept) if self.kept is not None else self.blocks()

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First row, and rows (from it), columns and weights of a block."""
        for start in range(0, self.n, self.step):
            end = min(start + self.step, self.n)
            common = np.zeros((end - start) * self.n, np.int64)
            row = np.repeat(np.arange(end - start), self.size[start:end])
            words = self.words[self.of_sentence[start] : self.of_sentence[end]]
            counts = self.of_word[words + 1] - self.of_word[words]
            for part in np.array_split(np.arange(len(words)), -(-int(counts.sum()) // CELLS) or 1):
                many = counts[part]
                places = np.repeat(self.of_word[words[part]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                common += np.bincount(np.repeat(row[part], many) * self.n + self.owner[places], minlength=len(common))
            at = np.flatnonzero(common)
            i, j = np.divmod(at, self.n)
            other = i + start != j
            i, j, c = i[other], j[other], common[at[other]]
            yield start, i, j, c / (self.size[i + start] + self.size[j] - c)

    def spread(self, rank: np.ndarray) -> np.ndarray:
        """What each sentence gets: of its neighbours' ranks by weight, and of those without any neighbour an even share."""
        share = np.divide(rank, self.sums, out=np.zeros(self.n), where=self.sums > 0)
        out = np.full(self.n, rank[self.sums <= 0].sum() / self.n)
        for start, i, j, weights in self.rows():
            some = np.bincount(i, weights * share[j])
            out[start : start + len(some)] += some
        return out


def text_rank(sets: list[set], damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-4) -> np.ndarray:
    """Ranks of sentences by Jaccard weights. Weights come from shared tokens; a sentence without any spreads evenly."""
    graph, n = Graph(sets), len(sets)
    rank = np.full(n, 1 / max(n, 1))
    for _ in range(rounds):
        new = (1 - damping) / n + damping * graph.spread(rank)
        moved = np.abs(new - rank).sum()
        rank = new
        if moved < tolerance:
            break
    return rank


def best_sentences(sentences: list[str], sets: list[set], top: int = TOP) -> str:
    """The ``top`` sentences in text order, put together; of equal ranks (to 1e-9) the earlier sentence."""
    rank = np.round(text_rank(sets), 9)
    chosen = sorted(sorted(range(len(sentences)), key=lambda i: (-rank[i], i))[:top])
    return "".join(sentences[i] for i in chosen)


def text_ranks(every: Sentences, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-4) -> np.ndarray | None:
    """``text_rank`` of many texts at once: a round goes over all that are still moving. None if their weights are more than ``KEPT``."""
    kept, pairs = [], 0
    for block in every.pairs():
        pairs += len(block[0])
        if 2 * pairs > KEPT:
            return None
        kept.append(block)
    i, j, weights = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    i, j, weights = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([weights, weights])
    order = np.lexsort((j, i))
    i, j, weights = i[order], j[order], weights[order]
    sums = np.bincount(j, weights, every.n)
    alone, text, n = sums <= 0, every.text, np.diff(every.of_text)
    rank, moving = 1 / n[text], n > 0
    for _ in range(rounds):
        share = np.divide(rank, sums, out=np.zeros(every.n), where=~alone)
        even = np.bincount(text, np.where(alone, rank, 0), every.texts) / np.maximum(n, 1)
        new = (1 - damping) / n[text] + damping * (even[text] + np.bincount(i, weights * share[j], every.n))
        moved = np.bincount(text, np.abs(new - rank), every.texts)
        rank = np.where(moving[text], new, rank)
        still = moving & (moved >= tolerance)
        if not still.any():
            break
        if still.sum() < moving.sum():
            some = still[text[i]]
            i, j, weights = i[some], j[some], weights[some]
        moving = still
    return rank


def extracts(sentences: pa.Array, words: pa.Array, top: int = TOP) -> list[str | None]:
    """``best_sentences`` of each text with more than three."""
    many = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False)
    out: list[str | None] = [None] * len(many)
    long = np.flatnonzero(many > 3)
    sentences, words = sentences.take(pa.array(long)), words.take(pa.array(long))
    every = Sentences(words)
    rank = text_ranks(every)
    if rank is None:
        for k, at in enumerate(long):
            out[at] = best_sentences(sentences[k].as_py(), [set(w) for w in words[k].as_py()], top)
        return out
    order = np.lexsort((every.place, -np.round(rank, 9), every.text))
    chosen = np.sort(order[np.arange(every.n) - every.of_text[every.text] < top])
    for k, sentence in zip(every.text[chosen].tolist(), sentences.flatten().take(pa.array(chosen)).to_pylist(), strict=True):
        out[long[k]] = (out[long[k]] or "") + sentence
    return out


def summarize(docs: DataFrame, text: str = "text", dictionary: Dictionary | None = None) -> DataFrame:
    """Adds extract: '' under 100 characters, the text's start with up to three useful sentences, else TextRank's best."""
    body = strip(F.coalesce(text, F.lit("")))
    cut = let(body, lambda b: F.struct(b.alias("_body"), F.when(F.length(b) >= 100, useful_sentences(b)).otherwise(F.array().cast("array<string>")).alias("_sentences")))
    rows = computed(docs, cut)  # once, though what follows reads them several times
    rows = rows.withColumn("_tokens", tokens_of(F.col("_sentences"), dictionary))

    @F.arrow_udf("string")
    def ranked(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return by_slices(columns, extracts, pa.string())

    long = F.size("_sentences") > 3
    made = F.when(F.length("_body") < 100, "").when(~long, F.left("_body", F.lit(MOST))).otherwise(ellipsis(ranked("_sentences", "_tokens"), MOST))
    return rows.withColumn("extract", made).drop("_body", "_sentences", "_tokens")


def identity(text: Column) -> Column:
    """The translation hook without a translator."""
    return text


def choose_summary(items: DataFrame, translate=identity, dictionary: Dictionary | None = None) -> DataFrame:
    """Adds ai_summary by an item's language and what text it has.

    With a fetched full text: its extract, translated if the item is English and not Chinese. English: the first 800
    characters translated. Chinese with a full body over twice the summary: its extract, else its first 300. Else the first 500.
    """
    col = lambda c: F.coalesce(F.col(c), F.lit("")) if c in items.columns else F.lit("")
    summary, original, body = col("summary"), col("original_summary"), col("full_body")
    source = F.when(original != "", summary).when(F.length(body) > 2 * F.length(summary), body).otherwise("")
    rows = summarize(items.withColumn("_source", source), "_source", dictionary)
    english, chinese = col("language") == "en", is_cjk(summary, 200)
    extract = F.col("extract")
    chosen = (
        F.when(F.length(strip(summary)) < 50, "")
        .when(original != "", F.when(english & ~is_cjk(extract, 200), translate(extract)).otherwise(extract))
        .when(english & ~chinese, translate(F.left(summary, F.lit(800))))
        .when(F.length(body) > 2 * F.length(summary), F.when(extract != "", extract).otherwise(F.left(body, F.lit(300))))
        .otherwise(F.left(summary, F.lit(500)))
    )
    return rows.withColumn("ai_summary", chosen).drop("_source", "extract")


def translated(text: Column, translate=identity, most: int = TRANSLATED) -> Column:
    """A text's translation, made of its first ``most`` characters; the whole text if there is none or it changes nothing."""
    cut = F.left(text, F.lit(most))
    made = translate(cut)
    return F.when(strip(text) == "", text).otherwise(F.when(made.isNotNull() & (made != cut), made).otherwise(text))


def translatable(items: DataFrame) -> dict[str, tuple[Column, Column, Column]]:
    """By the column to be added: the text, whether it is to be translated, and what stands there if it isn't.

    The summary is the original one where a page's text has taken its place, and at most 500 characters of it.
    """
    col = lambda c: F.coalesce(F.col(c), F.lit("")) if c in items.columns else F.lit("")
    english, none = F.coalesce("language", F.lit("")) == "en", F.lit(None).cast("string")
    told = F.when(col("original_summary") != "", col("original_summary")).otherwise(col("summary"))
    best = col("ai_summary")
    return {"title_zh": (col("title"), english, none), "summary_zh": (F.left(told, F.lit(MOST)), english, none), "ai_summary_zh": (best, (best != "") & ~is_cjk(best), best)}


def translate_items(items: DataFrame, translate=identity) -> DataFrame:
    """title_zh and summary_zh of English items (null for others), and ai_summary_zh of every item that isn't Chinese by its own text.

    The translator is a function of columns; ``translate.translate_once`` takes one that is called for each text.
    """
    return items.withColumns({name: F.when(needed, translated(text, translate)).otherwise(other) for name, (text, needed, other) in translatable(items).items()})


def english_first(items: DataFrame) -> DataFrame:
    """ord as a key that puts English items before the others, each in their former order: no sort, no window. ord must lie below 2^62."""
    english = F.coalesce("language", F.lit("")) == "en"
    return items.withColumn("ord", F.col("ord").cast("long") + F.when(english, 0).otherwise(1 << 62))
