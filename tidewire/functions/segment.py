"""Chinese words by a dictionary: the best path over a run's words, found from its end.

A word of the dictionary weighs the logarithm of its share of all counts, a character that is no word that of half a count.
The path of the greatest weight is taken; of equal ones that of the longest first word, then of the longest second, and so on. Weights are whole numbers,
so equal is exact. Characters that are no words, where they stand side by side, give their bigrams, as all runs do without a dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import han_runs, kept_words, plain_words

#: Words of a dictionary at most: some 300 MB in a worker.
MAX_WORDS = 1_000_000
SCALE = 1 << 20


def bigrams(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(max(1, len(run) - 1))]


class Dictionary:
    """Words and how often they occur, as a trie: a node holds its next characters, and under '' the weight of the word that ends there."""

    def __init__(self, counts: Mapping[str, int]):
        counts = {w.lower(): n for w, n in counts.items() if w and n > 0}
        if len(counts) > MAX_WORDS:
            raise ValueError(f"a dictionary of more than {MAX_WORDS} words")
        total = sum(counts.values()) or 1
        self.unknown = round(SCALE * math.log(0.5 / total))
        self.top: dict = {}
        for word, n in counts.items():
            node = self.top
            for c in word:
                node = node.setdefault(c, {})
            node[""] = round(SCALE * math.log(n / total))

    def cut(self, run: str) -> Iterator[tuple[str, bool]]:
        """The pieces of the best path, and whether each is a word."""
        n = len(run)
        best, length, known = [0] * (n + 1), [1] * n, [False] * n
        for i in range(n - 1, -1, -1):
            best[i] = self.unknown + best[i + 1]
            node = self.top
            for j in range(i, n):
                if (node := node.get(run[j])) is None:
                    break
                if (weight := node.get("")) is not None and weight + best[j + 1] >= best[i]:
                    best[i], length[i], known[i] = weight + best[j + 1], j + 1 - i, True
        i = 0
        while i < n:
            yield run[i : i + length[i]], known[i]
            i += length[i]

    def words(self, run: str) -> list[str]:
        out, strange = [], ""
        for piece, known in self.cut(run):
            if not known:
                strange += piece
                continue
            if strange:
                out += bigrams(strange)
                strange = ""
            out.append(piece)
        return out + bigrams(strange) if strange else out


def tokens_of_all(sentences: Column, stop_words: tuple[str, ...], dictionary: Dictionary) -> Column:
    """The tokens of each of an array of sentences, as ``text.tokens`` gives them, but with the dictionary's words. Only runs of Chinese characters reach Python."""

    @F.pandas_udf("array<array<string>>")
    def segmented(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if row is None else [None if runs is None else [w for run in runs for w in dictionary.words(run)] for runs in row] for row in rows], dtype=object)

    low = F.transform(sentences, F.lower)
    both = F.arrays_zip(F.transform(low, plain_words).alias("plain"), segmented(F.transform(low, han_runs)).alias("han"))
    return F.transform(both, lambda b: kept_words(F.concat(b["plain"], b["han"]), stop_words))
