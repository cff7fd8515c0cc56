"""Keyword matching: a few words as column expressions, any number of them by an automaton.

Both find the same: an ASCII keyword as a word (see ``keyword_pattern``) in any case, any other as a substring of the lower-cased text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.slices import by_slices

WORD = r"[\p{L}\p{N}_]"


def is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def keyword_pattern(text: str) -> str | None:
    """For an ASCII keyword the pattern of its occurrences as words, else None: it is looked for as a substring.

    Word characters are letters, numbers and the underscore of any script. At an end where the keyword has a word
    character none may follow; where it has another character a word character must.
    """
    if not text or not text.isascii():
        return None
    before = f"(?<!{WORD})" if is_word(text[0]) else f"(?<={WORD})"
    after = f"(?!{WORD})" if is_word(text[-1]) else f"(?={WORD})"
    return f"(?iu){before}{re.sub(r'([^A-Za-z0-9 ])', r'\\\1', text)}{after}"


#: Characters that patterns take for an ASCII letter when case doesn't count, but lower-casing leaves or widens.
FOLDED = "\u017f\u212a\u0130\u0131", "skii"


def folded(text: Column) -> Column:
    """Lower case, in which every ASCII keyword of ``has_keyword`` is a plain substring."""
    return F.lower(F.translate(text, *FOLDED))


def has_keyword(text: Column, keyword: str, fold: Column | None = None) -> Column:
    """``fold``: ``folded`` of the text or of more; the pattern is only tried where it holds the keyword."""
    pattern = keyword_pattern(keyword)
    if not pattern:
        return F.contains(F.lower(text), F.lit(keyword.lower()))
    return text.rlike(pattern) if fold is None else F.contains(fold, F.lit(keyword.lower())) & text.rlike(pattern)


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Any of the parts, in lower case, in the text, which must be in lower case."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p.lower()))
    return out


@lru_cache(1 << 16)
def word_char(ch: str) -> bool:
    return ch == "_" or unicodedata.category(ch)[0] in "LN"


class Automaton:
    """Finds all keywords of a list in one pass over a text; its time grows with the text and what is found, not with the list."""

    def __init__(self, keywords: Iterable[str]):
        by_text: tuple[dict, dict] = {}, {}
        self.always = []
        for place, keyword in enumerate(keywords):
            if keyword:
                by_text[keyword.isascii()].setdefault(keyword.lower(), []).append(place)
            else:  # in every text, as a substring
                self.always.append(place)
        self.parts, self.words = (self.built(x) for x in by_text)

    @staticmethod
    def built(places: dict[str, list[int]]):
        out = ahocorasick.Automaton()
        for text, at in places.items():
            out.add_word(text, (len(text), is_word(text[0]), is_word(text[-1]), tuple(at)))
        if len(out):
            out.make_automaton()
        return out if len(out) else None

    def found(self, text: str) -> set[int]:
        """The places of the keywords that the text holds."""
        out = set(self.always)
        if not text:
            return out
        low = text.lower()
        if self.parts:
            for _, entry in self.parts.iter(low):
                out.update(entry[3])
        if self.words:
            fold = low if text.isascii() else text.replace("\u0130", "i").lower().replace("\u017f", "s").replace("\u0131", "i")
            end = len(text)
            for last, (size, word_first, word_last, at) in self.words.iter(fold):
                first, after = last - size, last + 1
                before = first >= 0 and word_char(text[first])
                behind = after < end and word_char(text[after])
                if before != word_first and behind != word_last:
                    out.update(at)
        return out


def batches_found(keywords: tuple[str, ...], columns: Iterator, of, kind: pa.DataType) -> Iterator[pa.Array]:
    """For Arrow functions: ``of(automaton, values of a row)`` for each row, in an array for each batch of columns. The automaton is built once a task."""
    automaton = Automaton(keywords)
    return by_slices(columns, lambda *part: [of(automaton, row) for row in zip(*(c.to_pylist() for c in part), strict=True)], kind)
