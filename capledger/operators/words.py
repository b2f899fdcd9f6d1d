"""Hits of several word lists in one pass over each text, by an automaton of all their words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import share_package

HITS = "struct<word_no: long, at: long, earliest: long, words: long>"


@lru_cache(maxsize=8)
def automaton(lists: tuple[tuple[str, ...], ...]):
    """An automaton over all words; a word knows its length and its numbers in the lists that have it."""
    import ahocorasick

    places: dict[str, list[tuple[int, int]]] = {}
    for i, words in enumerate(lists):
        for n, word in enumerate(words, 1):
            places.setdefault(word, []).append((i, n))
    out = ahocorasick.Automaton()
    for word, where in places.items():
        out.add_word(word, (len(word), where))
    out.make_automaton()
    return out


def hits_of(text: str | None, lists: tuple[tuple[str, ...], ...]) -> list[dict | None]:
    """For each list: the number of the first of its words that text holds, its first place, the first place of any, and how many words text holds."""
    found: list[dict[int, int]] = [{} for _ in lists]
    if text:
        for end, (length, where) in automaton(lists).iter(text):
            for i, n in where:
                found[i].setdefault(n, end - length + 2)
    return [{"word_no": min(f), "at": f[min(f)], "earliest": min(f.values()), "words": len(f)} if f else None for f in found]


def word_hits(df: DataFrame, text: str, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """df with a column for each list: word_no (the first word of the list, in its order, that the text holds; from 1), at
    (that word's first place, from 1), earliest (the first place of any of its words) and words (how many it holds); null
    where it holds none, or is null.

    Words are plain texts, not patterns, and none is empty.  A text is read once, however many lists and words there are.
    """
    share_package(df.sparkSession)
    names, words = tuple(lists), tuple(tuple(w) for w in lists.values())
    if any(not w for ws in words for w in ws):
        raise ValueError("an empty word is everywhere")

    @F.pandas_udf(f"struct<{', '.join(f'`{n}`: {HITS}' for n in names)}>")
    def search(texts: pd.Series) -> pd.DataFrame:
        rows = [hits_of(t, words) for t in texts]
        return pd.DataFrame({n: [r[i] for r in rows] for i, n in enumerate(names)}, columns=list(names))

    return df.withColumn("_hits", search(F.col(text))).select(*df.columns, *[F.col("_hits")[n].alias(n) for n in names])
