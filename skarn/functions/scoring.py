"""Ranking formulas as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the positional signals.
TITLE_PAIRS, BODY_PAIRS, TITLE_PHRASE, BODY_PHRASE = 1.4, 1.0, 1.8, 1.25
TITLE_NEARNESS, BODY_NEARNESS = 1.15, 1.0


def idf(pages: Column, doc_freq: Column) -> Column:
    return F.ln(1 + (pages - doc_freq + 0.5) / (doc_freq + 0.5))


def weighted_tf(body: Column, title: Column, title_boost: float) -> Column:
    return body + title * title_boost


def bm25(idf_: Column, tf: Column, doc_len: Column, avg_len: float, k1: float, b: float) -> Column:
    """A term's share of the score; 0 where nothing is there to divide by."""
    below = tf + k1 * (1 - b + b * (doc_len / avg_len))
    return F.when(below > 0, idf_ * (tf * (k1 + 1)) / below).otherwise(0.0)


def adjacent(left: Column, right: Column) -> Column:
    """Does some position of right follow one of left at once?"""
    return F.arrays_overlap(F.transform(left, lambda x: x + 1), right)


def exact_phrase(lists: list[Column]) -> Column:
    """Do the words stand one behind the other somewhere?"""

    def back(by: int):
        return lambda x: x - by

    shifted = [F.transform(c, back(i)) for i, c in enumerate(lists)]
    return F.size(reduce(F.array_intersect, shifted)) > 0


def covering_span(lists: list[Column]) -> Column:
    """Length of the shortest stretch that holds a position of every list; null if a list is empty."""

    def from_(p: Column) -> Column:
        ends = [F.array_min(F.filter(c, lambda x: x >= p)) for c in lists]
        whole = reduce(lambda a, b: a & b, [e.isNotNull() for e in ends])
        return F.when(whole, (F.greatest(*ends) if len(ends) > 1 else ends[0]) - p)

    return F.array_min(F.transform(F.flatten(F.array(*lists)), from_))


def field_signals(lists: list[Column]) -> tuple[Column, Column, Column]:
    """(share of adjacent neighbours, 1 if the whole phrase stands there, nearness) of a field.

    Without positions of every word all three are 0.
    """
    some = reduce(lambda a, b: a & b, [F.size(F.coalesce(c, F.array().cast("array<int>"))) > 0 for c in lists])
    pairs = len(lists) - 1
    hits = reduce(lambda a, b: a + b, [F.when(adjacent(a, b), 1).otherwise(0) for a, b in zip(lists, lists[1:], strict=False)]) if pairs else F.lit(0)
    share = hits / F.lit(float(pairs)) if pairs else F.lit(0.0)
    near = 1 / (1 + F.greatest(F.lit(0), covering_span(lists) - pairs))
    zero = F.lit(0.0)
    return (
        F.when(some, share).otherwise(zero),
        F.when(some & exact_phrase(lists), F.lit(1.0)).otherwise(zero),
        F.when(some, F.coalesce(near, zero)).otherwise(zero),
    )


def positional_signals(title: list[Column], body: list[Column]) -> tuple[Column, Column]:
    """Phrase and proximity scores, to four places; 0 for fewer than two words."""
    if len(title) < 2:
        return F.lit(0.0), F.lit(0.0)
    t, b = field_signals(title), field_signals(body)
    phrase = TITLE_PAIRS * t[0] + BODY_PAIRS * b[0] + TITLE_PHRASE * t[1] + BODY_PHRASE * b[1]
    return F.round(phrase, 4), F.round(TITLE_NEARNESS * t[2] + BODY_NEARNESS * b[2], 4)
