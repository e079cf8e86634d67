"""Grams and edit distance of spelling correction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def grams(term: Column) -> Column:
    """array<string>: distinct grams of ^term$, of two characters, and of three if the term has over four."""
    line = F.concat(F.lit("^"), term, F.lit("$"))

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(line) - (n - 1)), lambda i: line.substr(i, F.lit(n)))

    return F.array_distinct(F.when(F.length(term) <= 4, of(2)).otherwise(F.concat(of(2), of(3))))


def max_distance(term: Column) -> Column:
    n = F.length(term)
    return F.when(n <= 4, 1).when(n <= 8, 2).otherwise(3)


def edit_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance: insertions, deletions, substitutions, and swaps with edits between."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, swap = [far, i], 0
        for j, y in enumerate(b, 1):
            at = last.get(y, 0)
            best = min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, rows[at][swap] + (i - at - 1) + 1 + (j - swap - 1))
            if x == y:
                swap = j
            row.append(best)
        last[x] = i
        rows.append(row)
    return rows[-1][-1]


@F.pandas_udf(IntegerType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")
