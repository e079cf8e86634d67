"""Word lists and tokenisers of the index side and the query side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words. Queries know all but two of them, which therefore never match.
INDEX_STOPWORDS = tuple(
    """
    a about above after again against all am an and any are as at be because been
    before being below between both but by did do does doing down during each few
    for from get got have he her here him his how i if in into is it its let me
    more most my no nor not of off on once only or other our out over own same she
    should so some such than that the their them then there these they this those
    through to too under until up very was we were what when where which while who
    whom why will with you your
    """.split()
)
QUERY_STOPWORDS = tuple(w for w in INDEX_STOPWORDS if w not in ("against", "during"))

#: Words are maximal runs of at least two letters a-z of the lower-cased text.
WORD = "[a-z]{2,}"
_STOP = frozenset(QUERY_STOPWORDS)


def query_tokens(query: str | None) -> list[str]:
    """Tokens of a query, in order, repeats kept."""
    return [w for w in re.findall(WORD, (query or "").lower()) if w not in _STOP]


def word_sequence(text: Column | str) -> Column:
    """array<string>: the words of a text, stop words among them, so that they keep their positions."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(WORD), F.lit(0))


def suggestion_prefix(query: str | None, positional: bool) -> str:
    """What a suggestion has to begin with; the positional profile keeps letters only."""
    text = (query or "").strip().lower()
    return re.sub("[^a-z]", "", text) if positional else text
