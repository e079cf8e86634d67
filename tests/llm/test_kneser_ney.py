import math
import re
import zlib
from collections import Counter

import pytest

from skarn.llm import kneser_ney

TEXTS = ["The cat sat", "the cat ran", None, "", "a b the  cat\tsat on the mat", "the the the", "dog dog dog cat ran"] * 6 + [
    f"word{i} the cat w{i % 7} x{i % 5}" for i in range(40)
] + ["often and " * 90] * 5


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    train = [words(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    pairs = Counter(p for w in train for p in zip(["<s>", *w], [*w, "</s>"], strict=True))
    raw, of_context = Counter(), Counter()
    for (a, b), n in pairs.items():
        raw[b] += n
        of_context[a] += n
    cont = Counter(b for _, b in pairs)
    spread = {}
    for (a, _), n in pairs.items():
        spread.setdefault(a, Counter())[min(n, 3)] += 1
    counts = Counter(pairs.values())
    d = [0, *kneser_ney.discounts(*(counts[k] for k in (1, 2, 3, 4)))]
    counts = Counter(cont.values())
    u = [0, *kneser_ney.discounts(*(counts[k] for k in (1, 2, 3, 4)))]
    mass = sum(u[min(c, 3)] for c in cont.values()) / len(pairs)
    n, v = sum(raw.values()), len(raw)

    def uni(w):
        return (cont[w] - u[min(cont[w], 3)]) / len(pairs) + mass / (v + 1)

    def p(a, w):
        if not of_context[a]:
            return uni(w)
        spare = sum(d[k] * m for k, m in spread[a].items())
        return (pairs[a, w] - d[min(pairs[a, w], 3)] + spare * uni(w)) / of_context[a]

    total = sum(p("the", w) for w in raw) + p("the", "never seen")
    assert total == pytest.approx(1)
    out = {}
    for i, t in rows:
        w = words(t)
        tokens = [*w, "</s>"]
        out[i] = (
            zlib.crc32(str(i).encode()) % 10 == 0,
            len(tokens),
            sum(raw[x] > 0 for x in tokens),
            n,
            sum(math.log10((raw[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens),
            sum(math.log10(p(a, x)) for a, x in zip(["<s>", *w], tokens, strict=True)),
        )
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, 7.5) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    expected = brute(rows)
    got = {r.doc_id: r for r in kneser_ney.held_out_scores(docs).collect()}
    assert got.keys() == expected.keys()
    for i, e in expected.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4]
        assert r.base_score == pytest.approx(e[4])
        assert r.score == pytest.approx(e[5])


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert kneser_ney.held_out_scores(empty).count() == 0
    rows = kneser_ney.held_out_scores(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert [r.held_out for r in rows] == [True, True] and all(r.score <= 0 for r in rows)
