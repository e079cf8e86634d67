import random

from pyspark.sql import functions as F

from skarn.functions import scoring


def brute(lists):
    n = len(lists)
    if any(not x for x in lists):
        return 0.0, 0.0, 0.0
    pairs = sum(any(p + 1 in b for p in a) for a, b in zip(lists, lists[1:], strict=False))
    full = any(all(p + i in x for i, x in enumerate(lists)) for p in lists[0])
    spans = []
    for p in sorted({p for x in lists for p in x}):
        ends = [min((q for q in x if q >= p), default=None) for x in lists]
        if None not in ends:
            spans.append(max(ends) - p)
    return pairs / (n - 1), float(full), 1 / (1 + max(0, min(spans) - (n - 1)))


def test_field_signals(spark):
    rng = random.Random(7)
    for n in (2, 3, 4):
        rows = [(i, *[sorted(rng.sample(range(14), rng.randint(0, 5))) or None for _ in range(n)]) for i in range(300)]
        df = spark.createDataFrame(rows, "id int, " + ", ".join(f"l{i} array<int>" for i in range(n)))
        found = scoring.field_signals([F.col(f"l{i}") for i in range(n)])
        got = {r.id: (r.a, r.b, r.c) for r in df.select("id", *(c.alias(x) for c, x in zip(found, "abc", strict=True))).collect()}
        for i, *lists in rows:
            assert all(abs(x - y) < 1e-9 for x, y in zip(got[i], brute([x or [] for x in lists]), strict=True)), lists


def test_king_of_hill(spark):
    """Stop words keep their positions, so a phrase does not match across one."""
    from skarn.operators import searching

    pages = spark.createDataFrame([(1, "u", "x", "king of hill", "h1"), (2, "u", "y", "king hill", "h2")], "page_id long, url string, title string, body_text string, url_hash string")
    index = searching.build_index(pages)
    rows = {r.page_id: r for r in searching.score_positional(index, ["king", "hill"], searching.RankingConfig()).collect()}
    assert rows[1].phrase == 0 and rows[2].phrase == 2.25 and rows[1].proximity == 0.5 and rows[2].proximity == 1.0
    one = searching.score_positional(index, ["king"], searching.RankingConfig()).first()
    assert one.phrase == one.proximity == 0
