import random

import pytest

from skarn.operators import graph


def brute(edges, nodes, steps=20, d=0.85):
    edges = {(a, b) for a, b in edges if a != b and a in nodes and b in nodes}
    out = {n: sum(a == n for a, _ in edges) for n in nodes}
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(steps):
        loose = sum(rank[n] for n in nodes if not out[n])
        rank = {n: (1 - d) / len(nodes) + d * loose / len(nodes) + d * sum(rank[a] / out[a] for a, b in edges if b == n) for n in nodes}
    low, high = min(rank.values()), max(rank.values())
    return {n: (r, (r - low) / (high - low) if high - low > 1e-12 else 0.0) for n, r in rank.items()}


@pytest.mark.parametrize(
    "edges, nodes",
    [
        ([], [1]),
        ([], [1, 2, 3]),
        ([(1, 1), (1, 2), (1, 2), (9, 1)], [1, 2]),
        ([(1, 2), (2, 1)], [1, 2]),
        ([(a, b) for a, b in [(random.Random(k).randint(1, 9), random.Random(k + 99).randint(1, 9)) for k in range(25)]], list(range(1, 10))),
    ],
)
def test_page_rank(spark, edges, nodes):
    e = spark.createDataFrame(edges, "src long, dst long")
    n = spark.createDataFrame([(x,) for x in nodes], "page_id long")
    rows = graph.page_rank(e, n, iterations=5).collect()
    expected = brute(edges, nodes, 5)
    assert sum(r.rank for r in rows) == pytest.approx(1)
    assert {r.page_id: (r.rank, r.score) for r in rows} == {k: pytest.approx(v) for k, v in expected.items()}


def test_edges_by_hash(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "b")], "page_id long, url_hash string")
    edges = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "zz")], "source_url_hash string, target_url_hash string")
    assert [tuple(r) for r in graph.resolve_edges(edges, pages).collect()] == [(1, 2)]
