import numpy as np

from skarn.llm import ann


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score string").repartition(3)


def brute(vectors, ids, every, k):
    out = {}
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in zip(ids, vectors, strict=True) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([v for _, v in good])
    n = np.array([i for i, _ in good])
    for i, v in good:
        if i % every == 0:
            s = ann.products(np.repeat(v[None], len(m), axis=0), m)
            order = [j for j in np.lexsort((n, -s)) if n[j] != i][:k]
            out[i] = [(int(n[j]), s[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vectors = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))).tolist()
    vectors[100:400] = [vectors[100]] * 300  # a very common vector
    vectors[7], vectors[8], vectors[9], vectors[40] = None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15
    rows = ann.nearest(table(spark, vectors), 20, 20).collect()
    truth = brute(vectors, range(3000), 20, 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == truth.keys()
    hits = 0
    for q, own in got.items():
        assert len(own) == 20 and [(-s, i) for i, s in own] == sorted((-s, i) for i, s in own)
        exact = dict(truth[q])
        hits += sum(i in exact for i, _ in own)
        assert all(exact.get(i, s) == s for i, s in own)
    assert hits / (20 * len(truth)) >= 0.9


def test_few_rows(spark):
    assert ann.nearest(table(spark, []).limit(0)).count() == 0
    rows = ann.nearest(table(spark, [[1.0, 0.0], [0.5, 0.0], [2.0, 0.0]], [20, 3, 2]), 20, 20).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(rows)] == [(20, 1, 2, 2.0), (20, 2, 3, 0.5)]


def test_queries_alone_in_their_leaf_look_further(spark, monkeypatch):
    """Dense clusters make few visits enough for most queries; a lone one still gets all its rows."""
    rng = np.random.default_rng(6)
    vectors = np.concatenate([np.repeat(np.eye(8) * 5, 100, axis=0) + 0.01 * rng.normal(size=(800, 8)), -9 * np.eye(8)[:1]])
    ids = [*range(1, 801), 1000]
    rows = ann.nearest(table(spark, vectors.tolist(), ids), 20, 20).collect()
    assert len([r for r in rows if r.query_id == 1000]) == 20


def test_blocks_null_and_repeated_ids_and_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "QUERY_ROWS", 4)
    rng = np.random.default_rng(7)
    vectors, ids = rng.normal(size=(300, 6)).tolist(), list(range(300))
    vectors += [[1.0, 2.0], vectors[3], vectors[5]]
    ids += [7, 3, None]
    got = {}
    for r in sorted(ann.nearest(table(spark, vectors, ids), 20, 20, target=1.0).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    keep = [i for i in range(len(ids)) if ids[i] is not None and len(vectors[i]) == 6]
    truth = brute([vectors[i] for i in keep], [ids[i] for i in keep], 20, 20)
    assert got.keys() == truth.keys()
    hits = sum(len(set(got[q]) & set(truth[q])) for q in truth)
    assert hits >= 0.97 * 20 * len(truth) and all(len(x) == 20 for x in got.values())
