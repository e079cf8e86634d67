import zlib
from collections import defaultdict

import pytest

from skarn.llm import sharding


def check(rows, texts, shards=8):
    assert sorted(r.doc_id for r in rows) == sorted(range(len(texts)))
    by = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    sums = [sum(r.size for r in by[s]) for s in range(shards)]
    assert max(sums) - min(sums) <= 2 * largest + 0.01 * total / shards
    return by


@pytest.mark.parametrize("hot", [0, 400])
def test_near_equal_bytes(spark, hot):
    texts = [f"text {i} " * (1 + i * 7919 % 50) for i in range(800)] + ["hot copy " * 20] * hot + [None, "", ""] + [f"pair {i // 2}" for i in range(100)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string").repartition(3)
    by = check(sharding.shard_by_bytes(docs).collect(), texts)
    groups = defaultdict(set)
    for s, rows in by.items():
        for r in rows:
            groups[r.text_crc32].add(s)
    assert sum(len(g) > 1 for g in groups.values()) <= (1 if hot else 0) + 7


def test_few_and_no_rows(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = sharding.shard_by_bytes(spark.createDataFrame([(None, None), (3, "abc")], "doc_id long, text string")).collect()
    assert sorted((r.size, r.doc_id) for r in rows) == [(1, None), (4, 3)]


def test_against_a_plain_placement(spark):
    """Shards follow from the middle byte of each record in the order of ranges; ids of any type, and repeated rows."""
    rows = [(f"k{i % 300}", f"t{i // 3} " * (i % 40)) for i in range(900)] + [(None, "same text")] * 400
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id string, text string").repartition(4), shards=5, ranges=7).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(t.encode()) + 1) for i, t in rows)
    per = sum(r.size for r in got) / 5
    sums = [sum(r.size for r in got if r.shard == s) for s in range(5)]
    assert max(abs(n - per) for n in sums) <= 2 * max(r.size for r in got) + 2 * sharding.SNAP * per
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
