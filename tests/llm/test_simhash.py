import re

import numpy as np
import xxhash

from skarn.llm import simhash

WORDS = [f"w{i}" for i in range(200)]


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice(WORDS, 150)) for _ in range(40)]
    texts = [None, "", " \t", "One", "one two", "É x  Y"] + base + base[:5]
    for b in base[:12]:
        for _ in range(8):
            words = b.split()
            for at in rng.choice(150, 2):
                words[at] = str(rng.choice(WORDS))
            texts.append(" ".join(words).upper())
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(3)
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    fps = [brute_print(t) for t in texts]
    roots = brute_groups(fps)
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == roots


def test_links_of_planted_bits(spark):
    rng = np.random.default_rng(4)
    fps = [0, (1 << 64) - 1]
    for _ in range(60):
        f = int(rng.integers(0, 1 << 63)) * 2 + 1
        fps.append(f)
        for n in (1, 2, 3, 4):
            g = f
            for b in rng.choice(64, n, replace=False):
                g ^= 1 << int(b)
            fps.append(g)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long"))
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_groups(fps)


def test_large_keys_are_split(monkeypatch):
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 12, 900).astype(np.uint64) | (rng.integers(0, 3, 900).astype(np.uint64) << np.uint64(20)))
    whole = simhash._search(fps)
    monkeypatch.setattr(simhash, "LARGE", 10)
    split = simhash.spanning(fps)

    def parts(edges):
        root = list(range(len(fps)))
        for _ in range(len(fps)):
            changed = False
            for a, b in edges:
                m = min(root[a], root[b])
                changed |= root[a] != m or root[b] != m
                root[a] = root[b] = m
            if not changed:
                return root

    assert parts(whole) == parts(split)


def test_empty_and_null_ids(spark):
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = simhash.groups(spark.createDataFrame([(None, "a b c"), (4, None), (None, "")], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == sorted([(None, None), (4, 4), (None, 4)], key=str)


def test_ids_of_other_types_and_long_texts(spark):
    long = "one two three four " * 80_000  # above a block of text
    rows = [("b", "x y z a"), ("a", "x y z a"), ("c", long), ("d", long), ("d", "other words")]
    got = {(r.doc_id, r.component_id) for r in simhash.groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("d", "d")}
    assert int(next(iter(simhash.groups(spark.createDataFrame(rows[2:3], "doc_id string, text string")).collect())).fingerprint, 16) == brute_print(long)
