import random
import re

import corpus_pipeline
from skarn.llm import near_copies, simhash


def brute_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_first(texts):
    """Positions that stay: the first of each group of 5-word Jaccard >= 0.8."""
    sets, root = brute_sets(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in range(len(texts))}


def test_stage_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "One", "one", "a b c d", "A  B c\nd", "a b c d e", "É f"]
    for k in range(40):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([6, 30, 150, 700]))]
        texts.append(" ".join(words))
        for _ in range(6):
            near = list(words)
            for at in rng.sample(range(len(near)), min(len(near), rng.randint(0, max(1, len(near) // 40)))):
                near[at] = f"x{rng.randint(0, 9)}"
            texts.append(("  " if k % 2 else " ").join(near[: len(near) - rng.randint(0, len(near) // 12)]).upper())
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(5)
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    expected = brute_first(texts)
    assert 60 < len(expected) < len(texts) - 60
    assert sorted((r.doc_id, r.text) for r in got) == sorted((i, texts[i]) for i in expected)


def test_near_copies_beyond_three_bits_go(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 900)}" for _ in range(200)]
    near = [w if i % 50 != 25 else "other" for i, w in enumerate(words)]
    a, b = " ".join(words), " ".join(near)
    x, y = brute_sets([a, b])
    assert len(x & y) / len(x | y) >= 0.8 and (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 3
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()] == [1]


def test_sets_equal_brute_force():
    import numpy as np

    texts = ["", "a b", "a  B\tc d e f", "f " * 9, "a b c d e", "é ü"]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found = near_copies.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offs)
    assert [len(s) for s in found] == [len(s) for s in brute_sets(texts)]
    assert near_copies.similar(found[0], found[0]) and not near_copies.similar(found[0], found[1])


def test_rows_that_share_an_id_stay_if_no_copies(spark):
    rows = [(1, "first text of its own with many words"), (1, "second quite different text of that id"), (1, "first text of its own with many words"), (None, "third one has no id at all here"), (None, "fourth one neither but other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted(set(rows), key=str)


def near_copy_texts():
    """Texts and copies of them in which more and more words differ; one has more copies than are searched at once."""
    rng = random.Random(11)
    texts = []
    for k in range(25):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([60, 200, 500]))]
        texts.append(" ".join(words))
        for n in range(near_copies.TOGETHER + 20 if k == 0 else 6):
            near = list(words)
            for at in rng.sample(range(len(near)), rng.randint(1, len(near) // 60 + 1) if k == 0 else 1 + n * len(near) // 250):
                near[at] = f"x{rng.randint(0, 99)}"
            texts.append(" ".join(near))
    return sorted(set(texts))


def stored_sets(spark, texts):
    folder = near_copies.mapped_folder(spark, "shingles")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = near_copies.written(near_copies.stored(docs, folder), "sets")
    return folder, rows, {r.place: (r.doc_id, r.fp & (1 << 64) - 1) for r in rows.collect()}


def test_fingerprints_bring_sets_together(spark):
    texts = near_copy_texts()
    folder, rows, of = stored_sets(spark, texts)
    sets, fps = brute_sets(texts), dict(of.values())
    expected = {(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 7 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    got = {tuple(sorted((of[r.u][0], of[r.v][0]), reverse=True)) for r in near_copies.fingerprint_links(rows.select("place", "fp"), folder).collect()}

    def parts(pairs):
        root = list(range(len(texts)))
        for a, b in sorted(pairs):
            old, new = sorted((root[a], root[b]), reverse=True)
            root = [new if x == old else x for x in root]
        return root

    assert got <= expected and len(got) > near_copies.TOGETHER and parts(got) == parts(expected)
    own = near_copies.shingle_sets(*flat(texts[:1]))[0]
    assert fps[0] == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in own) > len(own))


def flat(texts):
    import numpy as np

    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_stage_groups_by_simhash_and_the_exact_way_adds_the_rest(spark, monkeypatch):
    texts, seen = near_copy_texts(), {}
    by_print, by_key, by_prefix = near_copies.fingerprint_links, near_copies.keys, near_copies.links

    def prints(sets, folder):
        found = near_copies.written(by_print(sets, folder), "seen")
        seen["prints"] = {(r.u, r.v) for r in found.collect()}
        return found

    def keys(places, folder, common):
        seen["group"] = {r.place: r.group for r in places.collect()}
        return by_key(places, folder, common)

    def links(keyed, folder):
        found = near_copies.written(by_prefix(keyed, folder), "seen")
        seen["rest"] = {(r.u, r.v) for r in found.collect()}
        return found

    for name, f in (("fingerprint_links", prints), ("keys", keys), ("links", links)):
        monkeypatch.setattr(near_copies, name, f)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()}
    assert got == brute_first(texts)
    group = seen["group"]
    assert all(group[u] == group[v] for u, v in seen["prints"]) and len(seen["prints"]) > near_copies.TOGETHER
    assert seen["rest"] and all(group[u] != group[v] for u, v in seen["rest"])
