import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skarn.llm import substring_dedup
from skarn.llm.common import MappedTable, text_buffers
from skarn.llm.suffix_groups import suffix_arrays


def test_suffix_arrays():
    rng = random.Random(1)
    for t in range(200):
        texts = []
        for _ in range(rng.randint(1, 9)):
            x = [rng.randint(2, rng.choice([2, 3, 4, 10])) for _ in range(rng.randint(0, 40))]
            texts.append([*(x * 4 if t % 5 == 0 else x), 1])
        offs = np.cumsum([0, *map(len, texts)])
        got = suffix_arrays(np.array([c for x in texts for c in x], np.uint16), offs)
        for x, a, b in zip(texts, offs[:-1], offs[1:], strict=True):
            assert got[a:b].tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 400] for r in raw for i in range(len(r) - 399))
    out = []
    for r in raw:
        hit = bytearray(len(r))
        for i in range(len(r) - 399):
            if seen[r[i : i + 400]] > 1:
                hit[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, h in zip(r, hit, strict=True) if not h)
        spans = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(r), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdé fghi\n") for _ in range(n))

    passage = [noise(n) for n in (380, 399, 401, 450, 900, 2000)]
    texts = [None, "", "short", noise(399), noise(400)]
    for _ in range(50):
        parts = [noise(rng.randint(0, 700))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            a = rng.randint(0, 60)
            parts += [p[a : len(p) - rng.randint(0, 60)], noise(rng.randint(0, 300))]
        texts.append("".join(parts))
    texts += texts[5:10] + ["x" * 1500, "ab" * 700, "abc" * 300 + noise(50), texts[12] + texts[13]]
    base = noise(3000)
    for _ in range(6):  # near copies
        at = rng.randint(0, 2900)
        texts.append(base[:at] + noise(7) + base[at + 5 :])
    return texts


@pytest.mark.parametrize("seed, most", [(1, 64), (2, 64), (2, 2)])
def test_against_brute_force(spark, monkeypatch, seed, most):
    """With most = 2, nearly every key is hot and its units are split, down to single windows."""
    monkeypatch.setattr(substring_dedup, "KEY_CONTEXTS", most)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    expected = brute(texts)
    assert [got[i] for i in range(len(texts))] == expected


def test_blocks_do_not_matter():
    data, offs = text_buffers(pa.array(corpus(3)))
    whole, prefix = substring_dedup.units(data, offs)
    deeper = whole.halves(prefix, np.arange(len(whole)))
    for i in range(len(offs) - 1):
        own, prefix = substring_dedup.units(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))
        for a, b in ((whole, own), (deeper, own.halves(prefix, np.arange(len(own))))):
            at = a.row == i
            assert (a.key[at] == b.key).all() and (a.context[at] == b.context).all()


def test_a_hot_line_and_texts_above_a_block(spark):
    """One passage with many surroundings, and texts of more than a megabyte that share most of it."""
    rng = random.Random(6)

    def noise(n):
        return "".join(rng.choice("abcdefgh ijk\n") for _ in range(n))

    line, base = noise(390), noise(1_300_000)
    texts = [noise(300) + line + rng.choice("xyz") * rng.randint(0, 30) + noise(300) for _ in range(150)]
    texts += [base, base[:700_000] + "\u00e9" + base[700_000:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_a_lost_part_is_an_error(spark, tmp_path):
    table = MappedTable(str(tmp_path), 4, ("u8",))
    keys = np.array([3, 5], np.uint64)
    table.write(0, keys, keys)
    table.seal({0})
    assert table.lookup(np.array([5, 6, 1 << 63], np.uint64))[0].tolist() == [True, False, False]
    (tmp_path / "0.bin").unlink()
    with pytest.raises(FileNotFoundError):
        MappedTable(str(tmp_path), 4, ("u8",)).lookup(keys)


def test_repeated_rows_and_empty_tables(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = corpus(4)[20] + "y" * 500
    rows = substring_dedup.remove_repeats(spark.createDataFrame([(1, t), (1, t), (None, None)], "doc_id long, text string"), with_text=True).collect()
    assert sorted((r.n_removed, r.kept) for r in rows) == [(0, b""), (len(t.encode()), b""), (len(t.encode()), b"")]
