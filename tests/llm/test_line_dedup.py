import random

from skarn.llm import line_dedup


def brute(rows, min_chars):
    """By maximal runs: whatever lies in a run of enough characters that also begins earlier goes."""
    docs = []
    for i, t in rows:
        lines = (t or "").split("\n")
        docs.append((i, lines, [k for k, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]))
    suffixes = [(i, [lines[k] for k in at], p) for i, lines, at in docs for p in range(len(at))]
    out = {}
    for i, lines, at in docs:
        gone = set()
        for p in range(len(at)):
            for j, other, q in suffixes:
                if (j, q) >= (i, p):
                    break
                n = 0
                while p + n < len(at) and q + n < len(other) and lines[at[p + n]] == other[q + n]:
                    n += 1
                if sum(len(lines[at[p + k]]) for k in range(n)) >= min_chars:
                    gone.update(range(p, p + n))
        cut, n_runs = set(), 0
        for p in sorted(gone):
            if p - 1 in gone:
                cut.update(range(at[p - 1], at[p] + 1))
            else:
                cut.add(at[p])
                n_runs += 1
        text = "\n".join(x for k, x in enumerate(lines) if k not in cut)
        out[i] = (n_runs, len(gone), text)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["ab", "cde", "f"]) for _ in range(rng.randint(1, 9))) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "\n \n"), (3, "a"), (4, "a")]
    for i in range(5, 60):
        lines = [rng.choice(pool) if rng.random() < 0.8 else rng.choice(["", " ", f"own {i} {rng.random()}"]) for _ in range(rng.randint(0, 12))]
        if i % 6 == 0:
            lines += ["same", "lines", "again and again"] * 3
        if i % 9 == 0:
            lines = rows[-1][1].split("\n")
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame([(i, t, 1, "v") for i, t in rows], "doc_id long, text string, pos int, runs string").repartition(3)
    for min_chars in (1, 15, 40):
        got = {r.doc_id: r for r in line_dedup.remove_repeated_lines(docs, min_chars).collect()}
        expected = brute(rows, min_chars)
        assert {i: (len(r["__runs"] or []), sum(x.lines for x in r["__runs"] or []), r.text or "") for i, r in got.items()} == expected
        assert got[0].text is None and {"pos", "runs"} <= set(got[0].asDict())


def test_empty_and_repeated_rows(spark):
    assert line_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "word " * 60
    rows = line_dedup.digests(spark.createDataFrame([(1, long), (1, long), (2, "x\n" + long), (None, long)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("1", 1), ("1", 1), ("2", 1), ("None", 0)]
