import math
import random
import re

import numpy as np

from skarn.llm import toxicity


def test_learns_and_locates(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(400)]

    def sentence(bad=False):
        own = [rng.choice(words) for _ in range(rng.randint(4, 12))]
        if bad:
            own[rng.randrange(len(own))] = rng.choice(["zqwrong", "zqbad", "Zqhate"])
        return " ".join(own) + "."

    rows = [(0, None, None), (1, "", 1), (2, "... !", 0)]
    for i in range(3, 700):
        bad = rng.random() < 0.2
        rows.append((i, " ".join([sentence() for _ in range(rng.randint(1, 9))] + [sentence()] + ([sentence(True)] if bad else [])), int(bad)))
    docs = spark.createDataFrame([(i, t, 3) for i, t, _ in rows], "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.held_out_scores(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values()) and got[0].score == got[2].score == 0
    held = [(got[i].predicted, y) for i, t, y in rows if got[i].held_out and i > 2]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(model, docs, keep=("doc_id", "text")).limit(300).collect():
        for s in r.offending:
            assert "zq" in r.text.encode()[s.start : s.end].decode().lower()
    flat = toxicity.held_out_scores(docs, labels.filter("toxic = 0")).collect()
    assert all(r.predicted == 0 for r in flat)
    assert toxicity.held_out_scores(docs.limit(0), labels).count() == 0


def test_scores_are_the_noisy_or_of_all_sentences(spark):
    rng = random.Random(9)
    model = toxicity.Model(np.random.default_rng(3).normal(0, 0.5, toxicity.BUCKETS), -3.0)
    texts = [" ".join(rng.choice(["Alpha", "beta!", "ga mma.", "\n", "d\u00e9lta", "12 x"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["long sentence " * 90_000 + ". end", None, "", texts[3]]  # one above a block of text
    rows = toxicity.score(model, spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()

    def bucket(word, n, factor):
        raw = np.frombuffer(word[:n] if n else word, np.uint8)
        h = toxicity.range_hash(toxicity.prefix_hash(raw), np.array([0]), np.array([len(raw)]))
        with np.errstate(over="ignore"):
            return int((h * np.uint64(factor) >> np.uint64(64 - toxicity.BUCKET_BITS))[0])

    for r in rows:
        clean = 1.0
        for sentence in re.split(rb"[\n!.?]", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (texts[r.doc_id] or "").encode())):
            words = re.findall(rb"[0-9a-z\x80-\xff]+", sentence)
            if words:
                z = model.bias
                for w in words:
                    z += model.weights[bucket(w, 0, 1)] + sum(model.weights[bucket(w, n, 2 * n + 1)] for n in toxicity.STEMS)
                clean *= 1 / (1 + math.exp(min(z, 700)))
        assert abs(r.score - (1 - clean)) < 1e-9


def test_ties_and_no_labels(spark):
    docs = spark.createDataFrame([(i, "same words here.") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.held_out_scores(docs, labels).collect()}) == 1
    assert all(r.predicted == 0 for r in toxicity.held_out_scores(docs, labels.limit(0)).collect())
