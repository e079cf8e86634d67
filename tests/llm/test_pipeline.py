import pytest

import corpus_pipeline
from skarn.llm import decontamination, line_dedup, near_copies, toxicity

from .test_line_dedup import brute as brute_lines
from .test_near_copies import brute_first

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(model, docs).collect() if r.score >= 0.5}
    expected = {i: r.text for i, r in rows.items() if i not in toxic}

    got = corpus_pipeline.reject_toxic(spark, docs, SF).cache()
    assert {r.doc_id: r.text for r in got.collect()} == expected and got.columns == docs.columns

    expected = {i: t for i, (_, _, t) in brute_lines(sorted(expected.items()), line_dedup.MIN_CHARS).items()}
    got = corpus_pipeline.remove_repeated_lines(spark, got, SF).cache()
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {i: (t, len(t)) for i, t in expected.items()}

    ids = sorted(expected)
    expected = {ids[k]: expected[ids[k]] for k in brute_first([expected[i] for i in ids])}
    got = corpus_pipeline.keep_one_of_near_copies(spark, got, SF).cache()
    assert {r.doc_id: r.text for r in got.collect()} == expected

    tests = [b" " + w + b" " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in decontamination.windows_of(r.text, 10)]
    expected = {i: t for i, t in expected.items() if not any(w in b" " + b" ".join(decontamination.words_of(t)) + b" " for w in tests)}
    got = corpus_pipeline.drop_contaminated(spark, got, SF).cache()
    assert {r.doc_id: r.text for r in got.collect()} == expected and got.columns == docs.columns

    packed = corpus_pipeline.pack_sequences(spark, got, SF).collect()
    assert {r.doc_id for r in packed} == set(expected)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c", "x"), (None, "a b c", "x"), (2, "other words here", "x"), (3, "other words here", "x")], "doc_id long, text string, lang string")
    assert sorted((str(r.doc_id), r.text) for r in near_copies.one_of_each(docs).collect()) == [("2", "other words here"), ("None", "a b c")]


@pytest.mark.parametrize("max_bytes", [1 << 20, 200])
def test_decontamination(spark, max_bytes):
    items = [(1, "The quick brown fox jumps over the lazy dog and runs away home"), (2, "Short item"), (3, None), (4, "..."), (1, "another text of item one that has more than ten words in it"), (5, "fox jumps over")]
    texts = ["THE quick, brown fox jumps over the lazy dog AND barks", "a short-item here", "shorts item", None, "", "é fox  jumps\nover it. fox jumps over", "text of item one that has more than ten words in"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench, 10, max_bytes).collect()}
    for i, t in enumerate(texts):
        words = decontamination.words_of(t)
        hit, found = set(), set()
        for item, text in items:
            for w in decontamination.windows_of(text, 10):
                w = w.split()
                for k in range(len(words) - len(w) + 1):
                    if words[k : k + len(w)] == w:
                        hit.update(range(k, k + len(w)))
                        found.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i]["items"], got[i].contaminated) == (len(words), len(hit), sorted(found), bool(hit))
        inside = b" ".join((t or "").encode()[s.a : s.b] for s in got[i].spans)
        assert len(decontamination.words_of(inside.decode())) == len(hit)
    none = decontamination.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.contaminated for r in none)


def test_clashing_columns_nulls_and_no_rows(spark):
    text = "some words of a plain text " * 3
    rows = [(1, text, "en", 5, 1.5, "p", [1], True), (None, None, None, None, None, None, None, None), (2, "", "en", 0, 0.0, "", [], False), (2, "", "en", 0, 0.0, "", [], False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, predicted double, hits string, items array<int>, contaminated boolean")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == (3 if name == "near_dedup" else 4) - (name == "near_dedup"), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4
