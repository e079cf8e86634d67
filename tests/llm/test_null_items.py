import hashlib

from skarn.llm import decontamination


def test_windows_of_items_without_id_are_hits(spark):
    docs = spark.createDataFrame([(1, "say alpha beta gamma now"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "alpha beta"), (7, "beta gamma")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.digests(docs, bench).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated, got[1].items_sha256) == (3, 1, True, hashlib.sha256(b"7").hexdigest())
    only = {r.doc_id: r for r in decontamination.digests(docs, bench.filter("item_id is null")).collect()}
    assert (only[1].n_hit, only[1].n_items, only[1].contaminated) == (2, 0, True) and not only[2].contaminated
