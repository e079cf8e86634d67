import pytest
from pyspark.sql import functions as F

from skarn.operators import indexing, searching, spelling, suggesting
from skarn.plans.engine import SearchEngine, page_numbers, paging
from skarn.sources import tables

TEXT = [
    (1, "https://a.example/1", "Quick foxes", "quick brown foxes jump over lazy dogs <script>x</script> & more"),
    (2, "https://a.example/2", None, "brown dogs sleep while quick cats jump"),
    (3, "https://a.example/3", "", "nothing of note, dogs dogs dogs"),
    (4, "https://a.example/4", "Empty", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(TEXT, "page_id long, url string, title string, body_text string")
    return df.withColumn("url_hash", F.sha2("url", 256))


@pytest.fixture(scope="module")
def engines(spark, pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    edges = spark.createDataFrame([(1, 2), (3, 2), (2, 1)], "src long, dst long")
    classic = SearchEngine(spark, path)
    assert classic.build(pages, edges)["pages"] == 4
    return classic, SearchEngine(spark, path, "positional")


def test_classic(engines):
    out = engines[0].search("Brown zebra DOGS", limit=50)
    assert out["limit"] == 20 and out["total"] == 3 and out["diagnostics"]["matched_terms"] == ["brown", "dogs"]
    assert out["results"][0]["coverage"] == 1.0 and {r["id"] for r in out["results"]} == {1, 2, 3}  # unmatched terms do not lower it
    assert [r["score"] for r in out["results"]] == sorted((r["score"] for r in out["results"]), reverse=True)
    assert "search_query" not in out and {r["id"]: r["title"] for r in out["results"]}[2] == "https://a.example/2"
    pages = [engines[0].search("dogs", page=p, limit=1)["results"] for p in (1, 2, 3, 4)]
    assert [r["id"] for p in pages for r in p] == [r["id"] for r in engines[0].search("dogs")["results"]] and pages[3] == []


def test_positional(engines):
    out = engines[1].search("quikc dgos")
    d = out["diagnostics"]
    assert out["search_query"] == "quick dogs" and d["correction_applied"] and [c["distance"] for c in d["corrections"]] == [1, 1]
    assert d["candidate_pool"] == 5 and all(r["coverage"] <= 1 for r in out["results"])
    best = engines[1].search("brown dogs")["results"][0]
    assert best["id"] == 2 and best["signals"]["phrase"] == 2.25


@pytest.mark.parametrize("q", [None, "", "  ", "the of", "zzzzzz"])
def test_nothing_found(engines, q):
    for e in engines:
        out = e.search(q)
        assert out["total"] == 0 and out["results"] == [] and out["page"] == 1


def test_other_entries(engines):
    for e in engines:
        s = e.stats()
        assert s["pages"] == 4 and s["postings"] >= s["terms"] > 0
        assert e.health()["status"] == "ok" and e.metrics()["crawl_attempts"] == 0
    assert engines[0].suggest("do") == ["dogs"] and engines[0].suggest("d") == [] and engines[1].suggest("J*u") == ["jump"]
    assert engines[0].stats()["ranking_strategy"] == engines[1].stats()["ranking_strategy"] == "bm25_field_boost_graph_pr"


def test_empty_corpus(spark, pages, tmp_path):
    e = SearchEngine(spark, str(tmp_path))
    e.build(pages.limit(0))
    assert e.search("dogs")["total"] == 0 and e.config.avg_doc_len == 200 and e.suggest("do") == []


def test_paging():
    assert [paging(*x) for x in ((None, None), ("2", "50"), ("0", "0"), ("-3", "-4"), ("x", "7x"))] == [(1, 10), (2, 20), (1, 10), (1, 1), (1, 7)]
    assert page_numbers(95, 10, 5) == [3, 4, 5, 6, 7] and page_numbers(9, 10, 1) == [] and page_numbers(95, 10, 10) == [8, 9, 10]


def test_settings(spark):
    meta = spark.createDataFrame([("bm25_k1", None, None), ("avg_doc_len", 0.5, None), ("ranking_strategy", None, ""), ("other", 9.0, "x")], "key_name string, value_num double, value_text string")
    c = indexing.load_config(meta, "positional")
    assert (c.k1, c.b, c.avg_doc_len, c.phrase_weight, c.strategy) == (0.0, 0.75, 1.0, 0.9, indexing.STRATEGY["positional"])


def test_corrections_of_the_survey(spark):
    index = searching.build_index(tables.document_pages(tables.read(spark, "/root/testdata/sf0.01", "documents")).withColumn("title", F.lit("")))
    tokens = ["tiom", "oueautoin", "onrene", "onreem", "tionn", "thouinro", "zzzz", "qrxv", "during", "against"]
    got = {r.token: (r.term, r.distance) for r in spelling.correct_tokens(spelling.token_rows(spark, tokens), index.terms, index.grams).collect()}
    assert got == {"tiom": ("tion", 1), "oueautoin": ("oueaution", 1), "onrene": ("onrend", 1), "onreem": ("onreed", 1), "tionn": ("tionnt", 1), "thouinro": ("thouinre", 1)} | {t: (t, None) for t in tokens[6:]}
    assert index.terms.count() == 53918 and index.postings.count() == 216845
    assert [r.term for r in suggesting.suggest_positional(index.terms, "x" * 2).collect()] == [] and suggesting.suggest_positional(index.terms, "t").count() == 0


def test_distance():
    from skarn.functions.spelling import edit_distance

    assert [edit_distance(*p) for p in (("ca", "abc"), ("ab", "ba"), ("", "ab"), ("kitten", "sitting"), ("a", "a"))] == [2, 1, 2, 3, 0]


def test_command_lines(spark, tmp_path):
    from skarn.__main__ import main

    text = "<title>Dogs</title><p>" + "lazy dogs " * 15 + "</p>"
    rows = [("http://h/1", text + '<a href="/2">n</a>'), ("http://h/2", text)]
    spark.createDataFrame(rows, "url string, html string").withColumn("crawled_at", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    store = ["--store", str(tmp_path / "store")]
    assert main(["crawl", *store, "--fetched", str(tmp_path / "in"), "--seed", "http://h/1", "--max", "1"]) == {"saved": 1, "visited": 1}
    assert main(["crawl", *store, "--fetched", str(tmp_path / "in"), "--seed", "http://h/1", "--refresh-existing"])["saved"] == 2
    assert main(["index", *store])["pages"] == 2
    assert main(["search", *store, "--limit", "1", "dogs"])["total"] == 2
