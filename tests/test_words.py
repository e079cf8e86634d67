from skarn.functions.words import INDEX_STOPWORDS, QUERY_STOPWORDS, query_tokens, suggestion_prefix
from skarn.operators import indexing


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, title string, body_text string")


def test_query_tokens():
    assert query_tokens("The Quick, Brown fox jumps in the river!") == ["quick", "brown", "fox", "jumps", "river"]
    assert query_tokens("a b c JavaScript 101 BM25") == ["javascript", "bm"]
    assert query_tokens("tion tion") == ["tion", "tion"] and query_tokens(None) == query_tokens("the of") == []
    assert query_tokens("against during") == ["against", "during"]  # known to the index side only


def test_stopwords():
    assert len(INDEX_STOPWORDS) == 108 and set(INDEX_STOPWORDS) - set(QUERY_STOPWORDS) == {"against", "during"}


def test_index_tokens(spark):
    got = {(r.page_id, r.term): r.pos for r in indexing.token_positions(pages(spark, [(1, None, "The quick brown fox jumps over the lazy dog"), (2, "", "a b c go! 12 npm")])).collect()}
    assert got == {(1, "quick"): 1, (1, "brown"): 2, (1, "fox"): 3, (1, "jumps"): 4, (1, "lazy"): 7, (1, "dog"): 8, (2, "go"): 0, (2, "npm"): 1}


def test_caps(spark):
    r = indexing.postings(pages(spark, [(1, "alpha " * 30, "alpha " * 120)])).first()
    assert (r.freq_title, r.freq_body) == (30, 50) and len(r.positions.title) == 20 and r.positions.body == list(range(50))


def test_empty_pages_count(spark):
    p = pages(spark, [(1, None, None), (2, "", "the"), (3, "", "word")])
    got = {r.page_id: r.word_count for r in indexing.doc_lengths(p, indexing.postings(p)).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_prefixes():
    assert suggestion_prefix(" Ab3c% ", True) == "abc" and suggestion_prefix(" Ab3c% ", False) == "ab3c%"


def test_repeated_page_ids_are_one_page(spark):
    rows = indexing.postings(pages(spark, [(1, "ab the ab", "cd ab"), (1, "cd", "ab"), (2, None, None), (3, "", "the")])).orderBy("term").collect()
    assert [(r.term, r.page_id, r.freq_title, r.freq_body, r.positions.title, r.positions.body) for r in rows] == [("ab", 1, 2, 2, [0, 2], [0, 1]), ("cd", 1, 1, 1, [0], [0])]
