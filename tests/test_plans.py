"""What the physical plans have to look like."""

import re

import pytest
from pyspark.sql import functions as F

from skarn.operators import indexing, searching
from skarn.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def index(spark):
    return searching.build_index(tables.document_pages(tables.read(spark, SF, "documents")))


def test_classic_search_reads_only_what_it_scores(index):
    text = plan(searching.page_of(searching.score_classic(index, ["tion", "er"], indexing.RankingConfig()), 1, 10))
    assert re.search(r"PushedFilters: \[.*In\(term, \[(er,tion|tion,er)\]\)", text)
    assert "positions" not in text and "body_text" not in text
    assert "TakeOrderedAndProject" in text and "SortMergeJoin" not in text.split("page_rank")[0]


def test_positional_search_reads_positions_not_texts(index):
    text = plan(searching.page_of(searching.score_positional(index, ["tion", "er"], indexing.RankingConfig(), ), 1, 10))
    assert "positions" in text and "body_text" not in text


def test_tokens_are_cut_once(spark):
    """No filter repeats the word pattern before the explode."""
    text = plan(indexing.token_positions(tables.document_pages(tables.read(spark, SF, "documents"))))
    assert not [line for line in text.splitlines() if line.startswith("Condition") and "regexp_extract_all" in line]


def test_postings_shuffle_texts_only(spark):
    """Neither words nor lists of positions are shuffled or sorted across rows; lengths need no second shuffle of postings."""
    pages = tables.document_pages(tables.read(spark, SF, "documents"))
    text = plan(indexing.postings(pages))
    assert not re.search(r"hashpartitioning\(term", text)
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1
    assert not re.search(r"hashpartitioning\(term", plan(indexing.doc_lengths(pages, indexing.postings(pages))))


def test_each_file_of_the_index_is_sorted(spark, tmp_path):
    """So that a query reads its terms' and grams' own pages of every file."""
    kept = []

    def keep(df, name):
        kept.append(name)
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    found = searching.build_index(tables.document_pages(tables.read(spark, SF, "documents")), keep=keep)
    assert kept == ["postings", "terms", "page_rank", "index_meta", "grams"]
    for table, keys in ((found.postings, ["term", "page_id"]), (found.grams, ["gram", "term"])):
        for file in table.inputFiles():
            rows = [tuple(r) for r in spark.read.parquet(file).select(*keys).collect()]
            assert rows == sorted(rows)


def test_suggestions_are_pushed_down(index):
    from skarn.operators import suggesting

    text = plan(suggesting.suggest_classic(index.terms, "th"))
    assert "StringStartsWith(term,th)" in text and "GreaterThan(doc_freq,1)" in text and "TakeOrderedAndProject" in text


def test_graph_steps_do_not_grow(spark):
    from skarn.operators import graph

    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3)], "page_id long")
    sizes = [len(plan(graph.raw_ranks(edges, nodes, n).select(F.sum("rank")))) for n in (1, 3)]
    assert sizes[0] * 0.8 < sizes[1] < sizes[0] * 1.2


def test_enrichment_reads_the_pages_rows_only(index):
    top = searching.page_of(searching.score_classic(index, ["tion", "er"], indexing.RankingConfig()), 1, 3)
    assert re.search(r"PushedFilters: \[.*In\((?:page|doc)_id, \[[0-9]+,[0-9]+,[0-9]+\]\)", plan(searching.enrich(index, top, ["tion"])))


def test_spelling_reads_stored_grams_only(spark, index):
    from skarn.operators import spelling

    unknown = spelling.unknown_tokens(spelling.token_rows(spark, ["tiom"]), index.terms)
    text = plan(spelling.gram_overlap(unknown, index.grams))
    assert re.search(r"PushedFilters: \[.*In\(gram, \[", text) and "doc_freq" in text and "idf" not in text
