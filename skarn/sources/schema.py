"""Schemas of the crawl tables and the index tables."""

from __future__ import annotations

PAGES = "page_id long, url string, url_hash string, title string, body_text string, crawled_at timestamp"
CRAWL_LOG = "id long, url string, status int, crawled_at timestamp"
CRAWL_EDGES = "source_url_hash string, target_url_hash string"
TERMS = "term string, doc_freq long, idf double"
POSTINGS = "term string, page_id long, freq_title int, freq_body int, tf_title double, tf_body double, positions struct<title:array<int>,body:array<int>>"
PAGE_RANK = "page_id long, score double, word_count long, in_links long, out_links long"
GRAMS = "gram string, term string, doc_freq long"
INDEX_META = "key_name string, value_num double, value_text string, updated_at timestamp"

#: Tables by name.
TABLES = {
    "pages": PAGES,
    "crawl_log": CRAWL_LOG,
    "crawl_edges": CRAWL_EDGES,
    "terms": TERMS,
    "postings": POSTINGS,
    "page_rank": PAGE_RANK,
    "index_meta": INDEX_META,
    "grams": GRAMS,
}
