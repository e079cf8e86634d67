"""Queries of the search engine's operators, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markup, scoring
from .functions import spelling as spell_columns
from .functions.words import INDEX_STOPWORDS, query_tokens
from .operators import crawling, graph, indexing, searching, spelling, suggesting
from .operators.indexing import RankingConfig
from .plans.lineage import cut
from .sources import tables
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"{_BASE}\n{sql}"
        return f

    return add


@lru_cache(maxsize=4)
def _index(app: str, spark: SparkSession, sf_dir: str) -> searching.Index:
    pages = pages_of(spark, sf_dir)
    return searching.build_index(pages, tables.host_chain(pages))


def index_of(spark: SparkSession, sf_dir: str) -> searching.Index:
    """The index of documents, linked as chains of equal source; built once a session."""
    return _index(spark.sparkContext.applicationId, spark, sf_dir)


def config_of(index: searching.Index, profile: str = "classic") -> RankingConfig:
    return indexing.load_config(index.meta, profile)


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.document_pages(tables.read(spark, sf_dir, "documents"))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "pages").select("page_id", "url", "html")


_STOP = ", ".join(f"'{w}'" for w in INDEX_STOPWORDS)
_BASE = f"""
WITH RECURSIVE pg AS (
  SELECT doc_id AS page_id, 'https://' || source || '.example/' || doc_id AS url, source AS host,
         substring(split_part(text, chr(10), 1), 1, 512) AS title, text AS body_text FROM documents
), words AS (
  SELECT page_id, 'title' AS field, regexp_extract_all(lower(coalesce(title, '')), '[a-z]{{2,}}') AS w FROM pg
  UNION ALL SELECT page_id, 'body', regexp_extract_all(lower(coalesce(body_text, '')), '[a-z]{{2,}}') FROM pg
), tok AS (
  SELECT * FROM (SELECT page_id, field, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM words) WHERE term NOT IN ({_STOP})
), post AS (
  SELECT term, page_id, least(count(*) FILTER (field = 'title'), 50) AS ft, least(count(*) FILTER (field = 'body'), 50) AS fb,
         coalesce(list_slice(list(pos ORDER BY pos) FILTER (field = 'title'), 1, 20), []) AS pt,
         coalesce(list_slice(list(pos ORDER BY pos) FILTER (field = 'body'), 1, 50), []) AS pb
  FROM tok GROUP BY term, page_id
), trm AS (
  SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM pg) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term
), len AS (
  SELECT pg.page_id, CAST(coalesce(sum(ft + fb), 0) AS BIGINT) AS wc FROM pg LEFT JOIN post USING (page_id) GROUP BY pg.page_id
), av AS (
  SELECT greatest(avg(wc), 1) AS al FROM len
), edges AS (
  SELECT src, dst FROM (SELECT page_id AS src, lead(page_id) OVER (PARTITION BY host ORDER BY page_id) AS dst FROM pg) WHERE dst IS NOT NULL
), node AS (
  SELECT p.page_id, (SELECT count(*) FROM edges e WHERE e.src = p.page_id) AS outs, (SELECT count(*) FROM edges e WHERE e.dst = p.page_id) AS ins FROM pg p
), walk AS (
  SELECT 0 AS step, page_id, 1.0::DOUBLE / (SELECT count(*) FROM node) AS rank FROM node
  UNION ALL
  SELECT step, page_id, 0.15 / total + 0.85 * sum(CASE WHEN outs = 0 THEN rank ELSE 0 END) OVER () / total + 0.85 * into_rank FROM (
    SELECT w.step + 1 AS step, n.page_id, n.outs, w.rank, count(*) OVER () AS total,
           coalesce(lag(w.rank) OVER (PARTITION BY p.host ORDER BY n.page_id), 0) AS into_rank
    FROM walk w JOIN node n USING (page_id) JOIN pg p USING (page_id) WHERE w.step < 20)
), pr AS (
  SELECT page_id, rank, CASE WHEN max(rank) OVER () - min(rank) OVER () > 1e-12 THEN (rank - min(rank) OVER ()) / (max(rank) OVER () - min(rank) OVER ()) ELSE 0 END AS score
  FROM walk WHERE step = 20
)"""


# ---------------------------------------------------------------- tokens and index tables


@query("SELECT page_id, field, term, CAST(pos AS INTEGER) AS pos FROM tok")
def token_positions(spark, sf_dir):
    return indexing.token_positions(pages_of(spark, sf_dir))


@query("SELECT term, page_id, CAST(ft AS INTEGER) AS freq_title, CAST(fb AS INTEGER) AS freq_body FROM post")
def term_counts_capped(spark, sf_dir):
    return indexing.postings(pages_of(spark, sf_dir)).select("term", "page_id", "freq_title", "freq_body")


@query("SELECT term, page_id, array_to_string(pt, ' ') AS title_positions, array_to_string(pb, ' ') AS body_positions FROM post")
def postings_positions(spark, sf_dir):
    return index_of(spark, sf_dir).postings.select("term", "page_id", F.array_join(F.col("positions.title").cast("array<string>"), " ").alias("title_positions"), F.array_join(F.col("positions.body").cast("array<string>"), " ").alias("body_positions"))


@query("SELECT page_id, wc AS word_count FROM len")
def doc_lengths(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    return indexing.doc_lengths(pages, indexing.postings(pages))


@query("SELECT term, df AS doc_freq, round(idf, 6) AS idf FROM trm")
def terms_idf(spark, sf_dir):
    return index_of(spark, sf_dir).terms.select("term", "doc_freq", F.round("idf", 6).alias("idf"))


@query("SELECT (SELECT count(*) FROM pg) AS pages, (SELECT count(*) FROM trm) AS terms, (SELECT count(*) FROM post) AS postings, (SELECT round(al, 6) FROM av) AS avg_doc_len")
def stats(spark, sf_dir):
    i = index_of(spark, sf_dir)
    counts = [t.agg(F.count("*").alias(n)) for t, n in ((i.pages, "pages"), (i.terms, "terms"), (i.postings, "postings"))]
    average = i.page_rank.agg(F.round(F.greatest(F.avg("word_count"), F.lit(1.0)), 6).alias("avg_doc_len"))
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(average)  # one row each


@query("""SELECT * FROM (VALUES ('bm25_k1', 1.2e0, NULL), ('bm25_b', 0.75e0, NULL), ('title_boost', 2.5e0, NULL), ('page_rank_weight', 0.35e0, NULL), ('coverage_weight', 0.2e0, NULL),
  ('ranking_strategy', NULL, 'bm25_field_boost_graph_pr')) v(key_name, value_num, value_text)
  UNION ALL SELECT 'avg_doc_len', round(avg(wc), 6), NULL FROM len UNION ALL SELECT 'page_count', count(*), NULL FROM pg UNION ALL SELECT 'term_count', count(*), NULL FROM trm""")
def index_meta(spark, sf_dir):
    meta = index_of(spark, sf_dir).meta.filter("key_name <> 'last_index_unix'")
    return meta.select("key_name", F.round("value_num", 6).alias("value_num"), "value_text")


@query("SELECT 'bm25_field_boost_graph_pr' AS strategy, 1.2e0 AS k1, 0.75e0 AS b, 2.5e0 AS title_boost, 0.35e0 AS page_rank_weight, 0.2e0 AS coverage_weight, 0.9e0 AS phrase_weight, 0.45e0 AS proximity_weight, round(al, 6) AS avg_doc_len FROM av")
def meta_pivot(spark, sf_dir):
    return indexing.pivot_meta(index_of(spark, sf_dir).meta).withColumn("avg_doc_len", F.round("avg_doc_len", 6))


@query("SELECT p_partkey AS page_id, term, count(*) AS n FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z]{2,}')) AS term FROM part UNION ALL SELECT p_partkey, unnest(regexp_extract_all(lower(p_type), '[a-z]{2,}')) FROM part) WHERE term NOT IN (" + _STOP + ") GROUP BY ALL")
def set_union_terms(spark, sf_dir):
    return indexing.postings(tables.part_pages(tables.read(spark, sf_dir, "part"))).select("page_id", "term", (F.col("freq_title") + F.col("freq_body")).cast("long").alias("n"))


# ---------------------------------------------------------------- link graph


@query("SELECT src, dst FROM edges")
def edges_resolved(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    chain, ids = tables.host_chain(pages), pages.select("page_id", "url_hash")
    by_hash = chain.join(ids.select(F.col("page_id").alias("src"), F.col("url_hash").alias("source_url_hash")), "src").join(ids.select(F.col("page_id").alias("dst"), F.col("url_hash").alias("target_url_hash")), "dst")
    return graph.resolve_edges(by_hash.select("source_url_hash", "target_url_hash"), pages)


@query("SELECT page_id, ins AS in_links, outs AS out_links FROM node")
def degrees(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    return graph.degrees(tables.host_chain(pages), pages)


@query("SELECT page_id, round(rank * 1e6, 4) AS rank_ppm FROM walk WHERE step = 20")
def pagerank_raw(spark, sf_dir):
    pages = cut(pages_of(spark, sf_dir).select("page_id", "url"), "pages")
    return graph.raw_ranks(tables.host_chain(pages), pages).select("page_id", F.round(F.col("rank") * 1e6, 4).alias("rank_ppm"))


@query("SELECT l.page_id, round(pr.score, 6) AS score, wc AS word_count, ins AS in_links, outs AS out_links FROM len l JOIN pr USING (page_id) JOIN node USING (page_id)")
def page_rank_table(spark, sf_dir):
    return index_of(spark, sf_dir).page_rank.select("page_id", F.round("score", 6).alias("score"), "word_count", "in_links", "out_links")


@query("SELECT round(sum(CASE WHEN outs = 0 THEN rank ELSE 0 END), 9) AS dangling, round(sum(rank), 9) AS total FROM walk JOIN node USING (page_id) WHERE step = 20")
def dangling_mass(spark, sf_dir):
    pages = cut(pages_of(spark, sf_dir).select("page_id", "url"), "pages")
    ranks = graph.raw_ranks(tables.host_chain(pages), pages)
    return ranks.agg(F.round(F.sum(F.when(F.col("out_links") == 0, F.col("rank")).otherwise(0.0)), 9).alias("dangling"), F.round(F.sum("rank"), 9).alias("total"))


@query(", trade AS (SELECT DISTINCT o_custkey AS src, 1000000000 + l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey), party AS (SELECT c_custkey AS page_id FROM customer UNION ALL SELECT 1000000000 + s_suppkey FROM supplier) SELECT page_id, coalesce(i, 0) AS in_links, coalesce(o, 0) AS out_links FROM party LEFT JOIN (SELECT dst, count(*) AS i FROM trade GROUP BY dst) ON page_id = dst LEFT JOIN (SELECT src, count(*) AS o FROM trade GROUP BY src) ON page_id = src")
def trade_degrees(spark, sf_dir):
    """The graph of who buys from whom: customers to suppliers, over all orders; suppliers' ids begin at 10^9."""
    t = {n: tables.read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier")}
    supplier = F.lit(1_000_000_000)
    trade = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (supplier + F.col("l_suppkey")).alias("dst"))
    nodes = t["customer"].select(F.col("c_custkey").alias("page_id")).union(t["supplier"].select((supplier + F.col("s_suppkey")).alias("page_id")))
    return graph.degrees(trade, nodes)


_SHARED_SQL = """, link AS (SELECT page_id AS src, page_id // 3 AS dst FROM pg WHERE page_id > 0 UNION SELECT page_id, page_id // 7 FROM pg WHERE page_id > 0
), size AS (SELECT count(*) AS total FROM pg
), outs AS (SELECT src, count(*) AS n FROM link GROUP BY src
), step AS (
  SELECT 0 AS k, page_id, 1.0::DOUBLE / total AS rank FROM pg, size
  UNION ALL
  SELECT any_value(k) + 1, page_id, 0.15 / any_value(total) + 0.85 * any_value(loose) / any_value(total) + 0.85 * coalesce(sum(share), 0) FROM (
    SELECT s.k, s.page_id, total, NULL AS share, sum(CASE WHEN n IS NULL THEN rank ELSE 0 END) OVER () AS loose FROM step s LEFT JOIN outs ON src = s.page_id, size WHERE s.k < 20
    UNION ALL SELECT s.k, link.dst, NULL, rank / n, NULL FROM step s JOIN link ON link.src = s.page_id JOIN outs ON outs.src = s.page_id WHERE s.k < 20
  ) GROUP BY page_id
)"""


@query(_SHARED_SQL + " SELECT page_id, round(rank * 1e6, 4) AS rank_ppm FROM step WHERE k = 20")
def pagerank_shared(spark, sf_dir):
    """Ranks in a tree of links in which up to ten pages share a target."""
    pages = cut(pages_of(spark, sf_dir).select("page_id", "url"), "pages")
    up = pages.filter("page_id > 0")
    links = up.selectExpr("page_id AS src", "page_id DIV 3 AS dst").union(up.selectExpr("page_id AS src", "page_id DIV 7 AS dst")).distinct()
    return graph.raw_ranks(links, pages).select("page_id", F.round(F.col("rank") * 1e6, 4).alias("rank_ppm"))


# ---------------------------------------------------------------- ranked search


def _list(tokens: list[str]) -> str:
    return "(" + ", ".join(f"'{t}'" for t in tokens) + ")" if tokens else "('')"


def _classic_sql(q: str, rank: bool = True, where: str = "", last: str = "ORDER BY final_score DESC, page_id LIMIT 20") -> str:
    pr = "coalesce(max(pr.score), 0)" if rank else "0"
    return f""", hit AS (
  SELECT p.page_id, sum(t.idf * ((fb + ft * 2.5) * 2.2) / ((fb + ft * 2.5) + 1.2 * (1 - 0.75 + 0.75 * (wc / al)))) AS bm25, count(*) AS term_hits,
         count(*) / (SELECT count(*) FROM trm WHERE term IN {_list(query_tokens(q))})::DOUBLE AS coverage, {pr} AS page_rank
  FROM post p JOIN trm t USING (term) JOIN len USING (page_id) LEFT JOIN pr USING (page_id) CROSS JOIN av WHERE t.term IN {_list(query_tokens(q))} {where} GROUP BY p.page_id
), ranked AS (SELECT *, bm25 + 0.35 * page_rank + 0.2 * coverage AS final_score FROM hit {last})"""


_CLASSIC_OUT = " SELECT page_id, round(bm25, 4) AS bm25, term_hits, round(coverage, 3) AS coverage, round(page_rank, 4) AS page_rank, round(final_score, 4) AS score FROM ranked"


def _shown(df: DataFrame, places: int = 3) -> DataFrame:
    more = [F.round(c, 4).alias(c) for c in ("phrase", "proximity") if c in df.columns]
    return df.select("page_id", F.round("bm25", 4).alias("bm25"), "term_hits", F.round("coverage", places).alias("coverage"), F.round("page_rank", 4).alias("page_rank"), *more, F.round("final_score", 4).alias("score"))


def _classic(name: str, q: str, page: int = 1, limit: int = 20):
    @query(_classic_sql(q, last=f"ORDER BY final_score DESC, page_id LIMIT {limit} OFFSET {(page - 1) * limit}") + _CLASSIC_OUT)
    def run(spark, sf_dir):
        i = index_of(spark, sf_dir)
        return _shown(searching.page_of(searching.score_classic(i, query_tokens(q), config_of(i)), page, limit))

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_classic("search_single", "tion")
_classic("search_pair", "tion er")
_classic("search_four_terms", "TION, (er) st nd!")
_classic("search_page2", "tion er", page=2, limit=10)
_classic("search_rare_and_common", "onreen tion")
_classic("search_unmatched_term", "zzzz tion")
_classic("search_duplicate_term", "tion tion")
_classic("search_stopwords_only", "the of")


@query(_classic_sql("tion er st", last="") + " SELECT page_id, term_hits, round(coverage, 6) AS coverage FROM ranked")
def search_coverage(spark, sf_dir):
    i = index_of(spark, sf_dir)
    return searching.score_classic(i, query_tokens("tion er st"), config_of(i)).select("page_id", "term_hits", F.round("coverage", 6).alias("coverage"))


@query(_classic_sql("tion er st", last="") + " SELECT page_id, round(bm25, 6) AS bm25 FROM ranked")
def bm25_all(spark, sf_dir):
    i = index_of(spark, sf_dir)
    return searching.score_classic(i, query_tokens("tion er st"), config_of(i)).select("page_id", F.round("bm25", 6).alias("bm25"))


@query(f" SELECT count(DISTINCT page_id) AS total FROM post WHERE term IN {_list(query_tokens('tion er'))}")
def search_total(spark, sf_dir):
    return searching.total_hits(index_of(spark, sf_dir), query_tokens("tion er"))


@query(_classic_sql("tion er", where="AND p.page_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)") + _CLASSIC_OUT)
def search_filtered_by_label(spark, sf_dir):
    i = index_of(spark, sf_dir)
    good = tables.read(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("page_id")).distinct()
    return _shown(searching.page_of(searching.score_classic(i, query_tokens("tion er"), config_of(i), good), 1, 20))


@query(_classic_sql("tion er", last="ORDER BY final_score DESC, page_id LIMIT 10") + """, cut AS (
  SELECT r.page_id, coalesce(nullif(title, ''), url) AS title, url, body_text AS b FROM ranked r JOIN pg USING (page_id)
), hits AS (SELECT *, coalesce(least(nullif(instr(lower(b), 'tion'), 0), nullif(instr(lower(b), 'er'), 0)), 0) AS found FROM cut
), part AS (SELECT *, greatest(0, found - 81) AS s FROM hits)
SELECT page_id, title, url, CASE WHEN s > 0 THEN '...' ELSE '' END
  || regexp_replace(replace(replace(replace(replace(replace(substring(b, s + 1, 220), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '(tion|er)', '<mark>\\1</mark>', 'gi')
  || CASE WHEN s + 220 < length(b) THEN '...' ELSE '' END AS snippet FROM part""")
def search_snippets(spark, sf_dir):
    i = index_of(spark, sf_dir)
    top = searching.page_of(searching.score_classic(i, query_tokens("tion er"), config_of(i)), 1, 10)
    return searching.enrich(i, top, ["tion", "er"]).select("page_id", "title", "url", "snippet")


# ---------------------------------------------------------------- positional signals


def _span_sql(tokens: list[str], field: str) -> str:
    """Smallest stretch over the token lists of a field, by trying every position as the left end."""
    distinct = list(dict.fromkeys(tokens))
    ends = ", ".join(f"list_min(list_filter(l{distinct.index(t)}{field}, lambda y: y >= x))" for t in tokens)
    every = "list_concat(" + ", ".join(f"l{i}{field}" for i in range(len(distinct))) + ")" if len(distinct) > 1 else f"l0{field}"
    whole = " AND ".join(f"list_min(list_filter(l{i}{field}, lambda y: y >= x)) IS NOT NULL" for i in range(len(distinct)))
    return f"list_min(list_transform({every}, lambda x: CASE WHEN {whole} THEN greatest({ends}) - x END))"


def _signals_sql(q: str) -> str:
    tokens = query_tokens(q)
    distinct = list(dict.fromkeys(tokens))
    ix = [distinct.index(t) for t in tokens]
    n = len(tokens) - 1
    lists = ", ".join(f"coalesce(any_value(p{f}) FILTER (term = '{t}'), []) AS l{i}{f}" for i, t in enumerate(distinct) for f in "tb")
    parts = []
    for f in "tb":
        some = " AND ".join(f"len(l{i}{f}) > 0" for i in range(len(distinct)))
        pairs = " + ".join(f"CASE WHEN list_has_any(list_transform(l{a}{f}, lambda x: x + 1), l{b}{f}) THEN 1 ELSE 0 END" for a, b in zip(ix, ix[1:], strict=False))
        phrase = " AND ".join(f"list_contains(l{k}{f}, x + {j})" for j, k in enumerate(ix))
        parts += [
            f"CASE WHEN {some} THEN ({pairs}) / {float(n)} ELSE 0 END AS pair{f}",
            f"CASE WHEN {some} AND len(list_filter(l{ix[0]}{f}, lambda x: {phrase})) > 0 THEN 1 ELSE 0 END AS full{f}",
            f"CASE WHEN {some} THEN coalesce(1.0::DOUBLE / (1 + greatest(0, {_span_sql(tokens, f)} - {n})), 0) ELSE 0 END AS near{f}",
        ]
    return f""", lists AS (SELECT page_id, {lists} FROM post WHERE term IN {_list(tokens)} GROUP BY page_id
), sig AS (SELECT page_id, {', '.join(parts)} FROM lists
), pos AS (SELECT *, round(1.4 * pairt + pairb + 1.8 * fullt + 1.25 * fullb, 4) AS phrase, round(1.15 * neart + nearb, 4) AS proximity FROM sig)"""


@query(_signals_sql("th er") + " SELECT page_id, round(pairt, 6) AS title_pairs, round(pairb, 6) AS body_pairs, CAST(fullt AS DOUBLE) AS title_phrase, CAST(fullb AS DOUBLE) AS body_phrase, round(neart, 6) AS title_nearness, round(nearb, 6) AS body_nearness FROM sig")
def field_signals(spark, sf_dir):
    i, tokens = index_of(spark, sf_dir), query_tokens("th er")
    lists = searching.positions_by_token(searching.candidates(i, tokens), tokens)
    t, b = scoring.field_signals([F.col("t0"), F.col("t1")]), scoring.field_signals([F.col("b0"), F.col("b1")])
    return lists.select("page_id", *(F.round(c, 6).alias(f"{f}_{n}") for f, s in (("title", t), ("body", b)) for n, c in zip(("pairs", "phrase", "nearness"), s, strict=True)))


@query(_signals_sql("tion er st") + " SELECT page_id, phrase, proximity FROM pos")
def positional_signals(spark, sf_dir):
    i, tokens = index_of(spark, sf_dir), query_tokens("tion er st")
    phrase, near = searching.signal_columns(tokens)
    return searching.positions_by_token(searching.candidates(i, tokens), tokens).select("page_id", phrase.alias("phrase"), near.alias("proximity"))


def _positional_sql(q: str, limit: int = 20, offset: int = 0) -> str:
    tokens = query_tokens(q)
    return _signals_sql(q) + f""", hit AS (
  SELECT p.page_id, sum(t.idf * ((fb + ft * 2.5) * 2.2) / ((fb + ft * 2.5) + 1.2 * (1 - 0.75 + 0.75 * (CASE WHEN wc = 0 THEN al ELSE wc END / al)))) AS bm25, count(*) AS term_hits, count(*) / {float(len(tokens))} AS coverage, coalesce(max(pr.score), 0) AS page_rank
  FROM post p JOIN trm t USING (term) JOIN len USING (page_id) LEFT JOIN pr USING (page_id) CROSS JOIN av WHERE t.term IN {_list(tokens)} GROUP BY p.page_id
), ranked AS (SELECT h.*, phrase, proximity, round(bm25 + 0.35 * page_rank + 0.2 * coverage + 0.9 * phrase + 0.45 * proximity, 4) AS final_score FROM hit h JOIN pos USING (page_id) ORDER BY final_score DESC, page_id LIMIT {limit} OFFSET {offset})
SELECT page_id, round(bm25, 4) AS bm25, term_hits, round(coverage, 4) AS coverage, round(page_rank, 4) AS page_rank, phrase, proximity, final_score AS score FROM ranked"""


def _positional(name: str, q: str, page: int = 1, limit: int = 20):
    @query(_positional_sql(q, limit, (page - 1) * limit))
    def run(spark, sf_dir):
        i = index_of(spark, sf_dir)
        return _shown(searching.page_of(searching.score_positional(i, query_tokens(q), config_of(i, "positional")), page, limit), 4)

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_positional("search_positional", "th er st")
_positional("search_positional_page2", "th er", page=2, limit=10)
_positional("search_positional_duplicate", "tion tion")
_positional("search_positional_unmatched", "zzzz tion")


# ---------------------------------------------------------------- spelling

_TYPOS = ["tiom", "oueautoin", "onrene", "onreem", "tionn", "thouinro", "zzzz", "qrxv", "during", "against", "tion", "er"]
_GRAMS_SQL = """list_distinct(list_concat(list_transform(generate_series(1, len({0}) + 1), lambda i: substring('^' || {0} || '$', i, 2)),
  CASE WHEN len({0}) > 4 THEN list_transform(generate_series(1, len({0})), lambda i: substring('^' || {0} || '$', i, 3)) ELSE [] END))"""
_MAX_SQL = "CASE WHEN len({0}) <= 4 THEN 1 WHEN len({0}) <= 8 THEN 2 ELSE 3 END"
_ALL_GRAMS_SQL = _GRAMS_SQL.removeprefix("list_distinct(").removesuffix(")")
_CORRECT_SQL = f""", ask AS (SELECT unnest({_TYPOS!r}) AS token
), unk AS (SELECT DISTINCT token FROM ask WHERE len(token) >= 3 AND token NOT IN (SELECT term FROM trm)
), gram_of AS (SELECT token, unnest({_GRAMS_SQL.format('token')}) AS gram, len({_GRAMS_SQL.format('token')}) AS keys, {_ALL_GRAMS_SQL.format('token')} AS line FROM unk
), lex AS (SELECT term, df, unnest({_GRAMS_SQL.format('term')}) AS gram FROM trm
), ov AS (SELECT token, term AS cand, df, keys, count(*) AS overlap, min(list_position(line, gram)) AS first_gram FROM gram_of JOIN lex USING (gram) WHERE abs(len(term) - len(token)) <= {_MAX_SQL.format('token')} GROUP BY ALL
), near AS (SELECT *, damerau_levenshtein(token, cand) AS distance FROM ov
), scored AS (SELECT *, overlap / keys::DOUBLE * 2.2 + CASE WHEN token[1] = cand[1] THEN 0.25 ELSE 0 END + ln(1 + df) * 0.08 - distance * 0.95 AS score FROM near WHERE distance <= {_MAX_SQL.format('token')})"""


def _asked(spark) -> DataFrame:
    return spelling.token_rows(spark, _TYPOS)


@query(f" SELECT term, array_to_string(list_sort({_GRAMS_SQL.format('term')}), ' ') AS grams FROM trm")
def term_grams(spark, sf_dir):
    return index_of(spark, sf_dir).terms.select("term", F.array_join(F.array_sort(spell_columns.grams(F.col("term"))), " ").alias("grams"))


@query(_CORRECT_SQL + " SELECT token, cand, overlap, keys FROM ov")
def gram_overlap(spark, sf_dir):
    i = index_of(spark, sf_dir)
    return spelling.gram_overlap(spelling.unknown_tokens(_asked(spark), i.terms), i.grams).select("token", "cand", "overlap", F.col("keys").cast("long").alias("keys"))


@query(_CORRECT_SQL + " SELECT token, cand, CAST(distance AS INTEGER) AS distance, round(score, 6) AS score FROM scored")
def edit_distance_candidates(spark, sf_dir):
    i = index_of(spark, sf_dir)
    return spelling.scored_candidates(spelling.unknown_tokens(_asked(spark), i.terms), i.grams).select("token", "cand", "distance", F.round("score", 6).alias("score"))


_BEST_SQL = _CORRECT_SQL + ", best AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, df DESC, first_gram, cand) AS r FROM scored WHERE score >= 0.15)"


@query(_BEST_SQL + " SELECT token, cand AS correction, CAST(distance AS INTEGER) AS distance, round(score, 6) AS score FROM best WHERE r = 1")
def corrections(spark, sf_dir):
    i = index_of(spark, sf_dir)
    return spelling.corrections(spelling.unknown_tokens(_asked(spark), i.terms), i.grams).select("token", "correction", "distance", F.round("score", 6).alias("score"))


@query(_BEST_SQL + """, asked AS (SELECT generate_subscripts(t, 1) - 1 AS ix, unnest(t) AS token FROM (SELECT """ + repr(_TYPOS) + """ AS t))
  SELECT CAST(ix AS INTEGER) AS ix, a.token, coalesce(cand, a.token) AS term, CAST(distance AS INTEGER) AS distance FROM asked a LEFT JOIN (FROM best WHERE r = 1) b ON a.token = b.token""")
def corrected_query(spark, sf_dir):
    i = index_of(spark, sf_dir)
    return spelling.correct_tokens(_asked(spark), i.terms, i.grams)


@query(", asked AS (SELECT generate_subscripts(t, 1) - 1 AS ix, unnest(t) AS token FROM (SELECT " + repr(_TYPOS) + " AS t)) SELECT CAST(ix AS INTEGER) AS ix, token, token IN (SELECT term FROM trm) AS matched FROM asked")
def matched_tokens(spark, sf_dir):
    return searching.split_tokens(index_of(spark, sf_dir), _asked(spark))


@query(_positional_sql("tion er"))
def search_corrected(spark, sf_dir):
    """A misspelt query finds what the words spelt right find."""
    i = index_of(spark, sf_dir)
    fixed = spelling.correct_tokens(spelling.token_rows(spark, query_tokens("tiom er")), i.terms, i.grams).orderBy("ix").collect()  # the query's tokens
    return _shown(searching.page_of(searching.score_positional(i, [r.term for r in fixed], config_of(i, "positional")), 1, 20), 4)


# ---------------------------------------------------------------- suggestions, administration


@query(" SELECT term, df AS doc_freq FROM trm WHERE starts_with(term, 'th') AND df > 1 ORDER BY df DESC, term LIMIT 8")
def suggest_classic(spark, sf_dir):
    return suggesting.suggest_classic(index_of(spark, sf_dir).terms, "th")


@query(" SELECT term, df AS doc_freq FROM trm WHERE starts_with(term, 'onre') ORDER BY df DESC, term LIMIT 8")
def suggest_positional(spark, sf_dir):
    return suggesting.suggest_positional(index_of(spark, sf_dir).terms, "onre")


@query(""", p AS (SELECT term, df, unnest(list_transform(generate_series(1, len(term)), lambda i: substring(term, 1, i))) AS prefix FROM trm),
  r AS (SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY df DESC, term) AS rank, term, df AS doc_freq FROM p) SELECT prefix, CAST(rank AS INTEGER) AS rank, term, doc_freq FROM r WHERE rank <= 12""")
def prefix_top12(spark, sf_dir):
    return suggesting.prefix_table(index_of(spark, sf_dir).terms)


_LOG_SQL = "log AS (SELECT event_id AS id, 'https://e.example/' || user_id AS url, CASE WHEN event_type = 'purchase' THEN 200 WHEN event_type = 'error' THEN 0 WHEN event_type = 'signup' THEN 403 ELSE 200 + user_id % 3 * 100 END AS status, ts AS crawled_at FROM events)"


@query(f", {_LOG_SQL} SELECT count(*) AS crawl_attempts, count(*) FILTER (status = 200) AS crawl_success, max(crawled_at) AS last_crawled_at FROM log")
def crawl_success(spark, sf_dir):
    return crawling.crawl_metrics(tables.crawl_log(tables.read(spark, sf_dir, "events")))


@query(" SELECT round(avg(wc), 2) AS avg_doc_len, round(avg(score), 6) AS avg_page_rank FROM len JOIN pr USING (page_id)")
def metrics(spark, sf_dir):
    return index_of(spark, sf_dir).page_rank.agg(F.round(F.avg("word_count"), 2).alias("avg_doc_len"), F.round(F.avg("score"), 6).alias("avg_page_rank"))


@query(f", {_LOG_SQL} SELECT date_trunc('hour', crawled_at) AS hour, CAST(status AS INTEGER) AS status, count(*) AS n FROM log GROUP BY ALL")
def fetches_by_hour(spark, sf_dir):
    """Time windows over a table; the same plan runs over a stream (streaming/ingest.py)."""
    out = ingest.hourly_fetches(tables.crawl_log(tables.read(spark, sf_dir, "events")))
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(" SELECT 'q' || user_id % 40 AS query, max(ts) AS last_used FROM events GROUP BY 1 ORDER BY last_used DESC, query LIMIT 8")
def query_history(spark, sf_dir):
    asked = tables.read(spark, sf_dir, "events").select(F.concat(F.lit("q"), (F.col("user_id") % 40).cast("string")).alias("query"), "ts")
    return suggesting.query_history(asked)


@query(f", {_LOG_SQL} SELECT date_trunc('hour', crawled_at) AS hour, CAST(status AS INTEGER) AS status, count(*) AS n FROM log GROUP BY ALL")
def stream_fetches_by_hour(spark, sf_dir):
    """The windows of fetches_by_hour, counted by a stream over the table's files."""
    counts = ingest.hourly_fetches(tables.crawl_log(tables.stream(spark, sf_dir, "events")).withColumn("crawled_at", F.col("crawled_at").cast("timestamp")))
    kept: list[DataFrame] = []
    running = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: kept.append(cut(df, "hours"))).trigger(availableNow=True).start()
    running.awaitTermination()
    return kept[-1].withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(f" SELECT count(*) AS candidate_pool FROM post WHERE term IN {_list(query_tokens('tion er st'))}")
def candidate_pool(spark, sf_dir):
    return searching.candidates(index_of(spark, sf_dir), query_tokens("tion er st")).agg(F.count("*").alias("candidate_pool"))


# ---------------------------------------------------------------- pages and crawl tables


@query(" SELECT page_id, sha256(substring(url, 1, 2000)) AS url_hash, split_part(url, '#', 1) AS plain_url FROM pages")
def url_hash(spark, sf_dir):
    return web_pages(spark, sf_dir).select("page_id", markup.url_hash(F.col("url")).alias("url_hash"), markup.without_fragment(F.col("url")).alias("plain_url"))


@query(" SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_sha256 FROM pages")
def html_escape(spark, sf_dir):
    return web_pages(spark, sf_dir).select("page_id", F.sha2(markup.escape_html(F.col("html")), 256).alias("escaped_sha256"))


def _html_sql() -> str:
    text = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "nav", "footer", "header"):
        text = f"regexp_replace({text}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return text


def _decoded_sql(text: str) -> str:
    """The entities that stand in the test tables, and some more; the ampersand last."""
    for name, raw in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{raw}')"
    return text


_COLLAPSED = "trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query(f""" SELECT page_id, coalesce(nullif({_COLLAPSED.format(_decoded_sql("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '<[^>]*>', ' ', 'g')"))}, ''), url) AS title FROM pages""")
def html_title(spark, sf_dir):
    return web_pages(spark, sf_dir).select("page_id", markup.html_title(F.col("html"), F.col("url")).alias("title"))


@query(f""" SELECT page_id, {_COLLAPSED.format(_decoded_sql(f"regexp_replace({_html_sql()}, '<[^>]*>', ' ', 'g')"))} AS body_text FROM pages""")
def html_text(spark, sf_dir):
    return web_pages(spark, sf_dir).select("page_id", markup.html_text(F.col("html")).alias("body_text"))


@query(f""", body AS (SELECT url, {_COLLAPSED.format(_decoded_sql(f"regexp_replace({_html_sql()}, '<[^>]*>', ' ', 'g')"))} AS t FROM pages) SELECT sha256(url) AS url_hash, length(t) AS n FROM body WHERE length(t) >= 100""")
def pages_extracted(spark, sf_dir):
    return crawling.extract_pages(web_pages(spark, sf_dir)).select("url_hash", F.length("body_text").cast("long").alias("n"))


@query(""" SELECT DISTINCT split_part(url, '#', 1) AS url, regexp_extract(url, '^(https?://[^/#?]+)', 1) || '/p' || page_id % 7 AS link FROM pages""")
def links_extracted(spark, sf_dir):
    """The pages' own links all stand in menus, which crawls leave out; each page gets four more links, of which one counts."""
    more = F.concat(F.lit('<p><a href="/x/../p'), (F.col("page_id") % 7).cast("string"), F.lit('#top">a</a> <a href="https://other.example/">b</a> <a href="mailto:c@d">c</a><nav><a href="/menu">d</a></nav></p>'))
    links = crawling.extract_links(web_pages(spark, sf_dir).withColumn("html", F.concat("html", more)))
    return links.select(markup.without_fragment(F.col("url")).alias("url"), "link").distinct()


@query(" SELECT term, page_id, len(pt) AS n_title, len(pb) AS n_body, '{\"title\":[' || array_to_string(pt, ',') || '],\"body\":[' || array_to_string(pb, ',') || ']}' AS positions FROM post")
def positions_json(spark, sf_dir):
    """Positions to JSON and back."""
    text = index_of(spark, sf_dir).postings.select("term", "page_id", indexing.positions_json(F.col("positions")).alias("positions"))
    back = indexing.parse_positions(F.col("positions"))
    return text.select("term", "page_id", F.size(back["title"]).cast("long").alias("n_title"), F.size(back["body"]).cast("long").alias("n_body"), "positions")


@query(""", r AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, '/' || regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1) AS path FROM pages)
  SELECT page_id FROM r WHERE host IN (SELECT host FROM r WHERE page_id % 5 > 0) AND (path LIKE '/p1%' OR path NOT LIKE '/p%') """)
def robots_allowed(spark, sf_dir):
    """Hosts of four fifths of the pages have a robots file, which lets /p1 and disallows /p; other hosts are denied."""
    pages = web_pages(spark, sf_dir)
    body = F.lit("User-agent: *\nAllow: /p1\nDisallow: /p\n\nUser-agent: other\nDisallow: /\n")
    files = pages.filter("page_id % 5 > 0").select(F.expr("try_parse_url(url, 'AUTHORITY')").alias("host"), body.alias("body")).distinct()
    return crawling.allowed(pages.select("page_id", "url"), crawling.robots_rules(files, "skarn")).select("page_id")


@query(" SELECT page_id FROM pages WHERE page_id % 4 > 0 AND page_id % 3 > 0")
def pages_admitted(spark, sf_dir):
    fetched = web_pages(spark, sf_dir).withColumns({"status": F.when(F.col("page_id") % 4 > 0, 200).otherwise(404), "content_type": F.when(F.col("page_id") % 3 > 0, "text/HTML; charset=utf-8").otherwise("image/png")})
    return crawling.admitted(fetched).select("page_id")


@query(", e AS (SELECT 'https://h.example/' || page_id AS url, page_id FROM pages), lv(page_id, level) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT lv.page_id * 2 + k, level + 1 FROM lv, (VALUES (1), (2)) v(k) WHERE lv.page_id * 2 + k IN (SELECT page_id FROM e)) SELECT 'https://h.example/' || page_id AS url, level FROM lv")
def crawl_levels(spark, sf_dir):
    """Breadth-first levels over a binary tree of links."""
    at = F.col("page_id")
    return crawling.crawl(_link_tree(spark, sf_dir), "https://h.example/0", max_pages=1_000_000_000)[0]


def _link_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("page_id")
    link = F.concat(F.lit('<a href="'), (at * 2 + 1).cast("string"), F.lit('">l</a><a href=/'), (at * 2 + 2).cast("string"), F.lit("#x>r</a>"), F.lit("<p>" + "some text " * 12 + "</p>"))
    return web_pages(spark, sf_dir).select(at, F.concat(F.lit("https://h.example/"), at.cast("string")).alias("url"), link.alias("html"))


@query(""", e AS (SELECT page_id, CASE WHEN page_id % 11 = 5 THEN 403 WHEN page_id % 13 = 6 THEN 404 ELSE 200 END AS status, page_id % 17 = 7 AS bare FROM pages
), lv(page_id, status, saved) AS (SELECT page_id, status, status = 200 AND NOT bare FROM e WHERE page_id = 0 UNION ALL
  SELECT e.page_id, e.status, e.status = 200 AND NOT bare FROM lv, (VALUES (1), (2)) v(k), e WHERE saved AND e.page_id = lv.page_id * 2 + k
) SELECT 'https://h.example/' || page_id AS url, CAST(status AS INTEGER) AS status FROM lv""")
def crawl_fetch_log(spark, sf_dir):
    """Every visit of a crawl: pages that are forbidden, missing or too short are logged, but not followed."""
    at = F.col("page_id")
    tree = _link_tree(spark, sf_dir).withColumn("status", F.when(at % 13 == 6, 404).otherwise(200))
    tree = tree.withColumn("html", F.when(at % 17 == 7, "<p>too short</p>").otherwise(F.col("html")))
    rules = tree.filter(at % 11 == 5).select(F.lit("h.example").alias("host"), F.concat(F.lit("/"), at.cast("string")).alias("prefix"), F.lit(False).alias("allow"), F.lit(1).alias("ord"))
    # a longer path that begins with a forbidden one is let by a rule before it
    rules = rules.union(tree.filter(at % 11 != 5).select(F.lit("h.example"), F.concat(F.lit("/"), at.cast("string")), F.lit(True), (-F.length(at.cast("string"))).alias("ord")))
    rules = rules.withColumn("ord", -F.length("prefix"))
    return crawling.crawl(tree, "https://h.example/0", max_pages=1_000_000_000, rules=rules)[1]


_UPSERT_SQL = """, old AS (SELECT page_id, url, 'old' AS title, TIMESTAMP '2024-01-01' AS crawled_at FROM pages WHERE page_id % 3 > 0
), new AS (SELECT NULL AS page_id, url, 'new' AS title, TIMESTAMP '2024-02-01' AS crawled_at FROM pages WHERE page_id % 3 < 2)"""


@query(_UPSERT_SQL + " SELECT url, min(page_id) IS NOT NULL AS known, min(page_id) AS page_id, arg_max(title, crawled_at) AS title FROM (FROM old UNION ALL FROM new) GROUP BY url")
def upsert_latest(spark, sf_dir):
    pages = web_pages(spark, sf_dir)
    old = pages.filter("page_id % 3 > 0").select("page_id", "url", F.lit("old").alias("title"), F.lit("2024-01-01").cast("timestamp").alias("crawled_at"))
    new = pages.filter("page_id % 3 < 2").select("url", F.lit("new").alias("title"), F.lit("2024-02-01").cast("timestamp").alias("crawled_at"))
    out = crawling.upsert(old, new, key="url").join(old.select("url", F.lit(True).alias("known")).distinct(), "url", "left")
    # ids of new urls are hashes
    return out.select("url", F.coalesce("known", F.lit(False)).alias("known"), F.when(F.col("known"), F.col("page_id")).alias("page_id"), "title")


@query(" SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def dedupe_edges(spark, sf_dir):
    o, li = tables.read(spark, sf_dir, "orders"), tables.read(spark, sf_dir, "lineitem")
    edges = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"))
    old = edges.filter("src % 2 = 0").distinct()
    return crawling.insert_ignore(old, edges, ["src", "dst"])


@query(" SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def anti_visited(spark, sf_dir):
    pages = web_pages(spark, sf_dir)
    return crawling.frontier(pages.select(F.col("url").alias("link")), pages.filter("page_id % 3 = 0"))


@query(", chat AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM conversations) SELECT term, count(DISTINCT conv_id * 1000 + turn) AS doc_freq FROM chat WHERE term NOT IN (" + _STOP + ") GROUP BY term")
def conversation_terms(spark, sf_dir):
    chat = tables.read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), F.lit("").alias("title"), F.col("text").alias("body_text"))
    return indexing.postings(chat).groupBy("term").agg(F.count("*").alias("doc_freq"))
