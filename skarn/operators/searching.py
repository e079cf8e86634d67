"""Ranked search over an index: the classic and the positional profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, scoring
from ..plans.lineage import cut
from . import graph, indexing, spelling
from .indexing import RankingConfig

#: Text of the pages whose postings are sorted in one part of the index.
PART_BYTES = 24_000_000


@dataclass(frozen=True)
class Index:
    pages: DataFrame
    terms: DataFrame
    postings: DataFrame
    page_rank: DataFrame
    meta: DataFrame
    grams: DataFrame  # of the terms, for spelling

    @property
    def spark(self) -> SparkSession:
        return self.pages.sparkSession


def build_index(pages: DataFrame, edges: DataFrame | None = None, keep=cut) -> Index:
    """Builds all index tables. keep stores a table and returns it: cut, or a store's overwrite.

    An empty corpus gives empty tables and no settings, so readers fall back on the defaults.
    """
    spark = pages.sparkSession
    count, size = pages.agg(F.count("*"), F.sum(F.octet_length("body_text"))).first()
    # each part holds the postings of its own pages, sorted by term, and is small enough to sort in memory
    parts = max(spark.sparkContext.defaultParallelism, -(-(size or 0) // PART_BYTES))
    posted = keep(indexing.postings(pages, parts).sortWithinPartitions("term", "page_id"), "postings")
    terms = keep(indexing.terms(posted, count).repartitionByRange("term").sortWithinPartitions("term"), "terms")
    lengths = indexing.doc_lengths(pages, posted)
    ranks = graph.page_rank(edges, pages) if edges is not None and count else None
    stats = keep(indexing.doc_stats(lengths, ranks), "page_rank")
    if count:
        average = stats.agg(F.avg("word_count")).first()[0]
        meta = keep(indexing.index_meta(count, terms.count(), average, spark), "index_meta")
    else:
        meta = spark.createDataFrame([], "key_name string, value_num double, value_text string, updated_at timestamp")
    # terms are shuffled, not their grams; as many parts as postings have keep each sort in memory
    grams = keep(spelling.gram_table(terms.repartition(parts, "term")).sortWithinPartitions("gram", "term"), "grams")
    return Index(pages, terms, posted, stats, meta, grams)


def matched_terms(index: Index, tokens: list[str]) -> DataFrame:
    """Rows of terms that the query names; at most one a token."""
    return index.terms.filter(F.col("term").isin(*set(tokens)) if tokens else F.lit(False))


def split_tokens(index: Index, tokens: DataFrame) -> DataFrame:
    """ix, token, matched: query tokens in order, repeats kept, and whether the index has them."""
    known = index.terms.select(F.col("term").alias("token"), F.lit(True).alias("known"))
    found = known.join(F.broadcast(tokens.select("token").distinct()), "token", "left_semi")  # the query's tokens
    return tokens.join(F.broadcast(found), "token", "left").select("ix", "token", F.coalesce("known", F.lit(False)).alias("matched"))


def candidates(index: Index, tokens: list[str]) -> DataFrame:
    """Postings of the query's terms with idf and document statistics."""
    wanted = F.broadcast(matched_terms(index, tokens))  # at most one row a token
    posted = index.postings.filter(F.col("term").isin(*set(tokens)) if tokens else F.lit(False))
    stats = index.page_rank.select("page_id", F.col("score").alias("page_rank"), "word_count")
    return posted.join(wanted, "term").join(stats, "page_id", "left").withColumn("page_rank", F.coalesce("page_rank", F.lit(0.0)))


def total_hits(index: Index, tokens: list[str]) -> DataFrame:
    """One row: how many pages hold any of the terms."""
    posted = index.postings.filter(F.col("term").isin(*set(tokens)) if tokens else F.lit(False))
    return posted.agg(F.countDistinct("page_id").alias("total"))


def score_classic(index: Index, tokens: list[str], config: RankingConfig, pages: DataFrame | None = None) -> DataFrame:
    """page_id, bm25, term_hits, coverage, page_rank, final_score.

    Coverage is taken of the matched distinct terms; a missing document length counts as 0.
    """
    rows = candidates(index, tokens)
    if pages is not None:
        rows = rows.join(pages.select("page_id"), "page_id", "left_semi")
    tf = scoring.weighted_tf(F.col("tf_body"), F.col("tf_title"), config.title_boost)
    part = scoring.bm25(F.col("idf"), tf, F.coalesce("word_count", F.lit(0)), config.avg_doc_len, config.k1, config.b)
    scored = rows.groupBy("page_id").agg(F.sum(part).alias("bm25"), F.count("*").alias("term_hits"), F.max("page_rank").alias("page_rank"))
    matched = matched_terms(index, tokens).agg(F.count("*").alias("matched"))  # one row
    scored = scored.crossJoin(F.broadcast(matched)).withColumn("coverage", F.col("term_hits") / F.col("matched")).drop("matched")
    return scored.withColumn("final_score", F.col("bm25") + config.page_rank_weight * F.col("page_rank") + config.coverage_weight * F.col("coverage"))


def positions_by_token(rows: DataFrame, tokens: list[str]) -> DataFrame:
    """page_id, and for each distinct token its positions in both fields (null if absent)."""
    distinct = list(dict.fromkeys(tokens))
    columns = []
    for i, t in enumerate(distinct):
        own = F.when(F.col("term") == t, F.col("positions"))
        columns += [F.max(own)["title"].alias(f"t{i}"), F.max(own)["body"].alias(f"b{i}")]
    return rows.groupBy("page_id").agg(*columns)


def signal_columns(tokens: list[str]):
    at = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    return scoring.positional_signals([F.col(f"t{at[t]}") for t in tokens], [F.col(f"b{at[t]}") for t in tokens])


def score_positional(index: Index, tokens: list[str], config: RankingConfig) -> DataFrame:
    """page_id, bm25, term_hits, coverage, page_rank, phrase, proximity, final_score (to four places).

    Coverage is taken of all query tokens; a missing or zero document length counts as the average.
    """
    rows = candidates(index, tokens)
    tf = scoring.weighted_tf(F.col("tf_body"), F.col("tf_title"), config.title_boost)
    length = F.coalesce(F.nullif(F.col("word_count").cast("double"), F.lit(0.0)), F.lit(config.avg_doc_len))
    part = scoring.bm25(F.col("idf"), tf, length, config.avg_doc_len, config.k1, config.b)
    distinct = list(dict.fromkeys(tokens))
    lists = []
    for i, t in enumerate(distinct):
        own = F.when(F.col("term") == t, F.col("positions"))
        lists += [F.max(own)["title"].alias(f"t{i}"), F.max(own)["body"].alias(f"b{i}")]
    hits = F.count_if(F.col("freq_title") + F.col("freq_body") > 0)
    grouped = rows.groupBy("page_id").agg(F.sum(part).alias("bm25"), hits.alias("term_hits"), F.max("page_rank").alias("page_rank"), *lists)
    phrase, proximity = signal_columns(tokens) if tokens else (F.lit(0.0), F.lit(0.0))
    scored = grouped.select("page_id", "bm25", "term_hits", (F.col("term_hits") / F.lit(float(max(1, len(tokens))))).alias("coverage"), "page_rank", phrase.alias("phrase"), proximity.alias("proximity"))
    final = F.col("bm25") + config.page_rank_weight * F.col("page_rank") + config.coverage_weight * F.col("coverage") + config.phrase_weight * F.col("phrase") + config.proximity_weight * F.col("proximity")
    return scored.withColumn("final_score", F.round(final, 4))


def page_of(scored: DataFrame, page: int, limit: int) -> DataFrame:
    """The rows of one result page, best first, ties by page_id."""
    return scored.orderBy(F.desc("final_score"), "page_id").offset((page - 1) * limit).limit(limit)


def enrich(index: Index, top: DataFrame, highlight: list[str]) -> DataFrame:
    """Adds url, title and snippet to one result page; of pages, sorted by id, only the rows' own are read."""
    rows = top.collect()  # one result page
    ids = [r.page_id for r in rows]
    top = index.spark.createDataFrame(rows, top.schema)
    shown = index.pages.filter(F.col("page_id").isin(*ids) if ids else F.lit(False)).join(F.broadcast(top), "page_id")
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("url"), F.lit(""))
    return shown.select(*top.columns, F.coalesce("url", F.lit("")).alias("url"), title.alias("title"), markup.snippet(F.col("body_text"), highlight).alias("snippet")).orderBy(F.desc("final_score"), "page_id")
