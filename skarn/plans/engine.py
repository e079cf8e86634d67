"""Search engine facade: builds and stores an index, and answers as dictionaries.

This is the only module that brings results to the driver, one result page at a time.
"""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.words import query_tokens, suggestion_prefix
from ..operators import crawling, graph, indexing, searching, spelling, suggesting
from ..sources.tables import Store

PAGE_LIMIT, DEFAULT_LIMIT = 20, 10


def paging(page, limit) -> tuple[int, int]:
    """Page from 1; limit from 1 to 20, ten where it is missing, 0 or no number."""

    def whole(value) -> int:
        digits = str(value if value is not None else "").strip()
        sign, rest = digits[:1] if digits[:1] in "+-" else "", digits.lstrip("+-")
        head = "".join(c for i, c in enumerate(rest) if rest[: i + 1].isdigit())
        return int(sign + head) if head else 0

    return max(1, whole(page) or 1), min(PAGE_LIMIT, max(1, whole(limit) or DEFAULT_LIMIT))


def page_numbers(total: int, limit: int, page: int) -> list[int]:
    """Page numbers to offer: two to each side of the current one, none if there is one page."""
    last = -(-total // limit)
    return [p for p in range(max(1, page - 2), min(last, page + 2) + 1)] if last > 1 else []


class SearchEngine:
    """profile: classic (matched coverage, no correction) or positional (phrases, nearness, correction)."""

    def __init__(self, spark: SparkSession, path: str, profile: str = "classic"):
        if profile not in indexing.STRATEGY:
            raise ValueError(f"unknown profile {profile!r}")
        self.spark, self.store, self.profile = spark, Store(spark, path), profile
        self.started, self._config, self._index = time.time(), None, None

    def build(self, pages: DataFrame, edges: DataFrame | None = None) -> dict:
        """Builds the index of pages; edges (src, dst) are page ids, by default what the crawl stored."""
        pages = self.store.overwrite("pages", pages.repartitionByRange("page_id").sortWithinPartitions("page_id"))
        if edges is None:
            edges = graph.resolve_edges(self.store.table("crawl_edges"), pages)
        self._config, self._index = None, None
        found = searching.build_index(pages, edges, keep=lambda df, name: self.store.overwrite(name, df))
        return {"pages": pages.count(), "terms": found.terms.count(), "postings": found.postings.count()}

    def crawl(self, fetched: DataFrame, seed: str, max_pages: int = 200, refresh: bool = False, rules: DataFrame | None = None) -> dict:
        """Crawls over fetched rows (url, html, crawled_at, and status and content_type if there are any).

        Stores pages and edges of what it saves, and adds every visit to the fetch log.
        """
        pages = self.store.table("pages")
        levels, log = crawling.crawl(fetched, seed, max_pages, refresh, pages, rules)
        rows = fetched.join(levels.select("url"), "url", "left_semi")
        self.store.overwrite("pages", crawling.upsert(pages, crawling.extract_pages(rows, keep=("crawled_at",))))
        edges = crawling.link_edges(crawling.extract_links(rows))
        self.store.overwrite("crawl_edges", crawling.insert_ignore(self.store.table("crawl_edges"), edges, ["source_url_hash", "target_url_hash"]))
        log = log.select(F.xxhash64("url", F.current_timestamp()).alias("id"), F.substring("url", 1, markup.URL_CHARS).alias("url"), "status", F.current_timestamp().alias("crawled_at"))
        return {"saved": levels.count(), "visited": self.store.append("crawl_log", log).count()}

    @property
    def index(self) -> searching.Index:
        if self._index is None:
            t = self.store.table
            self._index = searching.Index(t("pages"), t("terms"), t("postings"), t("page_rank"), t("index_meta"), t("grams"))
        return self._index

    @property
    def config(self) -> indexing.RankingConfig:
        if self._config is None:
            self._config = indexing.load_config(self.index.meta, self.profile)
        return self._config

    def search(self, q: str | None, page=1, limit=DEFAULT_LIMIT) -> dict:
        began = time.time()
        query = (q or "").strip()
        page, limit = paging(page, limit)
        asked = query_tokens(query)
        c, positional = self.config, self.profile == "positional"
        params = {k: v for k, v in asdict(c).items() if k != "strategy" and (positional or k not in ("phrase_weight", "proximity_weight"))}
        diagnostics: dict = {"strategy": c.strategy, "params": params, "requested_terms": asked, "matched_terms": []}
        tokens = asked
        out = {"query": query, "total": 0, "page": page, "limit": limit, "diagnostics": diagnostics, "results": []}
        if positional:
            fixed = spelling.correct_tokens(spelling.token_rows(self.spark, asked), self.index.terms, self.index.grams).orderBy("ix").collect() if asked else []
            tokens = [r.term for r in fixed]
            changes = [{"from": r.token, "to": r.term, "distance": r.distance} for r in fixed if r.distance is not None]
            diagnostics |= {"search_terms": tokens, "correction_applied": bool(changes), "corrected_query": " ".join(tokens) if changes else None, "corrections": changes, "unmatched_terms": [], "candidate_pool": 0}
            out["search_query"] = " ".join(tokens) or query
        if query and tokens:
            known = {r.term for r in searching.matched_terms(self.index, tokens).select("term").collect()}
            if positional:
                diagnostics |= {"matched_terms": [t for t in tokens if t in known], "unmatched_terms": [t for t in tokens if t not in known]}
            else:
                diagnostics["matched_terms"] = [t for t in dict.fromkeys(tokens) if t in known]
            if known:
                self._ranked(out, tokens, asked, page, limit)
        return out | {"took_ms": round(1000 * (time.time() - began))}

    def _ranked(self, out: dict, tokens: list[str], asked: list[str], page: int, limit: int) -> None:
        positional = self.profile == "positional"
        score = searching.score_positional if positional else searching.score_classic
        pool = Observation()  # counted on the way: one job scores, counts and takes the page
        scored = score(self.index, tokens, self.config).observe(pool, F.count("*").alias("total"), F.sum("term_hits").alias("postings"))
        rows = searching.page_of(scored, page, limit).collect()
        out["total"] = pool.get["total"]
        if positional:
            out["diagnostics"]["candidate_pool"] = pool.get["postings"] or 0
        top = self.spark.createDataFrame(rows, scored.schema)
        places = 4 if positional else 3
        for r in searching.enrich(self.index, top, tokens if positional else asked).collect():
            signals = {"bm25": round(r.bm25, 4), "page_rank": round(r.page_rank, 4), "coverage": round(r.coverage, places)}
            if positional:
                signals |= {"phrase": round(r.phrase, 4), "proximity": round(r.proximity, 4)}
            out["results"].append({"id": r.page_id, "url": r.url, "title": r.title, "snippet": r.snippet, "score": round(r.final_score, 4), "term_hits": r.term_hits, "coverage": round(r.coverage, places), "signals": signals})

    def suggest(self, q: str | None) -> list[str]:
        prefix = suggestion_prefix(q, self.profile == "positional")
        if len(prefix) < 2:
            return []
        find = suggesting.suggest_positional if self.profile == "positional" else suggesting.suggest_classic
        return [r.term for r in find(self.index.terms, prefix).collect()]

    def stats(self) -> dict:
        i = self.index
        return {"pages": i.pages.count(), "terms": i.terms.count(), "postings": i.postings.count(), "ranking_strategy": self.config.strategy, "avg_doc_len": self.config.avg_doc_len}

    def metrics(self) -> dict:
        crawl = crawling.crawl_metrics(self.store.table("crawl_log")).first()
        up = {"uptime_s": round(time.time() - self.started, 1)}
        counts = {"crawl_attempts": crawl.crawl_attempts, "crawl_success": crawl.crawl_success}
        if self.profile == "positional":
            average = self.index.page_rank.agg(F.avg("score")).first()[0]
            return counts | {"last_crawled_at": crawl.last_crawled_at, "avg_page_rank": average or 0.0} | up
        means = self.index.page_rank.agg(F.round(F.avg("word_count"), 2).alias("l"), F.round(F.avg("score"), 6).alias("r")).first()
        pages = self.index.pages
        last = pages.agg(F.max("crawled_at")).first()[0] if "crawled_at" in pages.columns else None
        counts |= {k: v for k, v in self.stats().items() if k in ("pages", "terms", "postings")}
        return counts | {"avg_doc_len": means.l, "avg_page_rank": means.r, "last_crawled_at": last, "ranking": asdict(self.config)} | up

    def health(self) -> dict:
        began = time.time()
        self.spark.range(1).count()
        return {"status": "ok", "db": "up", "uptime_s": round(time.time() - self.started, 1), "latency_ms": round(1000 * (time.time() - began))}
