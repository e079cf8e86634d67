"""Structured Streaming: crawl output into the page table, and fetch counts by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import crawling
from ..sources.tables import Store


def ingest_pages(fetched: DataFrame, store: Store, checkpoint: str):
    """Upserts a stream of fetched rows (url, html, crawled_at) into pages and adds new links to crawl_edges.

    Both writes replace by key, so a batch that is run again changes nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        pages = crawling.extract_pages(rows, keep=("crawled_at",))  # each version of a page with its own time
        store.overwrite("pages", crawling.upsert(store.table("pages"), pages))
        edges = crawling.link_edges(crawling.extract_links(rows))
        store.overwrite("crawl_edges", crawling.insert_ignore(store.table("crawl_edges"), edges, ["source_url_hash", "target_url_hash"]))
        rows.unpersist()

    return fetched.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_fetches(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """hour, status, n of a stream (or table) of fetches (crawled_at, status)."""
    if log.isStreaming:
        log = log.withWatermark("crawled_at", late)
    counts = log.groupBy(F.window("crawled_at", "1 hour").alias("w"), "status").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("hour"), "status", "n")
