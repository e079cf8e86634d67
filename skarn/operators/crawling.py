"""Crawl data: extraction, upserts, edges, frontier and metrics. Fetching itself is not part of the engine."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup
from ..plans.lineage import cut

LEAST_TEXT = 100


def admitted(fetched: DataFrame) -> DataFrame:
    """Fetched rows (status, content_type) that may become pages."""
    return fetched.filter((F.col("status") == 200) & F.contains(F.lower("content_type"), F.lit("text/html")))


def extract_pages(fetched: DataFrame, least_text: int = LEAST_TEXT, keep: tuple[str, ...] = ()) -> DataFrame:
    """url, url_hash, title, body_text (and keep) of fetched (url, html) whose text is long enough."""
    text = markup.html_text(F.col("html"))
    found = fetched.select(*keep, "url", F.substring(markup.html_title(F.col("html"), F.col("url")), 1, markup.TITLE_CHARS).alias("title"), text.alias("body_text"))
    return found.filter(F.length("body_text") >= least_text).select(F.substring("url", 1, markup.URL_CHARS).alias("url"), markup.url_hash(F.col("url")).alias("url_hash"), "title", "body_text", *keep)


def extract_links(fetched: DataFrame) -> DataFrame:
    """url, link: distinct same-host links of each page, without fragments."""
    hrefs = fetched.select("url", F.explode(F.array_distinct(markup.html_hrefs(F.col("html")))).alias("href"))
    return hrefs.select("url", markup.resolve_url("url", "href").alias("link")).filter("link IS NOT NULL").distinct()


def link_edges(links: DataFrame) -> DataFrame:
    return links.select(markup.url_hash(F.col("url")).alias("source_url_hash"), markup.url_hash(F.col("link")).alias("target_url_hash")).distinct()


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """host, prefix, allow, ord: the rules for the agent of robots files (host, body), in their order.

    A file without any rule for the agent is a row of a null prefix; hosts without a readable file have none.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for host, body in zip(batch.column("host").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if body is None:
                    continue
                parser = RobotFileParser()
                parser.parse(body.splitlines())
                entry = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
                lines = entry.rulelines if entry else []
                out += [(host, r.path, r.allowance, i) for i, r in enumerate(lines)] or [(host, None, True, 0)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "prefix", "allow", "ord"])

    return files.select("host", "body").mapInArrow(run, "host string, prefix string, allow boolean, ord int")


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls and may_fetch: the first rule whose prefix the path and query begin with decides, without one it may.

    Rules are (host, prefix) and optionally allow and ord; without these columns they disallow. Hosts
    without any row of rules are denied. A readable robots file without rules is a row of a null prefix.
    """
    for name, value in (("allow", F.lit(False)), ("ord", F.lit(0))):
        if name not in rules.columns:
            rules = rules.withColumn(name, value)
    plain = urls.select("url").distinct()
    query = F.expr("try_parse_url(url, 'QUERY')")
    path = F.concat(F.coalesce(F.nullif(F.expr("try_parse_url(url, 'PATH')"), F.lit("")), F.lit("/")), F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(""))
    parts = plain.withColumn("host", F.expr("try_parse_url(url, 'AUTHORITY')")).withColumn("path", path)
    # a path's beginnings of the lengths that the host's rules have meet the rules by equality, not every rule of the host
    said = F.col("prefix").isNotNull() & ((F.col("prefix") != "") | F.col("allow"))
    hosts = rules.groupBy("host").agg(F.collect_set(F.when(said, F.length("prefix"))).alias("lengths"))
    known = parts.join(hosts, "host").select("url", "host", "path", F.explode_outer(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    first = rules.filter(said).groupBy("host", "prefix").agg(F.min(F.struct("ord", "allow")).alias("rule"))
    meets = known.select("url", "host", F.substring("path", F.lit(1), F.col("n")).alias("prefix")).join(first, ["host", "prefix"], "left")
    verdict = meets.groupBy("url").agg(F.min("rule").alias("first"))
    return urls.join(verdict.select("url", F.coalesce("first.allow", F.lit(True)).alias("may_fetch")), "url", "left").withColumn("may_fetch", F.coalesce("may_fetch", F.lit(False))).select(*urls.columns, "may_fetch")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs that the rules let a crawler fetch."""
    return judged(urls, rules).filter("may_fetch").drop("may_fetch")


def upsert(old: DataFrame, new: DataFrame, key: str = "url_hash", at: str = "crawled_at", id_col: str = "page_id") -> DataFrame:
    """The latest row of each key; a key keeps the id it had first. Ids of new keys are hashes of the key."""
    fresh = new.withColumn(id_col, F.lit(None).cast(old.schema[id_col].dataType)).select(*old.columns)
    every = old.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key)
    ranked = every.withColumn("__r", F.row_number().over(w.orderBy(F.desc(at), F.desc("__new")))).withColumn("__id", F.min(id_col).over(w))
    return ranked.filter("__r = 1").withColumn(id_col, F.coalesce("__id", F.xxhash64(key))).select(*old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys it lacks, each key once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def frontier(links: DataFrame, visited: DataFrame) -> DataFrame:
    """url: targets not visited yet, each once."""
    return links.select(F.col("link").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")


def crawl(fetched: DataFrame, seed: str, max_pages: int = 200, refresh: bool = False, existing: DataFrame | None = None, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A breadth-first crawl over what was fetched: saved pages (url, level), and the fetch log (url, status).

    fetched has url and html, and may have status and content_type. Only pages that are admitted and
    hold enough text are saved, count towards max_pages and have their links followed. Every visit is
    logged: 403 where the rules forbid it, else the fetch's status. Existing pages are neither fetched
    nor followed unless refresh is set. Levels are sets; inside one, urls order.
    """
    for name, value in (("status", F.lit(200)), ("content_type", F.lit("text/html"))):
        if name not in fetched.columns:
            fetched = fetched.withColumn(name, value)
    if existing is not None and not refresh:
        fetched = fetched.join(existing.select("url"), "url", "left_anti")
    good = extract_pages(admitted(fetched)).select("url").withColumn("saved", F.lit(True))
    visits = fetched.select("url", "status").join(good, "url", "left").withColumn("saved", F.coalesce("saved", F.lit(False)))
    if rules is not None:
        may = F.col("may_fetch")
        visits = judged(visits, rules).select("url", F.when(may, F.col("status")).otherwise(403).alias("status"), (may & F.col("saved")).alias("saved"))
    visits, links = cut(visits, "visits"), cut(extract_links(fetched), "links")

    def wave_of(urls: DataFrame, level: int) -> DataFrame:
        return cut(visits.join(urls, "url", "left_semi").withColumn("level", F.lit(level)), "wave")

    wave, level = wave_of(visits.sparkSession.createDataFrame([(seed,)], "url string"), 0), 0
    seen, saved = wave, wave.filter("saved").count()
    while saved < max_pages and not wave.isEmpty():
        level += 1
        new = links.join(wave.filter("saved").select("url"), "url", "left_semi").select(F.col("link").alias("url")).distinct()
        wave = wave_of(new.join(seen.select("url"), "url", "left_anti"), level)
        found, room = wave.filter("saved").count(), max_pages - saved
        if found > room:  # the crawl ends with the page that fills it
            last = wave.filter("saved").orderBy("url").limit(room).agg(F.max("url")).first()[0]
            wave = cut(wave.filter(F.col("url") <= last), "wave")
        saved += min(found, room)
        seen = cut(seen.unionByName(wave), "seen")
    return seen.filter("saved").select("url", "level"), seen.select("url", F.col("status").cast("int").alias("status"))


def crawl_metrics(log: DataFrame) -> DataFrame:
    """One row: attempts, successes and the last crawl of a fetch log."""
    return log.agg(F.count("*").alias("crawl_attempts"), F.count_if(F.col("status") == 200).alias("crawl_success"), F.max("crawled_at").alias("last_crawled_at"))
