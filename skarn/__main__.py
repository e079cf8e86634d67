"""Command lines: crawl over fetched pages, build the index, search.

    python -m skarn crawl --store DIR --fetched FILES --seed URL [--max 200] [--refresh-existing] [--robots FILES]
    python -m skarn index --store DIR
    python -m skarn search --store DIR [--profile positional] [--page 1] [--limit 10] QUERY

Fetched files are Parquet (url, html, crawled_at, and status and content_type if there are any), robots
files too (host, body).
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators import crawling
from .plans.engine import SearchEngine


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skarn")
    commands = top.add_subparsers(dest="command", required=True)
    crawl, index, search = (commands.add_parser(name) for name in ("crawl", "index", "search"))
    for command in (crawl, index, search):
        command.add_argument("--store", required=True, help="folder of the tables")
        command.add_argument("--profile", default="classic", choices=("classic", "positional"))
    crawl.add_argument("--fetched", required=True)
    crawl.add_argument("--seed", required=True)
    crawl.add_argument("--max", type=int, default=200)
    crawl.add_argument("--refresh-existing", action="store_true")
    crawl.add_argument("--robots")
    crawl.add_argument("--agent", default="*")
    search.add_argument("query")
    search.add_argument("--page", default=1)
    search.add_argument("--limit", default=10)
    return top


def main(arguments: Sequence[str] | None = None) -> dict:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("skarn").getOrCreate()
    engine = SearchEngine(spark, args.store, args.profile)
    if args.command == "crawl":
        rules = crawling.robots_rules(spark.read.parquet(args.robots), args.agent) if args.robots else None
        out = engine.crawl(spark.read.parquet(args.fetched), args.seed, args.max, args.refresh_existing, rules)
    elif args.command == "index":
        out = engine.build(engine.store.table("pages"))
    else:
        out = engine.search(args.query, args.page, args.limit)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
