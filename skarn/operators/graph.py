"""Link graph: edge resolution, degrees and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

# Fixed values.
DAMPING, ITERATIONS = 0.85, 20
#: Ranks whose spread is below this are taken as equal.
LEAST_SPREAD = 1e-12


def resolve_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """src, dst: page ids of edges given by URL hashes, self links left out."""
    ids = pages.select("page_id", "url_hash")
    source = ids.select(F.col("url_hash").alias("source_url_hash"), F.col("page_id").alias("src"))
    target = ids.select(F.col("url_hash").alias("target_url_hash"), F.col("page_id").alias("dst"))
    return edges.join(source, "source_url_hash").join(target, "target_url_hash").filter("src <> dst").select("src", "dst")


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges without self links, both ends of which are nodes."""
    inside = edges.filter("src <> dst").select("src", "dst").distinct()
    for end in ("src", "dst"):
        inside = inside.join(nodes.select(F.col("page_id").alias(end)), end, "left_semi")
    return inside.select("src", "dst")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_id, in_links, out_links of every node."""
    clean = clean_edges(edges, nodes)
    out = clean.groupBy(F.col("src").alias("page_id")).agg(F.count("*").alias("out_links"))
    into = clean.groupBy(F.col("dst").alias("page_id")).agg(F.count("*").alias("in_links"))
    joined = nodes.select("page_id").distinct().join(into, "page_id", "left").join(out, "page_id", "left")
    return joined.select("page_id", F.coalesce("in_links", F.lit(0)).alias("in_links"), F.coalesce("out_links", F.lit(0)).alias("out_links"))


def raw_ranks(edges: DataFrame, nodes: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """page_id, rank, in_links, out_links after the given number of steps; ranks sum to 1.

    The mass of nodes without links and what links carry come from one aggregate of each step's
    table, which is written out, so that plans do not grow.
    """
    known = cut(degrees(edges, nodes), "degrees")
    n = known.count()
    links = cut(clean_edges(edges, nodes), "edges")
    ranks = known.withColumn("rank", F.lit(1.0 / max(1, n)))
    for step in range(iterations):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("out_links") == 0, F.col("rank"))), F.lit(0.0)).alias("loose"))
        shares = ranks.filter("out_links > 0").select(F.col("page_id").alias("src"), (F.col("rank") / F.col("out_links")).alias("share"))
        carried = links.join(shares, "src").groupBy(F.col("dst").alias("page_id")).agg(F.sum("share").alias("carried"))
        moved = ranks.drop("rank").join(carried, "page_id", "left").crossJoin(F.broadcast(loose))  # one row
        rank = (1 - damping) / max(1, n) + damping * F.col("loose") / max(1, n) + damping * F.coalesce("carried", F.lit(0.0))
        ranks = cut(moved.select("page_id", "in_links", "out_links", rank.alias("rank")), f"ranks-{step}")
    return ranks


def normalised(ranks: DataFrame) -> DataFrame:
    """Adds score, the rank between 0 (least) and 1 (greatest); 0 for all where ranks are equal."""
    ends = ranks.agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    spread = F.col("high") - F.col("low")
    score = F.when(spread > LEAST_SPREAD, (F.col("rank") - F.col("low")) / spread).otherwise(0.0)
    return ranks.crossJoin(F.broadcast(ends)).withColumn("score", score).drop("low", "high")  # one row


def page_rank(edges: DataFrame, nodes: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """page_id, rank, score, in_links, out_links."""
    return normalised(raw_ranks(edges, nodes, iterations))
