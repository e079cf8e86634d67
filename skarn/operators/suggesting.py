"""Prefix suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUGGESTIONS, PER_PREFIX = 8, 12


def suggest_classic(terms: DataFrame, prefix: str) -> DataFrame:
    """Up to eight terms of more than one document that begin with the prefix, most frequent first."""
    found = terms.filter(F.col("term").startswith(prefix) & (F.col("doc_freq") > 1))
    return found.orderBy(F.desc("doc_freq"), "term").limit(SUGGESTIONS).select("term", "doc_freq")


def suggest_positional(terms: DataFrame, prefix: str) -> DataFrame:
    """Up to eight terms that begin with a prefix of at least two letters, most frequent first."""
    found = terms.filter(F.col("term").startswith(prefix) if len(prefix) >= 2 else F.lit(False))
    return found.orderBy(F.desc("doc_freq"), "term").limit(SUGGESTIONS).select("term", "doc_freq")


def prefix_table(terms: DataFrame, most: int = PER_PREFIX) -> DataFrame:
    """prefix, rank, term, doc_freq: the most frequent terms of each prefix.

    Prefixes of one letter hold a large part of all terms, so terms are cut to the best in slices of
    each prefix first.
    """
    rows = terms.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("prefix"), "term", "doc_freq")
    order = (F.desc("doc_freq"), F.col("term"))
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(16)))
    best = sliced.withColumn("r", F.row_number().over(Window.partitionBy("prefix", "slice").orderBy(*order))).filter(F.col("r") <= most)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(*order))).filter(F.col("rank") <= most).select("prefix", "rank", "term", "doc_freq")


def query_history(queries: DataFrame, most: int = 8) -> DataFrame:
    """The latest distinct queries, last used first."""
    return queries.groupBy("query").agg(F.max("ts").alias("last_used")).orderBy(F.desc("last_used"), "query").limit(most)
