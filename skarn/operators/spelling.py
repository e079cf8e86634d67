"""Spelling correction of query terms against the index's lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spelling

# Weights of a candidate's score, and the least score that corrects.
OVERLAP, SAME_START, FREQUENCY, DISTANCE, LEAST = 2.2, 0.25, 0.08, 0.95, 0.15


def gram_table(terms: DataFrame) -> DataFrame:
    """gram, term, doc_freq: the lexicon by gram. An index keeps it sorted, so that a query reads its grams only."""
    return terms.select(F.explode(spelling.grams(F.col("term"))).alias("gram"), "term", "doc_freq")


def token_rows(spark: SparkSession, tokens: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(tokens)), "ix int, token string")


def unknown_tokens(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct tokens of three letters or more that the lexicon lacks."""
    asked = tokens.select("token").distinct().filter(F.length("token") >= 3)
    wanted = [r.token for r in asked.collect()]  # of the query
    known = terms.filter(F.col("term").isin(*wanted) if wanted else F.lit(False))
    return asked.join(F.broadcast(known.select(F.col("term").alias("token"))), "token", "left_anti")


def gram_overlap(unknown: DataFrame, grams: DataFrame) -> DataFrame:
    """token, cand, doc_freq, overlap (shared grams), first_gram, keys (the token's grams)."""
    wanted = [r.gram for r in unknown.select(F.explode(spelling.grams(F.col("token"))).alias("gram")).distinct().collect()]  # of the query's tokens
    grams = grams.filter(F.col("gram").isin(*wanted) if wanted else F.lit(False))
    asked = unknown.select("token", F.posexplode(spelling.grams(F.col("token"))).alias("gram_ix", "gram"), F.size(spelling.grams(F.col("token"))).alias("keys"))
    # lengths bound a candidate before grams are compared; asked holds a few rows a query token
    near = grams.join(F.broadcast(asked), "gram").filter(F.abs(F.length("term") - F.length("token")) <= spelling.max_distance(F.col("token")))
    return near.groupBy("token", F.col("term").alias("cand"), "doc_freq", "keys").agg(F.count("*").alias("overlap"), F.min("gram_ix").alias("first_gram"))


def scored_candidates(unknown: DataFrame, grams: DataFrame) -> DataFrame:
    """Candidates within the edit distance that the token's length allows, with their scores."""
    limit = spelling.max_distance(F.col("token"))
    near = gram_overlap(unknown, grams).filter(F.levenshtein("token", "cand") <= 2 * limit)  # never above twice the distance
    near = near.withColumn("distance", spelling.damerau_levenshtein("token", "cand")).filter(F.col("distance") <= limit)
    same = F.when(F.substring("token", 1, 1) == F.substring("cand", 1, 1), SAME_START).otherwise(0.0)
    score = F.col("overlap") / F.col("keys") * OVERLAP + same + F.log1p("doc_freq") * FREQUENCY - F.col("distance") * DISTANCE
    return near.withColumn("score", score)


def corrections(unknown: DataFrame, grams: DataFrame) -> DataFrame:
    """token, correction, distance, score: the best candidate that is good enough, of each token that has one."""
    order = Window.partitionBy("token").orderBy(F.desc("score"), F.desc("doc_freq"), "first_gram", "cand")
    best = scored_candidates(unknown, grams).withColumn("r", F.row_number().over(order)).filter((F.col("r") == 1) & (F.col("score") >= LEAST))
    return best.select("token", F.col("cand").alias("correction"), "distance", "score")


def correct_tokens(tokens: DataFrame, terms: DataFrame, grams: DataFrame) -> DataFrame:
    """ix, token, term (corrected or as it is), distance (null where nothing was corrected)."""
    unknown = [(r.token,) for r in unknown_tokens(tokens, terms).collect()]  # of the query's tokens
    found = corrections(tokens.sparkSession.createDataFrame(unknown, "token string"), grams)
    return tokens.join(F.broadcast(found), "token", "left").select("ix", "token", F.coalesce("correction", "token").alias("term"), "distance")  # a row for each query token
