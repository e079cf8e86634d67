"""Inverted index: postings with positions, term statistics, document statistics, settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.words import INDEX_STOPWORDS, word_sequence

# How many positions a field counts and stores, and the ranking constants.
POSITION_CAP, TITLE_STORED, BODY_STORED = 50, 20, 50
STRATEGY = {"classic": "bm25_field_boost_graph_pr", "positional": "bm25_field_boost_graph_pr_positional_spell"}


@dataclass(frozen=True)
class RankingConfig:
    strategy: str = STRATEGY["classic"]
    k1: float = 1.2
    b: float = 0.75
    title_boost: float = 2.5
    page_rank_weight: float = 0.35
    coverage_weight: float = 0.2
    phrase_weight: float = 0.9
    proximity_weight: float = 0.45
    avg_doc_len: float = 200.0


def token_positions(pages: DataFrame) -> DataFrame:
    """page_id, field, term, pos of every indexed word. Stop words are left out but keep their positions."""
    fields = F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("body").alias("field"), F.col("body_text").alias("text")))
    words = pages.select("page_id", F.explode(fields).alias("f")).select("page_id", "f.field", F.posexplode_outer(word_sequence(F.col("f.text"))).alias("pos", "term"))
    return words.filter(F.col("term").isNotNull() & ~F.col("term").isin(*INDEX_STOPWORDS))


def postings(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each (term, page): capped frequencies and the first positions of each field.

    Only texts are shuffled, to bring rows of one page together (into the given number of partitions);
    the words of a page are sorted and grouped in its own row, so neither words nor lists of positions
    are shuffled or spilled. The rows of a page stay in one partition.
    """
    own = pages.repartition(*([parts] if parts else []), "page_id").groupBy("page_id").agg(F.collect_list(F.struct("title", "body_text")).alias("texts"))

    def words(text: str, body: bool) -> Column:
        def at(word, pos):
            return F.struct(word.alias("term"), F.lit(body).alias("body"), pos.alias("pos"))

        return F.flatten(F.transform("texts", lambda t: F.transform(word_sequence(t[text]), at)))

    hits = F.filter(F.concat(words("title", False), words("body_text", True)), lambda x: ~x["term"].isin(*INDEX_STOPWORDS))
    own = own.select("page_id", F.sort_array(hits).alias("hits"))
    first = F.filter(F.transform("hits", lambda _, i: i), lambda i: (i == 0) | (F.get("hits", i)["term"] != F.get("hits", i - 1)["term"]))
    own = own.select("page_id", "hits", first.alias("first"))
    runs = F.transform("first", lambda s, k: F.slice("hits", s + 1, F.coalesce(F.get("first", k + 1), F.size("hits")) - s))
    found = own.select("page_id", F.explode(runs).alias("run"))
    of = {"title": F.filter("run", lambda x: ~x["body"]), "body": F.filter("run", lambda x: x["body"])}
    found = found.select(F.get("run", F.lit(0))["term"].alias("term"), "page_id", *(F.transform(c, lambda x: x["pos"]).alias(f) for f, c in of.items()))
    found = found.select(
        "term",
        "page_id",
        F.least(F.size("title"), F.lit(POSITION_CAP)).alias("freq_title"),
        F.least(F.size("body"), F.lit(POSITION_CAP)).alias("freq_body"),
        F.struct(F.slice("title", 1, TITLE_STORED).alias("title"), F.slice("body", 1, BODY_STORED).alias("body")).alias("positions"),
    )
    return found.withColumns({"tf_title": F.col("freq_title").cast("double"), "tf_body": F.col("freq_body").cast("double")})


def positions_json(positions: Column) -> Column:
    """Positions as JSON text, for tables that other programs read."""
    return F.to_json(positions)


def parse_positions(text: Column) -> Column:
    """Positions of JSON text: bad text gives empty lists, entries that are no numbers are left out."""
    raw = F.from_json(text, "title array<string>, body array<string>", {"mode": "PERMISSIVE"})
    clean = {f: F.filter(F.transform(F.coalesce(raw[f], F.array()), lambda x: x.try_cast("int")), lambda x: x.isNotNull()) for f in ("title", "body")}
    return F.struct(*(c.alias(f) for f, c in clean.items()))


def terms(posted: DataFrame, page_count: int) -> DataFrame:
    """term, doc_freq, idf."""
    return posted.groupBy("term").agg(F.count("*").alias("doc_freq")).withColumn("idf", scoring.idf(F.lit(float(page_count)), F.col("doc_freq")))


def doc_lengths(pages: DataFrame, posted: DataFrame) -> DataFrame:
    """page_id, word_count: capped counts of both fields, 0 for pages without any."""
    lengths = posted.groupBy("page_id").agg(F.sum(F.col("freq_title") + F.col("freq_body")).alias("n"))
    return pages.select("page_id").join(lengths, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("word_count"))


def doc_stats(lengths: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """page_id, score, word_count, in_links, out_links; without ranks all but the length are 0."""
    if ranks is None:
        return lengths.select("page_id", F.lit(0.0).alias("score"), "word_count", F.lit(0).cast("long").alias("in_links"), F.lit(0).cast("long").alias("out_links"))
    joined = lengths.join(ranks.select("page_id", "score", "in_links", "out_links"), "page_id", "left")
    return joined.select("page_id", F.coalesce("score", F.lit(0.0)).alias("score"), "word_count", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_links", "out_links")))


def index_meta(page_count: int, term_count: int, avg_doc_len: float, spark) -> DataFrame:
    """Settings and corpus constants by key."""
    c = asdict(RankingConfig())
    rows = [(f"bm25_{k}", c[k], None) for k in ("k1", "b")] + [(k, c[k], None) for k in ("title_boost", "page_rank_weight", "coverage_weight")]
    rows += [("avg_doc_len", float(avg_doc_len), None), ("page_count", float(page_count), None), ("term_count", float(term_count), None), ("ranking_strategy", None, c["strategy"])]
    meta = spark.createDataFrame(rows, "key_name string, value_num double, value_text string")
    now = meta.limit(1).select(F.lit("last_index_unix").alias("key_name"), F.unix_timestamp().cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_text"))
    return meta.union(now).withColumn("updated_at", F.current_timestamp())


#: Key of each setting in index_meta.
SETTINGS = {"k1": "bm25_k1", "b": "bm25_b"} | {k: k for k in ("title_boost", "page_rank_weight", "coverage_weight", "phrase_weight", "proximity_weight", "avg_doc_len")}


def pivot_meta(meta: DataFrame, profile: str = "classic") -> DataFrame:
    """One row of settings: a missing key takes the default, a null number is 0, the average length is at least 1."""
    default = RankingConfig(strategy=STRATEGY[profile])
    own = {k: F.col("key_name") == key for k, key in SETTINGS.items()}
    columns = [F.when(F.max(on) == F.lit(True), F.coalesce(F.max(F.when(on, F.col("value_num"))), F.lit(0.0))).otherwise(F.lit(getattr(default, k))).alias(k) for k, on in own.items()]
    text = F.max(F.when(F.col("key_name") == "ranking_strategy", F.nullif("value_text", F.lit(""))))
    row = meta.filter(F.col("key_name").isin(*SETTINGS.values(), "ranking_strategy")).agg(F.coalesce(text, F.lit(default.strategy)).alias("strategy"), *columns)
    return row.withColumn("avg_doc_len", F.greatest("avg_doc_len", F.lit(1.0)))


def load_config(meta: DataFrame, profile: str = "classic") -> RankingConfig:
    return RankingConfig(**pivot_meta(meta, profile).first().asDict())
