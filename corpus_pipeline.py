"""Corpus cleaning and packing: five stages, each over all rows that its predecessor kept.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents;
`run` writes every stage's rows as Parquet in the shared folder and reads them again, so that a lost
executor never costs more than one stage.

Null and empty texts have no toxic sentence, no repeated line and no benchmark window; they are near copies
of each other, so one of them stays, and it packs as the end id alone. Null ids are kept and packed like
others. Texts of any length are handled whole. Repeated rows become one in the near-dedup stage, where the
row of the smallest id stays in every group, null ids last. An empty table gives no rows. Documents may
have more columns, of any name and type; stages return them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import decontamination, line_dedup, near_copies, packing, toxicity
from skarn.llm.common import plain_names, read_table, written
from skarn.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows, does not call toxic."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    plain = plain_names(docs)
    scored = toxicity.score(model, plain, keep=tuple(plain.columns), text=plain.columns[docs.columns.index("text")])
    return scored.filter(F.col("predicted") == 0).select(*plain.columns).toDF(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later copies of line runs."""
    out = line_dedup.remove_repeated_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard of at least 0.8), that of the smallest id."""
    return near_copies.one_of_each(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    plain = plain_names(docs)
    found = decontamination.decontaminate(plain, read_table(spark, sf_dir, "benchmark"), keep=tuple(plain.columns), text=plain.columns[docs.columns.index("text")])
    return found.filter(~F.col("contaminated")).select(*plain.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), capacity=1024)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer cannot be put in SQL; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
