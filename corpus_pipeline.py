"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and
returns the columns of documents; the last returns the packed pieces. Every stage is
written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import decontamination, packing, registry, similarity_join, toxicity
from docquarry.llm.common import read_table, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity model scores below one half."""
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(docs, labels, registry.usable_for_toxicity())
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each component of similar documents, in the order of the files.

    Rows are told apart by their place, not by ``doc_id``: of repeated rows one stays, rows
    of one id with unlike texts all stay, and a null id is as good as any. Documents without
    words are alone and stay. ``docs`` must be read from files, as each stage's input is:
    its rows then have the same places each time.
    """
    rows = docs.withColumn("_corpus_row", F.monotonically_increasing_id())
    found = similarity_join.near_duplicates(rows.select("_corpus_row", "text"), id_col="_corpus_row")
    others = found.where("id <> component_id").select(F.col("id").alias("_corpus_other"))
    return rows.join(others, F.col("_corpus_row") == F.col("_corpus_other"), "left_anti").drop("_corpus_row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without any benchmark window."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces in sequences of 4096 tokens."""
    packed = packing.pack_documents(docs, registry.tokenizer_path(), registry.END_ID)
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Scores of a trained model and token ids can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
