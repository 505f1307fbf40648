"""The corpus pipeline: STAGES in order, each over all that the one before kept.

Every stage but the last returns the columns of documents; the last adds token ids and their number. ``run`` writes
each result as Parquet in the shared folder and reads it again, so that no stage's lineage reaches into another.

Rows of an empty table give an empty result of the same columns in every stage. Null and empty texts are kept by all of
them; other columns are carried along, whatever their names. Ids may repeat, be null or be of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, near_dup, sentencepiece_bpe, substring_dedup, toxicity
from tallyframe.llm.spark import read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones of docs, doesn't reject; repeated rows go or stay together."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, toxicity.training_labels(read(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id; rows that repeat it stay, as do rows without an id."""
    return near_dup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; n_chars follows the text. Rows without an id lose nothing."""
    cut = substring_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, which decode to their texts."""
    return sentencepiece_bpe.tokenize(docs, sentencepiece_bpe.model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Neither the models nor sketching, alignment and merge-dropout can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
