"""A training corpus from ``documents``: quality, exact and near dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept;
all but the last return the columns of ``documents``. ``run`` writes every stage's rows as Parquet to the
shared checkpoint folder and rereads them. Every stage judges each row by its own text, told apart by id and a digest of
the text, so rows that share an id or have none do not decide for each other; a null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondflow.llm.common import crc_fold, materialise, read_table, row_key, without_rows
from pondflow.llm.decontaminate import clean_rows
from pondflow.llm.exact_dedup import drop_copies
from pondflow.llm.ngram_join import jaccard_classes
from pondflow.llm.pieces import encode_documents
from pondflow.llm.quality import quality_scores
from pondflow.llm.queries import digests, tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier accepts."""
    labels = read_table(spark, sf_dir, "labels")
    keyed = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    scores = materialise(quality_scores(keyed, labels, lambda i: crc_fold(i, 3) != 1, carry="row_key"), "scores")
    return without_rows(docs, scores.where("predicted = 0"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id (rows without an id come after all
    others), of equal ids the one with the smallest digest."""
    classes = jaccard_classes(docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text"), "row_key")
    return without_rows(docs, classes.where("doc_id != component_id").select(F.col("doc_id").alias("row_key")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage."""
    return clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of the documents that are left, as digests like those of the operator's own query."""
    return digests(encode_documents(docs, tokenizer("piece_bpe_32k.model")))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", encoded),
]

# The classifier and the encoding are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
