"""The text pipeline: each stage takes what its predecessor kept and returns the rows that it keeps.

Rows without an id are kept by the stages that decide by id (n-gram groups, decontamination) and go on as they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlens.llm import bpe, contamination, exact, jaccard, quality
from launchlens.llm.common import discard, drop_rows, fold, read, stored
from launchlens.llm.queries import vocabulary_path

#: Documents whose probability of good quality is lower are rejected.
LEAST_QUALITY = 0.3


#: Rows that Spark hands to a Python worker at a time: the JVM and the worker each hold a few such batches.
BATCH_ROWS = 1000


def small_batches(stage):
    """The stage, with Arrow batches of BATCH_ROWS rows from then on in its session."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of rows outside the held-out fold, and
    counts word neighbours over the documents given."""
    vectors, net = quality.train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality.filter_documents(docs, vectors, net, LEAST_QUALITY)


@small_batches
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact.drop_copies(docs, keep="max")


@small_batches
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingle sets link at 0.8 or more, the one with the smallest doc_id.

    Of rows that share that id, all stay: a row is dropped for a link, not for its id."""
    groups = stored(jaccard.ngram_components(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias("_dropped")).distinct())
    return drop_rows(docs, "doc_id", groups, "_dropped")


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


@small_batches
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token counts and digests of ids and decoded text."""
    return bpe.encoding_digests(docs, vocabulary_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The classifier, the template match and the encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next, which then takes its place."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        given, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
            if k:
                discard(given)
    return docs
