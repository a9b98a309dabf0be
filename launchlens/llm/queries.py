"""Registered queries of the text operators: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlens.llm import langid, pii, quality, toxicity
from launchlens.llm.bpe import encoding_digests
from launchlens.llm.centroids import cluster
from launchlens.llm.common import fold, read
from launchlens.llm.contamination import contaminated
from launchlens.llm.exact import exact_dedup
from launchlens.llm.htmltext import extract
from launchlens.llm.jaccard import ngram_components
from launchlens.llm.oracles import OP11_SQL, OP12_SQL, OP13_SQL
from launchlens.llm.passages import repeated_passages
from launchlens.llm.resampling import resample
from launchlens.llm.secret_scan import find_secrets, span_digests as secret_digests


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = langid.train(docs, fold("doc_id", 4) != 2)
    return langid.identify(docs, net).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="max")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality.quality(docs, *model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.toxicity(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("sentences").alias("n_sentences"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"), k=4, percent=85)


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", F.round("cover", 6).alias("cover"), "changed")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_personal_data(read(spark, sf_dir, "documents")))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(read(spark, sf_dir, "documents"), vocabulary_path())


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(find_secrets(read(spark, sf_dir, "documents")))


def load() -> dict:
    return {
        "op1_language_id": (op1_language_id, None),
        "op4_quality": (op4_quality, None),
        "op5_toxicity": (op5_toxicity, None),
        "op6_ngram_jaccard": (op6_ngram_jaccard, None),
        "op7_passages": (op7_passages, None),
        "op8_decontamination": (op8_decontamination, None),
        "op9_pii": (op9_pii, None),
        "op10_bpe": (op10_bpe, None),
        "op2_html_text": (op2_html_text, None),
        "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
        "op11_centroids": (op11_centroids, OP11_SQL),
        "op12_resampling": (op12_resampling, OP12_SQL),
        "op13_secrets": (op13_secrets, OP13_SQL),
    }
