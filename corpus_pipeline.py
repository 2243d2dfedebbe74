"""The training-corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, and a BPE round trip.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and gives the documents that go on, with the columns of
`documents` (doc_id, text, lang, source, n_chars), the last one what is known of the encoded documents. A null text is an empty one;
rows without a doc_id come after all others."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaseloom.llm import bpe, decontamination, near_dedup, quality_rules, suffix_dedup
from leaseloom.llm.queries import reviews, table
from leaseloom.llm.staging import Work

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No one statement can grow trees or encode; the stages are tested against brute force.
ORACLE_SQL = None


def _insights(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({"doc_id": "insight_id", "text": "detail"})


def _documents(insights: DataFrame) -> DataFrame:
    """Insights as documents again; the number of characters is that of the text as it is now."""
    docs = insights.withColumnsRenamed({"insight_id": "doc_id", "detail": "text"})
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    written = _insights(docs)
    return _documents(quality_rules.good_insights(written, quality_rules.fit_verdict(written, reviews(spark, sf_dir))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return _documents(near_dedup.one_of_each(_insights(docs)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has already are cut out; no document goes."""
    return _documents(suffix_dedup.without_repeats(_insights(docs)))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows are cut out; no document goes."""
    return _documents(decontamination.without_held_out(_insights(docs), table(spark, sf_dir, "benchmark")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids: how many, their digest, and the digest of what they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_details(_insights(docs), path, with_decoded=True).select(
        F.col("insight_id").alias("doc_id"), F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("encoded", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each gives is written, and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    work = Work(spark)
    for name, stage in STAGES:
        docs = work.kept(name, stage(spark, docs, sf_dir))
    return docs
