"""The driver's tables as the library's records, one query for each operator, and the results back under the tables' names."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaseloom.llm import (
    bpe,
    centroids,
    chat_format,
    decontamination,
    lexical_search,
    license_scan,
    near_dedup,
    oracle,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    token_output,
    toxicity,
    url_filter,
)
from leaseloom.sources.folders import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def findable(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after it told the Python workers of a local session where this process has the package."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
        return build(spark, sf_dir)

    return run


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = findable(build)
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_insights(documents: DataFrame) -> DataFrame:
    """Documents as written insights: doc_id is the insight's id, the text its detail."""
    return documents.select(F.col("doc_id").alias("insight_id"), F.col("text").alias("detail"))


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_insights(table(spark, sf_dir, "documents"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "insight_id")


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(insights(spark, sf_dir)).withColumnRenamed("insight_id", "doc_id")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = insights(spark, sf_dir)
    classifier = toxicity.fit_toxicity(written, reviews(spark, sf_dir))
    return toxicity.score_toxicity(written, classifier).withColumnRenamed("insight_id", "doc_id")


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_held_out(insights(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.hit_words(F.col("spans"))
    return found.select(
        F.col("insight_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_details(insights(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_decoded=True)
    return encoded.select(
        F.col("insight_id").alias("doc_id"), F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(insights(spark, sf_dir), least_percent=85).withColumnRenamed("insight_id", "doc_id")


@query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages.select("page_id", "url"), url_filter.page_links(pages)).drop("url")


@query
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(insights(spark, sf_dir)).withColumnRenamed("insight_id", "doc_id")


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    messages = conversations.select(F.col("conv_id").alias("chunk_id"), "turn", "role", F.col("text").alias("content"))
    chats = chat_format.read_chats(chat_format.format_chats(messages))
    said_by = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return chats.select(
        F.col("chunk_id").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said_by, ""), 256).alias("turns_sha256"), F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = insights(spark, sf_dir)
    forest = quality_rules.fit_verdict(written, reviews(spark, sf_dir))
    return quality_rules.quality_rules(written, forest).withColumnRenamed("insight_id", "doc_id")


@query
def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    token_output.write_token_files(insights(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_output.read_token_files(spark, path, with_ids=False).withColumnRenamed("insight_id", "doc_id")


@query
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = insights(spark, sf_dir)
    model = quality_classifier.fit_quality(written, reviews(spark, sf_dir))
    return quality_classifier.score_quality(written, model).withColumnRenamed("insight_id", "doc_id")


@query
def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("headline_id"), F.col("text").alias("headline"))
    return lexical_search.rank_details(insights(spark, sf_dir), items).withColumnsRenamed({"headline_id": "item_id", "insight_id": "doc_id"})


@query
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("profile_id"), F.col("embedding").alias("figures"))
    return centroids.cluster_profiles(profiles, width=64).drop("compared").withColumnRenamed("profile_id", "vec_id")


ORACLE_SQL |= {
    "op1_suffix_array_dedup": oracle.SUFFIX_DEDUP,
    "op3_benchmark_decontamination": oracle.DECONTAMINATION,
    "op5_minhash_near_dedup": oracle.NEAR_DEDUP,
    "op6_url_filters": oracle.URL_FILTERS,
    "op7_license_scans": oracle.LICENSE_SCANS,
    "op8_chat_formatting": oracle.CHAT_FORMATTING,
    "op12_ranked_lexical_search": oracle.LEXICAL_SEARCH,
    "op13_centroid_clustering": oracle.centroids(),
}
