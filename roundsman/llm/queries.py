"""The dealt queries: each applies its operator to a whole table and digests the result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundsman.llm import (
    bpe, collocations, decontaminate, embed_dedup, jaccard_join, langid, lm_score, main_text, ranked_search, secrets, substring_dedup,
    suffix_dedup, url_filter,
)
from roundsman.llm.common import crc_mod, table

#: Folder of the public tokenizer files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/word_bpe_49k.json"
RANKS = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embed_dedup.links(table(spark, folder, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return lm_score.scores(docs, RANKS, crc_mod(F.col("doc_id"), 7) == 2).withColumnRenamed("id", "doc_id")


def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score"
    )


def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op7_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode(docs, VOCABULARY, ids=False, digests=True).drop("text")


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("found", lambda s: s["rank"] < len(kinds))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in kinds],
        F.sha2(secrets.listing(base), 256).alias("base_sha256"), secrets.listing(F.col("found")).alias("spans"),
    )


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, verdict)")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.removed(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_lm_scoring, op3_ngram_jaccard_join, op4_benchmark_decontamination, op5_language_id, op6_suffix_array_dedup, op7_bpe_round_trip, op8_secret_scan, op9_url_filter,
        op10_substring_dedup, op11_phrase_collocations, op12_html_extraction, op13_ranked_search,
    )
}
