"""A training corpus from raw documents, in five stages that each write a Parquet table.

The stages run in the order of ``STAGES``. All but the last return the columns of
``documents``; a stage that can't tell (null text, null id) keeps the row unless its own rule
says otherwise. Every intermediate table lies in the shared folder, so a lost executor costs
its tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundsman.llm import bpe, decontaminate, jaccard_join, langid, secrets
from roundsman.llm.common import crc_mod, free_name, session_ready, table
from roundsman.llm.queries import VOCABULARY
from roundsman.session import cut_lineage, scratch_path


def _aside(docs: DataFrame, taken: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with its own columns of the names a stage works with renamed, and what selects them back."""
    own = {}
    for name in docs.columns:
        if name.lower() in taken:
            own[name] = free_name(docs, f"own_{name}")
            docs = docs.withColumnRenamed(name, own[name])
    back = {new: old for old, new in own.items()}
    return docs, [F.col(c).alias(back.get(c, c)) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: a text that is null or has no letters is rejected, and nothing else.

    This holds without labels to learn from as well.
    """
    session_ready(spark)
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    docs, own = _aside(docs, ("lang_pred", "score", "has_letters"))
    return langid.predict(docs, model).where("has_letters").select(*own)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by n-gram Jaccard: the one with the smallest id.

    A document is an id with its text, so a reused id stays only with the text that was chosen;
    in a group of null ids only, one text stays. Of rows that repeat both id and text one stays.
    A row without words or text is in no group and stays, however often it is there.
    """
    session_ready(spark)
    number, mark = free_name(docs, "id"), free_name(docs, "mark")
    of = F.xxhash64("text")
    kept = cut_lineage(jaccard_join.kept(docs, size=5, percent=80).select(F.col("id").alias(number), F.col("mark").alias(mark)))
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # ids and hashes only; few of them are there twice
    repeated = docs.where(wordy).groupBy(F.col("doc_id").alias("_id"), of.alias("_mark")).count().where("count > 1")
    repeated = cut_lineage(repeated.select("_id", "_mark"))
    again = F.col(number).eqNullSafe(F.col("_id")) & (F.col(mark) == F.col("_mark"))
    same = F.col("doc_id").eqNullSafe(F.col(number)) & (of == F.col(mark))
    single = docs.join(kept.join(repeated, again, "left_anti").hint("shuffle_hash"), same, "left_semi")
    several = docs.join(kept.join(repeated, again, "left_semi"), same, "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id", "text"]))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    docs, own = _aside(docs, ("n_words", "n_hit", "item_ids", "starts", "ends"))
    return decontaminate.scan(docs, table(spark, sf_dir, "benchmark")).where(F.col("n_hit") == 0).select(*own)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars follows the text."""
    session_ready(spark)
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, the number of tokens, and digests of ids and decoded text."""
    session_ready(spark)
    return bpe.encode(docs, VOCABULARY, digests=True)


STAGES = [
    ("language_id", language), ("ngram_jaccard_join", near_copies), ("benchmark_decontamination", benchmark),
    ("secret_scan", secret), ("bpe", tokens),
]

#: The stages' models and the tokenizer are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
