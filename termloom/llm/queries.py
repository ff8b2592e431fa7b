"""The registered queries of this subpackage: ``op<N>_<name>`` for each operator, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import best_fit, conversations, decontaminate, divergence, html_text, langid, licenses, pieces, quality, simhash, substrings, token_ids, toxicity
from termloom.llm.oracle import ORACLE_SQL  # noqa: F401  the SQL beside the queries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; ``TERMLOOM_TOKENIZERS`` names another folder."""
    if folder := os.environ.get("TERMLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.read_ids(token_ids.write_ids(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("passages") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct("passages.item_id")).alias("item_ids"),
        F.size("passages").cast("long").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"]).alias("n_passage_chars"),
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold(4) != 2)
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumn("char_distance", F.round("char_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files ``source/lang/doc_id``."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select(path.alias("path"), "text"))
    return found.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), *found.columns)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit.pack(best_fit.cut(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = conversations.damaged(turns)
    answers = conversations.cheapest_edits(conversations.signatures(rows, turns))
    return conversations.digests(rows, answers).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_substring_dedup,
        op3_token_ids,
        op4_decontaminate,
        op5_html_text,
        op6_simhash,
        op7_language_id,
        op8_toxicity,
        op9_quality_rules,
        op10_licenses,
        op11_best_fit,
        op12_conversations,
        op13_divergence,
    )

}
