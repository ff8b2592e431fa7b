"""Cleaning a corpus of documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm import decontaminate, langid, nearcopies, pieces, queries, substrings
from termloom.sources.shared import drop_path, new_path, scratch, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

ORACLE_SQL = None  # no SQL for hashing, automata and tokenisation; tests hold the stages against brute force


def stage(fn: Stage) -> Stage:
    """Executors get the package before a stage runs, wherever it is called from."""

    @wraps(fn)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, docs, sf_dir)

    return call


def own_name(name: str, docs: DataFrame) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go.

    The model learns from the documents themselves. Null texts, empty texts and texts
    without a letter are rejected; rows that repeat are judged alike; where no document has
    a language everything is rejected; an empty table stays empty.
    """
    model = langid.fit(docs, queries.fold(4) != 2)
    return langid.accepted(docs, model)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the least doc_id stays; a document without id stays, equal rows are one.

    Documents are told apart by id and text, so different texts under one id are different
    documents. Null and empty texts are one group. Of rows with the same id and text that
    differ in other columns one stays. An empty table stays empty.
    """
    key, of_key, row = (own_name(c, docs) for c in ("key_", "least_", "row_"))
    found = nearcopies.near_copies(docs).filter("doc_id is not null")
    least = F.min(F.struct("doc_id", "key"))
    keep = found.groupBy("component").agg(least.alias("k")).select(F.col("k.doc_id").alias(of_key), F.col("k.key").alias(key))
    named = docs.withColumn(key, nearcopies.text_key())
    kept = named.join(keep, (named["doc_id"] == keep[of_key]) & (named[key] == keep[key]), "left_semi")
    first = Window.partitionBy("doc_id", key).orderBy("text")
    return kept.withColumn(row, F.row_number().over(first)).filter(F.col(row) == 1).select(*docs.columns).unionByName(docs.filter("doc_id is null"))


@stage
def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; texts without such words stay as they are.

    Every row stays, with ``n_chars`` (if there is such a column) of its new text. A null
    text becomes empty; rows without id keep their text; rows that repeat get the same text.
    """
    of_id, text, digest = (own_name(c, docs) for c in ("id_", "text_", "digest_"))
    kept = substrings.dedup_substrings(docs, keep_layout=True).select(F.col("doc_id").alias(of_id), F.col("text").alias(text), F.col("digest").alias(f"{digest}_kept"))
    rest = docs.withColumn(digest, F.md5(F.coalesce("text", F.lit("")))).drop("text")
    joined = rest.join(kept, rest["doc_id"].eqNullSafe(kept[of_id]) & (rest[digest] == kept[f"{digest}_kept"])).withColumn("text", F.col(text))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)


@stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none and stay; rows that repeat are judged alike; null and
    blank items are ignored; an empty table stays empty.
    """
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


@stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip of what is left: a row for each row.

    Null and empty texts have no pieces; a null id stays null.
    """
    return pieces.encode(docs, queries.tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_repeated_substrings),
    ("benchmark", drop_benchmark_leaks),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives; each table is dropped when the next stage has written its own."""
    ship_package(spark)
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, fn in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            made = fn(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
