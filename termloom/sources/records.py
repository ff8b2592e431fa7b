"""Collections, queries, judgments and scored documents from tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import text as T


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, JSON lines, ORC or CSV with header by the path's ending; Parquet otherwise."""
    kind = next((k for k in ("json", "jsonl", "orc", "csv", "tsv") if f".{k}" in path.rsplit("/", 1)[-1]), "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return reader.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    return reader.format("json" if kind == "jsonl" else kind).load(path)


def _or_null(df: DataFrame, name: str):
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def collection(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text): text, else body; an empty one is none, and rows without either are left out."""
    text = F.coalesce(*(F.when(x != "", x) for x in (_or_null(df, "text"), _or_null(df, "body"))))
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text")).filter("text is not null")


def queries(df: DataFrame, id_col: str = "qid") -> DataFrame:
    """(qid, text): text, else title and description, else empty."""
    return df.select(F.col(id_col).alias("qid"), T.record_text(_or_null(df, "text"), _or_null(df, "title"), _or_null(df, "description")).alias("text"))


def scored_docs(df: DataFrame) -> DataFrame:
    """(qid, rank, doc_id, score) ranked by score; the order of the source does not matter."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    return df.select("qid", "doc_id", F.col("score").cast("double").alias("score")).withColumn("rank", F.row_number().over(order)).select("qid", "rank", "doc_id", "score")


def feedback_source(scored: DataFrame | None = None, run: DataFrame | None = None, qrels: DataFrame | None = None) -> DataFrame:
    """Documents for feedback: scored documents, else a run, else relevant documents by judgment."""
    if scored is not None:
        return scored_docs(scored)
    if run is not None:
        return scored_docs(run)
    if qrels is not None:
        return scored_docs(qrels.filter("rel > 0").withColumn("score", F.col("rel").cast("double")))
    raise ValueError("there are no scored documents, no run and no judgments")


def query_ids(spark: SparkSession, path: str) -> DataFrame:
    """(qid) from the non-blank lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("qid")).filter("qid <> ''").distinct()


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids, "qid", "left_semi")
