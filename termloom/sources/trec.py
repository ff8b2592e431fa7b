"""Run and judgment files in the six- and four-column text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import numbers as N


def parse_run(lines: DataFrame, col: str = "value") -> DataFrame:
    """(qid, doc_id, rank, score, tag); lines with fewer than six fields are dropped."""
    f = F.split(F.trim(col), r"\s+")
    return lines.select(f.alias("f")).filter(F.size("f") >= 6).select(
        F.col("f")[0].alias("qid"), F.col("f")[2].alias("doc_id"), F.col("f")[3].cast("int").alias("rank"), F.col("f")[4].cast("double").alias("score"), F.col("f")[5].alias("tag")
    )


def parse_qrels(lines: DataFrame, col: str = "value") -> DataFrame:
    """(qid, doc_id, rel); lines with fewer than four fields are dropped."""
    f = F.split(F.trim(col), r"\s+")
    return lines.select(f.alias("f")).filter(F.size("f") >= 4).select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("doc_id"), F.col("f")[3].cast("int").alias("rel"))


def run_line(tag: Column | str) -> Column:
    """``qid Q0 doc rank score tag`` with six decimals."""
    return F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), N.fixed(F.col("score"), 6), F.lit(tag))


def run_lines(run: DataFrame, tag: str = "run") -> DataFrame:
    """(value): one line a row."""
    return run.select(run_line(tag).alias("value"))


def qrels_lines(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("0"), F.col("doc_id").cast("string"), F.col("rel").cast("string")).alias("value"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return parse_run(spark.read.text(path))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Of lines that judge the same pair the last in the file counts."""
    lines = spark.read.text(path).withColumn("line_", F.monotonically_increasing_id())
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.select("line_", f.alias("f")).filter(F.size("f") >= 4).select("line_", F.col("f")[0].alias("qid"), F.col("f")[2].alias("doc_id"), F.col("f")[3].cast("int").alias("rel"))
    return rows.groupBy("qid", "doc_id").agg(F.max_by("rel", "line_").alias("rel"))


def write_run(run: DataFrame, path: str, tag: str = "run") -> None:
    """Lines in order of query and rank, over as many files as there are partitions."""
    ordered = run.repartitionByRange("qid").sortWithinPartitions("qid", "rank")
    run_lines(ordered, tag).write.mode("overwrite").text(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels_lines(qrels.repartitionByRange("qid").sortWithinPartitions("qid", "doc_id")).write.mode("overwrite").text(path)


def with_ranks(run: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ranks by score, ties by document id."""
    order = Window.partitionBy(*(keys or ["qid"])).orderBy(F.col("score").desc(), "doc_id")
    return run.withColumn("rank", F.row_number().over(order))
