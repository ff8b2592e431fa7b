"""Training sets, experiments, weights and folds on storage that Spark can reach.

Tables are Parquet, one folder each; small records (weights, metadata) are one-row JSON
written and read through Spark, so any file system that Spark knows will do.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.sources import trec

TABLES = ("queries", "qrels", "documents", "features", "expansion_terms", "statistics")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def save_json(spark: SparkSession, record: dict, path: str, compress: bool = False) -> None:
    """A small record as one JSON line; gzip if asked."""
    row = spark.createDataFrame([(json.dumps(record, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1)
    row.write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def save_training_set(spark: SparkSession, path: str, metadata: dict | None = None, **tables: DataFrame) -> dict:
    """Writes each table and a metadata record with the row counts; returns the record."""
    if unknown := set(tables) - set(TABLES):
        raise ValueError(f"unknown tables {sorted(unknown)}; known: {TABLES}")
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    record = {"created_at": datetime.datetime.now().isoformat(), "counts": counts, "metadata": metadata or {}}
    save_json(spark, record, f"{path}/metadata")
    return record


def load_training_set(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """Whatever tables are there, and the metadata."""
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in TABLES if exists(spark, f"{path}/{n}")}
    return tables, load_json(spark, f"{path}/metadata") if exists(spark, f"{path}/metadata") else {}


def save_experiment(spark: SparkSession, base: str, name: str, runs: DataFrame, results: DataFrame, weights: tuple | None = None, summary: dict | None = None, evaluations: DataFrame | None = None) -> str:
    """A folder with a time in its name: runs by run_name as tables and as lines, results, weights, summary.

    ``evaluations`` is what each run reached, for instance (run_name, qid, metric, value).
    """
    path = f"{base}/{name}_{datetime.datetime.now():%Y%m%d_%H%M%S}"
    runs.write.partitionBy("run_name").parquet(f"{path}/runs")
    ordered = runs.repartitionByRange("run_name", "qid").sortWithinPartitions("run_name", "qid", "rank")
    ordered.select("run_name", trec.run_line(F.col("run_name")).alias("value")).write.partitionBy("run_name").text(f"{path}/run_lines")
    results.write.parquet(f"{path}/results")
    if evaluations is not None:
        evaluations.write.partitionBy("run_name").parquet(f"{path}/evaluations")
    if weights:
        save_weights(spark, weights, f"{path}/weights")
    save_json(spark, summary or {}, f"{path}/summary")
    return path


def save_weights(spark: SparkSession, weights: tuple[float, float, float], path: str, info: dict | None = None) -> None:
    record = {"weights": dict(zip(("alpha", "beta", "gamma"), map(float, weights), strict=True)), "created_at": datetime.datetime.now().isoformat()}
    save_json(spark, record | ({"experiment_info": info} if info else {}), path)


def load_weights(spark: SparkSession, path: str) -> tuple[float, float, float]:
    w = load_json(spark, path)["weights"]
    return w["alpha"], w["beta"], w["gamma"]


def save_folds(folds: DataFrame, path: str) -> None:
    """One JSON line a fold with its training and testing queries."""
    of = lambda split: F.array_sort(F.collect_list(F.when(F.col("split") == split, F.col("qid").cast("string")))).alias(split)
    folds.groupBy("fold").agg(of("training"), of("testing")).coalesce(1).write.mode("overwrite").json(path)


def load_folds(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("fold string, training array<string>, testing array<string>").json(path)
    parts = [rows.select("fold", F.lit(s).alias("split"), F.explode(s).alias("qid")) for s in ("training", "testing")]
    return parts[0].unionByName(parts[1])
