"""Folds, splits, alignment of training data and cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators import optimize


def fold_of(qid: Column, k: int) -> Column:
    """A stable fold: whole numbers by remainder, other ids by hash."""
    return F.coalesce(qid.cast("string").try_cast("long"), F.crc32(qid.cast("string").cast("binary"))) % k


def folds(queries: DataFrame, k: int = 5) -> DataFrame:
    """(fold, split, qid): each query is tested in one fold and trains in the others."""
    numbered = queries.select("qid", fold_of(F.col("qid"), k).cast("int").alias("own")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return numbered.select("fold", F.when(F.col("fold") == F.col("own"), "testing").otherwise("training").alias("split"), "qid")


def folds_from_assignment(assigned: DataFrame) -> DataFrame:
    """(fold, split, qid) leave-one-fold-out from (fold, qid)."""
    names = assigned.select("fold").distinct()
    rows = assigned.withColumnRenamed("fold", "own").join(F.broadcast(names))
    return rows.select("fold", F.when(F.col("fold") == F.col("own"), "testing").otherwise("training").alias("split"), "qid")


def holdout(queries: DataFrame, test_share: float = 0.2) -> DataFrame:
    """(qid, split): by the first 32 bits of the id's md5, so a query never changes sides."""
    slot = F.conv(F.substring(F.md5(F.col("qid").cast("string")), 1, 8), 16, 10).cast("long") % 1000
    return queries.select("qid", F.when(slot < int(round(test_share * 1000)), "test").otherwise("train").alias("split"))


def alignment(**frames: DataFrame) -> DataFrame:
    """(qid, complete, missing): which of the frames (by name) lack a query."""
    marked = None
    for name, frame in sorted(frames.items()):
        part = frame.select("qid").distinct().withColumn("name", F.lit(name))
        marked = part if marked is None else marked.unionByName(part)
    have = marked.groupBy("qid").agg(F.collect_set("name").alias("have"))
    missing = F.array_sort(F.array_except(F.array(*(F.lit(n) for n in sorted(frames))), "have"))
    return have.select("qid", (F.size(missing) == 0).alias("complete"), F.array_join(missing, ",").alias("missing"))


def aligned(frame: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows whose query is in all the others."""
    for other in others:
        frame = frame.join(other.select("qid").distinct(), "qid", "left_semi")
    return frame


def best_weights_by_fold(scores: DataFrame) -> DataFrame:
    """(fold, weights_id, alpha, beta, gamma, score) from objective scores by training fold (column ``group``)."""
    return optimize.best_of(scores.withColumnRenamed("group", "fold"), ["fold"])


def test_runs(parts: DataFrame, split: DataFrame, best: DataFrame) -> DataFrame:
    """(fold, qid, doc_id, score): every test query scored with the weights of its own fold.

    ``parts`` are those of ``rerank.score_parts``, ``split`` the folds, ``best`` a row of weights a fold.
    """
    own = split.filter("split = 'testing'").select("fold", "qid").join(F.broadcast(best.select("fold", "alpha", "beta", "gamma")), "fold")
    sums = F.col("alpha") * F.col("rm_weight") + F.col("beta") * F.col("bm25_score") + F.col("gamma") * F.col("semantic_score")
    return parts.join(own, "qid").select("fold", "qid", "doc_id", F.coalesce(F.col("base") + sums, F.col("first_score")).alias("score"))


def aggregated_run(test_runs: DataFrame, top_k: int = 1000) -> DataFrame:
    """One run from the test runs of all folds: ranks by score, queries in order."""
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")
    return test_runs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select("qid", "rank", "doc_id", "score")
