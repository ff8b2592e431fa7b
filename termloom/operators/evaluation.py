"""Comparing runs: improvements, tables, ablations and significance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import numbers as N
from termloom.functions import text as T
from termloom.operators import expansion, importance, metrics, rerank
from termloom.operators.index import Index
from termloom.operators.similarity import Encoder
from termloom.sources import shared


def compare(results: DataFrame, baseline: str) -> DataFrame:
    """(run_name, metric, value, baseline_value, improvement_pct, improvement_abs) of every other run."""
    base = results.filter(F.col("run_name") == baseline).select("metric", F.col("value").alias("baseline_value"))
    pct, diff = N.change(F.col("value"), F.col("baseline_value"))
    return results.filter(F.col("run_name") != baseline).join(base, "metric").select("run_name", "metric", "value", "baseline_value", pct.alias("improvement_pct"), diff.alias("improvement_abs"))


def baseline_of(names: list[str], wanted: str | None = None) -> str:
    """The wanted run if it is there, else the first."""
    return wanted if wanted in names else names[0]


def table(results: DataFrame, baseline: str, names: list[str]) -> DataFrame:
    """One row a run, the baseline first: each metric as text with its signed difference."""
    base = results.filter(F.col("run_name") == baseline).select("metric", F.col("value").alias("base"))
    diff = F.col("value") - F.col("base")
    signed = F.concat(F.when(F.round(diff, 4) >= 0, "+").otherwise(""), N.fixed(N.rounded(diff, 4), 4))
    cell = F.when(F.col("run_name") == baseline, N.fixed(F.col("value"), 4)).otherwise(F.concat(N.fixed(F.col("value"), 4), F.lit(" ("), signed, F.lit(")")))
    cells = results.join(base, "metric").withColumn("cell", cell)
    return cells.groupBy("run_name").pivot("metric", names).agg(F.first("cell")).withColumn("is_baseline", F.col("run_name") == baseline)


def original_and_reranked(original: DataFrame, reranked: DataFrame, qrels: DataFrame, names: list[str]) -> DataFrame:
    """(metric, original, reranked, difference)."""
    a = metrics.evaluate(original, qrels, names).withColumnRenamed("value", "original")
    b = metrics.evaluate(reranked, qrels, names).withColumnRenamed("value", "reranked")
    return a.join(b, "metric").withColumn("difference", F.col("reranked") - F.col("original"))


def ablation(features: DataFrame, weights: DataFrame, candidates: DataFrame, query_terms: DataFrame, docs: DataFrame, qrels: DataFrame, encoder: Encoder, names: list[str], top_k: int = 100, baseline: str = "first_stage", similarities: DataFrame | None = None) -> DataFrame:
    """All models of ``weights`` in one plan: rerank, evaluate, compare with the first stage.

    The vectors meet the documents once; the cap on query vectors is drawn by model,
    because a weight of 0 drops terms and frees places for later ones.
    """
    own = importance.ablation_importance(features, weights)
    if similarities is None:
        similarities = similarities_of(features, candidates, query_terms, docs, encoder)
    runs = rerank.rerank(candidates, query_terms, own, docs, encoder, top_k, ["model", "qid"], similarities)
    both = runs.withColumnRenamed("model", "run_name").unionByName(candidates.select(F.lit(baseline).alias("run_name"), "qid", "rank", "doc_id", "score"))
    return compare(metrics.evaluate(both, qrels, names, ["run_name", "qid"]), baseline)


def ablation_from_feedback(queries: DataFrame, feedback: DataFrame, index: Index, weights: DataFrame, candidates: DataFrame, docs: DataFrame, qrels: DataFrame, encoder: Encoder, dim: int, names: list[str], terms: int = 15, top_k: int = 100) -> DataFrame:
    """All models without features at hand: expansion and features come from the feedback (qid, doc_id, score).

    Queries without feedback are left out, as they have no expansion to weigh.
    """
    query_terms, tokens = index.query_terms(queries), T.token_rows(queries, "qid")
    model = expansion.indexed_model(index, feedback)
    fed = feedback.select("qid").distinct()
    expanded = expansion.top_terms(expansion.with_query_terms(model, query_terms.join(fed, "qid", "left_semi")), terms)
    expanded, _ = shared.materialize(expanded, "ablation-expansion")
    features, _ = shared.materialize(importance.extract_features(index, expanded, tokens, encoder, dim), "ablation-features")
    return ablation(features, weights, candidates.join(fed, "qid", "left_semi"), tokens, docs, qrels, encoder, names, top_k)


def simple_ablation(queries: DataFrame, candidates: DataFrame, query_terms: DataFrame, docs: DataFrame, qrels: DataFrame, encoder: Encoder, names: list[str], top_k: int = 100) -> DataFrame:
    """Without features or feedback: the first words of a query with equal weights, against the first stage."""
    own = expansion.simple_expansion(queries).select("qid", "rank", "term", F.col("weight").alias("importance"))
    runs = rerank.rerank(candidates, query_terms, own, docs, encoder, top_k).withColumn("run_name", F.lit("uniform_simple"))
    both = runs.unionByName(candidates.select("qid", "rank", "doc_id", "score", F.lit("first_stage").alias("run_name")))
    return compare(metrics.evaluate(both, qrels, names, ["run_name", "qid"]), "first_stage")


def similarities_of(features: DataFrame, candidates: DataFrame, query_terms: DataFrame, docs: DataFrame, encoder: Encoder) -> DataFrame:
    terms = query_terms.select("qid", "term").unionByName(features.select("qid", "term"))
    return rerank.term_similarities(candidates, terms, docs, encoder)


def significance(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Paired t statistic and counts of better, worse and equal queries; ``a`` and ``b`` come from ``per_query``."""
    pairs = a.select("qid", F.col(metric).alias("x")).join(b.select("qid", F.col(metric).alias("y")), "qid")
    d = F.col("y") - F.col("x")
    deviation = F.stddev_samp(d)
    t = F.when(deviation > 0, F.avg(d) / (deviation / F.sqrt(F.count("*")))).otherwise(F.lit(0.0))
    count = lambda c: F.sum(c.cast("long"))
    return pairs.agg(F.count("*").alias("n"), N.rounded(F.avg(d)).alias("mean_difference"), N.rounded(t).alias("t"), count(d > 0).alias("better"), count(d < 0).alias("worse"), count(d == 0).alias("equal"))
