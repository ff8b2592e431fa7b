"""Term importance: features of expansion terms and their weighted combination."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import numbers as N
from termloom.operators import bm25, similarity
from termloom.operators.index import Index

FEATURES = ("rm_weight", "bm25_score", "semantic_score")


def features(expansion: DataFrame, bm25_scores: DataFrame, semantic: DataFrame) -> DataFrame:
    """(qid, rank, term, rm_weight, bm25_score, semantic_score); a missing feature is 0.

    ``bm25_scores`` is by term (collection level) or by qid and term (document level).
    """
    keys = ["qid", "term"] if "qid" in bm25_scores.columns else ["term"]
    scores = bm25_scores.select(*keys, F.col("score").alias("bm25_score"))
    joined = expansion.join(scores, keys, "left").join(semantic, ["qid", "term"], "left")
    return joined.select(
        "qid", "rank", "term", F.col("weight").alias("rm_weight"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), F.coalesce("similarity", F.lit(0.0)).alias("semantic_score")
    )


def extract_features(index: Index, expansion: DataFrame, query_terms: DataFrame, encoder: similarity.Encoder, dim: int, bm25_scope: str = "collection", reference: DataFrame | None = None) -> DataFrame:
    """Features of an expansion. ``bm25_scope``: "collection", or "document" with ``reference`` (qid, doc_id)."""
    if bm25_scope == "collection":
        scores = bm25.collection_term_scores(index, expansion)
    elif bm25_scope == "document" and reference is not None:
        scores = bm25.document_term_scores(index, expansion.join(reference, "qid").select("qid", "doc_id", "term"))
    else:
        raise ValueError("bm25_scope is 'collection', or 'document' with reference documents")
    return features(expansion, scores, similarity.term_similarities(query_terms, expansion, encoder, dim))


def combined(alpha="alpha", beta="beta", gamma="gamma"):
    a, b, g = (F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in (alpha, beta, gamma))
    return a * F.coalesce("rm_weight", F.lit(0.0)) + b * F.coalesce("bm25_score", F.lit(0.0)) + g * F.coalesce("semantic_score", F.lit(0.0))


def with_feature(rows: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Adds a feature of one's own from (term, value) or (qid, term, value); missing ones are 0."""
    keys = ["qid", "term"] if "qid" in values.columns else ["term"]
    joined = rows.join(values.select(*keys, F.col("value").alias(name)), keys, "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0.0)))


def with_custom(rows: DataFrame, weights: dict[str, float], alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0) -> DataFrame:
    """The weighted importance plus weighted features of one's own."""
    extra = combined(alpha, beta, gamma)
    for name, weight in weights.items():
        extra = extra + F.lit(float(weight)) * F.col(name)
    return rows.withColumn("importance", extra)


def uniform(rows: DataFrame) -> DataFrame:
    return rows.withColumn("importance", F.lit(1.0))


def rm_only(rows: DataFrame) -> DataFrame:
    return rows.withColumn("importance", F.col("rm_weight"))


def weighted(rows: DataFrame, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0) -> DataFrame:
    return rows.withColumn("importance", combined(alpha, beta, gamma))


MODELS: dict[str, Callable[..., DataFrame]] = {"uniform": uniform, "rm_only": rm_only, "importance_weighted": weighted}


def model(name: str, **options) -> Callable[[DataFrame], DataFrame]:
    """A function from features to features with ``importance``; any such function is a model."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(MODELS)}")
    return lambda rows: MODELS[name](rows, **options)


def explain(rows: DataFrame, alpha: float, beta: float, gamma: float) -> DataFrame:
    """Raw features, weighted parts and the sum."""
    return weighted(rows, alpha, beta, gamma).select(
        "qid", "rank", "term", *FEATURES, (F.col("rm_weight") * alpha).alias("rm_part"), (F.col("bm25_score") * beta).alias("bm25_part"), (F.col("semantic_score") * gamma).alias("semantic_part"), "importance"
    )


def ablation_weights(spark, alpha: float, beta: float, gamma: float) -> DataFrame:
    """(model, alpha, beta, gamma, constant) of the eight models; ``constant`` is added to every importance."""
    rows = [
        ("uniform", 0.0, 0.0, 0.0, 1.0),
        ("rm_only", 1.0, 0.0, 0.0, 0.0),
        ("bm25_only", 0.0, 1.0, 0.0, 0.0),
        ("semantic_only", 0.0, 0.0, 1.0, 0.0),
        ("rm_bm25", alpha, beta, 0.0, 0.0),
        ("rm_semantic", alpha, 0.0, gamma, 0.0),
        ("bm25_semantic", 0.0, beta, gamma, 0.0),
        ("our_method", alpha, beta, gamma, 0.0),
    ]
    values = F.array(*(F.struct(F.lit(m).alias("model"), *(F.lit(float(x)).alias(n) for n, x in zip(("alpha", "beta", "gamma", "constant"), w, strict=True))) for m, *w in rows))
    return spark.range(1, numPartitions=1).select(F.inline(values))


def ablation_importance(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(model, qid, rank, term, importance): features times the few rows of weights."""
    return rows.crossJoin(F.broadcast(weights)).select("model", "qid", "rank", "term", (combined() + F.col("constant")).alias("importance"))


def feature_statistics(rows: DataFrame) -> DataFrame:
    """One row a feature: count, mean, sample deviation, min, max."""
    long = rows.select("qid", "term", F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES))))
    v = F.col("value")
    return long.groupBy("feature").agg(
        F.count("*").alias("n"), N.rounded(F.avg(v)).alias("mean"), N.rounded(F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("stdev"), N.rounded(F.min(v)).alias("min"), N.rounded(F.max(v)).alias("max")
    )


def dataset_statistics(rows: DataFrame) -> DataFrame:
    """One row: queries, terms and terms a query."""
    return rows.agg(F.countDistinct("qid").alias("num_queries"), F.count("*").alias("num_terms"), N.rounded(F.count("*") / F.countDistinct("qid")).alias("avg_expansion_terms"))


def coverage(rows: DataFrame) -> DataFrame:
    """Share of non-zero values of each feature."""
    return rows.agg(*(N.rounded(F.avg((F.col(f) > 0).cast("double"))).alias(f"{f}_coverage") for f in FEATURES))


def validate(rows: DataFrame) -> None:
    """Raises ValueError when there is no row or a feature is null or not a number."""
    bad = [F.sum((F.col(f).isNull() | F.isnan(f)).cast("long")).alias(f) for f in FEATURES]
    found = rows.agg(F.count("*").alias("n"), *bad).first()
    if not found["n"]:
        raise ValueError("there are no features")
    if wrong := [f for f in FEATURES if found[f]]:
        raise ValueError(f"features with missing values: {wrong}")


def nested(rows: DataFrame) -> DataFrame:
    """One row a query with a map from term to its features."""
    entries = F.collect_list(F.struct("term", F.struct(*FEATURES)))
    return rows.groupBy("qid").agg(F.map_from_entries(entries).alias("term_features"))
