"""Query expansion by pseudo-relevance feedback: relevance models RM1 and RM3."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import numbers as N
from termloom.functions import text as T
from termloom.functions.stem import stems
from termloom.operators import bm25
from termloom.operators.index import HEAD, Index
from termloom.sources import shared

FEEDBACK_DOCS, TERMS, MAX_TOKENS = 10, 20, HEAD


def document_weights(feedback: DataFrame) -> DataFrame:
    """Adds ``doc_weight``: the share of a document's score in its query's scores.

    Where a query has a negative score, the scores count as logarithms and the weight is
    their softmax; scores that add up to 0 give the weight 0.
    """
    q = Window.partitionBy("qid")
    log_scores = F.min("score").over(q) < 0
    top = F.max("score").over(q)
    total = F.sum("score").over(q)
    soft = F.exp(F.col("score") - top) / F.sum(F.exp(F.col("score") - F.col("top_"))).over(q)
    plain = F.when(total > 0, F.col("score") / total).otherwise(F.lit(0.0))
    return feedback.withColumn("top_", top).withColumn("doc_weight", F.when(log_scores, soft).otherwise(plain)).drop("top_")


def relevance_model(feedback: DataFrame, docs: DataFrame, max_tokens: int = MAX_TOKENS, stemmed: bool = False) -> DataFrame:
    """(qid, term, weight) from feedback (qid, doc_id, score): sum of doc weight * tf / length.

    Documents are narrowed to those asked for before they are tokenised; of each the
    first ``max_tokens`` tokens count, as the index's analyser gives them.
    """
    wanted = docs.select("doc_id", "text").join(feedback.select("doc_id").distinct(), "doc_id", "left_semi")
    tokens = wanted.select("doc_id", T.first(T.analyzed(F.col("text")), max_tokens).alias("tokens"))
    rows = tokens.select("doc_id", F.size("tokens").alias("n"), F.explode("tokens").alias("term"))
    if stemmed:
        rows = rows.withColumn("term", stems(F.col("term")))
    shares = rows.groupBy("doc_id", "n", "term").agg(F.count("*").alias("tf"))
    weighted = document_weights(feedback).join(shares, "doc_id")
    return weighted.groupBy("qid", "term").agg(F.sum(F.col("doc_weight") * F.col("tf") / F.col("n")).alias("weight"))


def indexed_model(index: Index, feedback: DataFrame) -> DataFrame:
    """``relevance_model`` from the index's counts of the first ``HEAD`` terms, without the texts."""
    held = index.of_documents(feedback).select("doc_id", F.least("dl", F.lit(HEAD)).alias("n"), "counts", "heads")
    rows = document_weights(feedback).join(held, "doc_id").select("qid", "doc_weight", "n", F.inline(F.arrays_zip("counts", "heads")))
    part = F.col("doc_weight") * F.col("heads") / F.col("n")
    return rows.filter("heads > 0").groupBy("qid", F.col("counts.term").alias("term")).agg(F.sum(part).alias("weight"))


def with_query_terms(model: DataFrame, query_terms: DataFrame, weight: float = 1.0) -> DataFrame:
    """RM3: each distinct query term starts with weight 1, whether a document has it or not."""
    seed = query_terms.select("qid", "term").distinct().withColumn("weight", F.lit(weight))
    return model.unionByName(seed).groupBy("qid", "term").agg(F.sum("weight").alias("weight"))


def top_terms(model: DataFrame, k: int = TERMS) -> DataFrame:
    """(qid, rank, term, weight): the k heaviest terms, ties in alphabetical order."""
    order = Window.partitionBy("qid").orderBy(F.round("weight", 9).desc(), "term")
    return model.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "term", "weight")


def filtered(model: DataFrame, stopwords: list[str] | None = None, min_length: int = 1, max_length: int = 10_000) -> DataFrame:
    """Without stop words and terms of unwanted length."""
    keep = F.length("term").between(min_length, max_length)
    if stopwords:
        keep = keep & ~F.col("term").isin(stopwords)
    return model.filter(keep)


def without_query_terms(model: DataFrame, query_terms: DataFrame) -> DataFrame:
    return model.join(query_terms.select("qid", "term").distinct(), ["qid", "term"], "left_anti")


def _feedback_model(index: Index, docs: DataFrame | None, query_terms: DataFrame, feedback_docs: int, max_tokens: int) -> DataFrame:
    feedback = bm25.search(index, query_terms, feedback_docs)
    if max_tokens == HEAD:
        return indexed_model(index, shared.materialize(feedback, "feedback")[0] if index.bounds is not None else feedback)
    return relevance_model(feedback, docs, max_tokens, index.stemmed)


def rm1(index: Index, docs: DataFrame | None, query_terms: DataFrame, feedback_docs: int = FEEDBACK_DOCS, k: int = TERMS, drop_query_terms: bool = False, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``docs`` are read only if ``max_tokens`` is not what the index has counted."""
    model = _feedback_model(index, docs, query_terms, feedback_docs, max_tokens)
    return top_terms(without_query_terms(model, query_terms) if drop_query_terms else model, k)


def rm3(index: Index, docs: DataFrame | None, query_terms: DataFrame, feedback_docs: int = FEEDBACK_DOCS, k: int = TERMS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    return top_terms(with_query_terms(_feedback_model(index, docs, query_terms, feedback_docs, max_tokens), query_terms), k)


MODELS: dict[str, Callable[..., DataFrame]] = {"rm1": rm1, "rm3": rm3}


def expand_queries(index: Index, docs: DataFrame, query_terms: DataFrame, model: str = "rm3", k: int = 10, **options) -> DataFrame:
    if model not in MODELS:
        raise ValueError(f"unknown relevance model {model!r}; known: {sorted(MODELS)}")
    return MODELS[model](index, docs, query_terms, k=k, **options)


def expand_from_feedback(query_terms: DataFrame, feedback: DataFrame, model: str = "rm3", k: int = 10) -> DataFrame:
    """Feedback given with its texts: (qid, doc_id, score, text)."""
    if model not in MODELS:
        raise ValueError(f"unknown relevance model {model!r}; known: {sorted(MODELS)}")
    weights = relevance_model(feedback.select("qid", "doc_id", "score"), feedback.select("doc_id", "text").distinct())
    return top_terms(weights if model == "rm1" else with_query_terms(weights, query_terms), k)


def feedback_frame(spark, documents: dict[str, list[str]], scores: dict[str, list[float]]) -> DataFrame:
    """Feedback rows from driver-side lists; their lengths must agree."""
    rows = []
    for qid, texts in documents.items():
        if len(texts) != len(scores.get(qid, [])):
            raise ValueError(f"{qid}: {len(texts)} documents but {len(scores.get(qid, []))} scores")
        rows += [(qid, f"{qid}-{i}", float(s), t) for i, (t, s) in enumerate(zip(texts, scores[qid], strict=True))]
    return spark.createDataFrame(rows, "qid string, doc_id string, score double, text string")


def expansion_statistics(expansion: DataFrame) -> DataFrame:
    return expansion.groupBy("qid").agg(*N.describe(F.col("weight")))


def explain(query_terms: DataFrame, feedback: DataFrame) -> DataFrame:
    """(qid, terms, n_feedback, scores, log_scores); the lists are as long as a query and its feedback."""
    by_rank = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("score")))), lambda x: x["score"])
    told = feedback.groupBy("qid").agg(F.count("*").alias("n_feedback"), by_rank.alias("scores"), F.bool_or(F.col("score") < 0).alias("log_scores"))
    terms = query_terms.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms"))
    return terms.join(told, "qid")


def simple_expansion(queries: DataFrame, n: int = 5) -> DataFrame:
    """The first n words of the query, each with weight 1."""
    return queries.select("qid", F.posexplode(T.first(T.whitespace_tokens(F.col("text")), n)).alias("pos", "term")).select(
        "qid", (F.col("pos") + 1).alias("rank"), "term", F.lit(1.0).alias("weight")
    )


def frequent_terms(expansion: DataFrame, index: Index, min_docs: int = 2) -> DataFrame:
    """Only terms that occur in at least ``min_docs`` documents of the collection."""
    return expansion.join(index.term_stats.filter(F.col("df") >= min_docs).select("term", "df"), "term")


def merged(parts: DataFrame, k: int = TERMS) -> DataFrame:
    """One expansion from those of several batches of feedback: weights of a term add up."""
    return top_terms(parts.groupBy("qid", "term").agg(F.sum("weight").alias("weight")), k)


def truncated_feedback(feedback: DataFrame, docs: DataFrame, max_docs: int = 1000, max_chars: int = 500) -> DataFrame:
    """(qid, rank, doc_id, score, text): the best ``max_docs`` documents of a query, each cut to ``max_chars`` characters."""
    best = bm25.ranked(feedback.drop("rank"), ["qid"], max_docs)
    return best.join(docs.select("doc_id", "text"), "doc_id").withColumn("text", F.substring("text", 1, max_chars))
