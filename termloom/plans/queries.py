"""The registered queries of the retrieval operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import numbers as N
from termloom.functions import text as T
from termloom.operators import bm25, crossval, evaluation, expansion, importance, index, metrics, optimize, rerank, similarity, subwords
from termloom.plans.workload import CANDIDATES, DIM, EXPANSION_TERMS, WEIGHTS, Workload
from termloom.sources import records, shared, trec
from termloom.streaming import indexing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ALL_METRICS = ["num_ret", "num_rel", "num_rel_ret", "map", "gm_map", "recip_rank", "ndcg", "Rprec", "bpref", "set_P", "set_recall", "set_F", "11pt_avg"]
RUN_METRICS = ["map", "ndcg_cut_10", "ndcg_cut_100", "recip_rank", "recall_100", "P_10", "no_such_metric"]


def query(fn: Callable[[Workload], DataFrame]) -> Callable[[Workload], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Workload(spark, sf_dir))
    return fn


def r(*names: str, places: int = 6):
    return [N.rounded(F.col(n), places).alias(n) for n in names]


# -- text and index


@query
def tokenize_df_cf(w: Workload) -> DataFrame:
    return w.index.term_stats.select("term", "df", "cf")


@query
def index_stats(w: Workload) -> DataFrame:
    return index.index_statistics(w.index)


@query
def index_validate(w: Workload) -> DataFrame:
    return index.validate_index(w.index)


@query
def subword_merge(w: Workload) -> DataFrame:
    turns = w.table("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.flatten(F.transform(T.tokens(F.col("text")), lambda t: T.subwords(t))).alias("pieces"))
    return T.merge_subwords(turns, "key").select("key", F.col("word_idx").cast("long").alias("word_idx"), "word", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))


@query
def subword_ids(w: Workload) -> DataFrame:
    """Tokens of conversations in pieces of a vocabulary, which is made of the queries' tokens in pieces of 2 and of 4."""
    asked = T.token_rows(w.items, "qid").select("term").distinct()
    made = asked.select(F.explode(F.concat(T.subwords(F.col("term"), 2), T.subwords(F.col("term"), 4))).alias("piece")).distinct()
    vocabulary = made.withColumn("id", F.conv(F.substring(F.md5("piece"), 1, 8), 16, 10).cast("long"))
    turns = w.table("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    found = subwords.encoded(T.token_rows(turns, "key"), vocabulary, "key")
    return found.select("key", F.col("pos").cast("long").alias("pos"), "term", F.col("piece_no").cast("long").alias("piece_no"), "piece", "id")


@query
def collection_scan(w: Workload) -> DataFrame:
    """Every row of documents (its text under ``text``) and of pages (its html under ``body``)."""
    documents = w.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text", F.lit(None).cast("string").alias("body"))
    pages = w.table("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.col("html").alias("body"))
    return records.collection(documents.unionByName(pages)).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query
def query_texts(w: Workload) -> DataFrame:
    parts = w.table("part").select(F.col("p_partkey").alias("qid"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("text"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).alias("title"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("description"))
    return records.queries(parts)


# -- BM25


@query
def bm25_topk(w: Workload) -> DataFrame:
    return bm25.search(w.index, w.query_terms, 10).select("qid", "rank", "doc_id", *r("score"))


@query
def bm25_topk_pruned(w: Workload) -> DataFrame:
    """The search that reads the postings of essential terms only, whatever the size of the collection."""
    wanted, _ = shared.materialize(bm25.weights(w.inverted, w.inverted.query_terms(w.items)), "query-weights")
    return bm25.pruned_search(w.inverted, wanted, 10).select("qid", "rank", "doc_id", *r("score"))


@query
def phrase_hits(w: Workload) -> DataFrame:
    """Where the first two terms of a query follow each other, from the positions in the index."""
    pairs = w.items.select("qid", F.array_join(T.first(T.analyzed(F.col("text")), 2), " ").alias("text"))
    return bm25.phrases(w.index, pairs).select("qid", "doc_id", "n", F.col("first").alias("first_place"))


def _top_doc(w: Workload) -> DataFrame:
    return w.run(10).filter("rank = 1").select("qid", "doc_id")


@query
def bm25_doc_term(w: Workload) -> DataFrame:
    words = w.query_tokens.select("qid", "term")
    pairs = w.queries.select("qid", F.array_join(T.first(F.split("text", " "), 2), " ").alias("term"))
    blank = w.queries.select("qid", F.lit("?").alias("term"))
    asked = _top_doc(w).join(words.unionByName(pairs).unionByName(blank), "qid")
    return bm25.document_term_scores(w.index, asked).select("qid", "doc_id", "term", *r("score"))


@query
def bm25_collection_term(w: Workload) -> DataFrame:
    return bm25.collection_term_scores(w.index, w.query_terms).select("term", *r("score"))


@query
def token_scores(w: Workload) -> DataFrame:
    asked = _top_doc(w).join(w.queries, "qid")
    return bm25.token_scores(w.index, asked).select("qid", "doc_id", F.col("pos").cast("long").alias("pos"), *r("score"))


@query
def token_spans(w: Workload) -> DataFrame:
    """Scores of pieces of four characters: each piece of a word that scores, below the 512th of its document."""
    asked = _top_doc(w).join(w.queries, "qid")
    return bm25.token_scores(w.piece_index, asked).select("qid", "doc_id", F.col("pos").cast("long").alias("pos"), *r("score"))


@query
def dense_token_scores(w: Workload) -> DataFrame:
    """The 512 scores of each query's best document, zeros included."""
    asked = _top_doc(w).join(w.queries, "qid")
    dense = bm25.dense_scores(bm25.token_scores(w.index, asked))
    return dense.select("qid", "doc_id", F.posexplode("scores").alias("pos", "score")).select("qid", "doc_id", F.col("pos").cast("long").alias("pos"), *r("score"))


@query
def streaming_index(w: Workload) -> DataFrame:
    """Terms of an index that a stream keeps up to date: all documents, then changes, deletions and returns, with merges between."""
    docs, last = w.table("documents"), F.col("doc_id")
    updates = [
        docs.select("doc_id", "text"),
        docs.filter(last % 10 == 3).select("doc_id", F.concat("text", F.lit(" updated "), "source").alias("text")),
        docs.filter(last % 10 == 7).select("doc_id", F.lit(None).cast("string").alias("text")),
        docs.filter(last % 20 == 3).select("doc_id", F.substring("text", 1, 200).alias("text")),
        docs.filter(last % 20 == 7).select("doc_id", F.concat(F.lit("again "), "lang").alias("text")),
    ]
    feed, path, checkpoint = (shared.new_path(w.spark, x) for x in ("feed", "segments", "stream"))
    for update in updates:  # arrives, and the stream takes it up
        update.write.mode("append").parquet(feed)
        stream = w.spark.readStream.schema("doc_id long, text string").parquet(feed)
        indexing.index_stream(stream, path, checkpoint, fanout=2).awaitTermination()
        shared.drop_path(w.spark, feed)  # what is taken up
    return indexing.open_parts(w.spark, path).term_stats


@query
def bm25_param_sweep(w: Workload) -> DataFrame:
    found = bm25.parameter_sweep(w.index, w.query_terms, [0.9, 1.2, 1.6, 2.0], [0.4, 0.75, 1.0], 5)
    return found.select("k1", "b", "qid", "rank", "doc_id", *r("score"))


# -- expansion


def _model(w: Workload) -> DataFrame:
    return expansion.indexed_model(w.index, w.run(10))


def _terms(model: DataFrame, k: int = 20) -> DataFrame:
    return expansion.top_terms(model, k).select("qid", "rank", "term", *r("weight"))


@query
def rm1_terms(w: Workload) -> DataFrame:
    return _terms(_model(w))


@query
def rm3_terms(w: Workload) -> DataFrame:
    return expansion.rm3(w.index, w.docs, w.query_terms).select("qid", "rank", "term", *r("weight"))


@query
def rm3_no_query_terms(w: Workload) -> DataFrame:
    return _terms(expansion.without_query_terms(_model(w), w.query_terms))


@query
def rm3_filtered(w: Workload) -> DataFrame:
    return _terms(expansion.filtered(expansion.with_query_terms(_model(w), w.query_terms), T.STOPWORDS, 3, 12))


@query
def expansion_stats(w: Workload) -> DataFrame:
    return expansion.expansion_statistics(w.expansion)


@query
def expansion_explain(w: Workload) -> DataFrame:
    told = expansion.explain(w.query_terms, w.run(10))
    return told.select("qid", F.array_join("terms", " ").alias("terms"), "n_feedback", F.array_join(F.transform("scores", lambda s: N.fixed(N.rounded(s, 4), 4)), " ").alias("scores"), "log_scores")


@query
def simple_expansion(w: Workload) -> DataFrame:
    return expansion.simple_expansion(w.queries)


@query
def expansion_df_filter(w: Workload) -> DataFrame:
    return expansion.frequent_terms(w.expansion, w.index, 5).select("qid", "rank", "term", *r("weight"), "df")


@query
def expansion_merge(w: Workload) -> DataFrame:
    early, late = (expansion.top_terms(expansion.indexed_model(w.index, w.run(10).filter(c)), 20) for c in ("rank <= 5", "rank > 5"))
    return expansion.merged(early.unionByName(late)).select("qid", "rank", "term", *r("weight"))


@query
def feedback_truncation(w: Workload) -> DataFrame:
    return expansion.truncated_feedback(w.run(10), w.docs, 3, 500).select("qid", "rank", "doc_id", *r("score"), "text")


@query
def log_score_weights(w: Workload) -> DataFrame:
    logs = w.run(10).withColumn("score", F.log(F.col("score") / 100.0))
    return expansion.document_weights(logs).select("qid", "doc_id", *r("doc_weight"))


# -- similarity


def _few_vectors(w: Workload) -> DataFrame:
    return w.table("embeddings").filter("vec_id % 100 = 0")


@query
def cosine_pairs(w: Workload) -> DataFrame:
    return similarity.pairs(_few_vectors(w), w.table("embeddings"), "cosine")


@query
def dot_pairs(w: Workload) -> DataFrame:
    return similarity.pairs(_few_vectors(w), w.table("embeddings"), "dot")


@query
def euclidean_pairs(w: Workload) -> DataFrame:
    return similarity.pairs(_few_vectors(w), w.table("embeddings"), "euclidean")


@query
def semantic_term_scores(w: Workload) -> DataFrame:
    return similarity.term_similarities(w.query_tokens, w.expansion, w.encoder, DIM).select("qid", "term", *r("similarity"))


@query
def similarity_matrix(w: Workload) -> DataFrame:
    terms = w.query_tokens.filter("pos = 0").select("term").distinct()
    every = w.queries.select("qid").crossJoin(terms)  # two small stated sets
    return similarity.term_similarities(w.query_tokens, every, w.encoder, DIM).select("qid", "term", *r("similarity"))


@query
def similarity_distribution(w: Workload) -> DataFrame:
    found = similarity.distribution(w.features.select("qid", "term", F.col("semantic_score").alias("similarity")), 0.3)
    return found.withColumn("high_terms", F.array_join("high_terms", " "))


@query
def similarity_quality(w: Workload) -> DataFrame:
    return similarity.quality(w.features, "semantic_score", "rm_weight")


# -- importance


@query
def importance_uniform(w: Workload) -> DataFrame:
    return importance.model("uniform")(w.features).select("qid", "rank", "term", "importance")


@query
def importance_rm_only(w: Workload) -> DataFrame:
    return importance.model("rm_only")(w.features).select("qid", "rank", "term", *r("importance"))


@query
def importance_weighted(w: Workload) -> DataFrame:
    a, b, g = WEIGHTS
    return importance.model("importance_weighted", alpha=a, beta=b, gamma=g)(w.features).select("qid", "rank", "term", *r("importance"))


@query
def importance_explain(w: Workload) -> DataFrame:
    names = ("rm_weight", "bm25_score", "semantic_score", "rm_part", "bm25_part", "semantic_part", "importance")
    return importance.explain(w.features, *WEIGHTS).select("qid", "rank", "term", *r(*names))


@query
def importance_explain_document(w: Workload) -> DataFrame:
    """The explanation with the scores of each query's best document."""
    names = ("rm_weight", "bm25_score", "semantic_score", "rm_part", "bm25_part", "semantic_part", "importance")
    rows = importance.extract_features(w.index, w.expansion, w.query_tokens, w.encoder, DIM, "document", _top_doc(w))
    return importance.explain(rows, *WEIGHTS).select("qid", "rank", "term", *r(*names))


@query
def ablation_importance(w: Workload) -> DataFrame:
    weights = importance.ablation_weights(w.spark, *WEIGHTS)
    return importance.ablation_importance(w.features, weights).select("model", "qid", "rank", "term", *r("importance"))


@query
def custom_feature_importance(w: Workload) -> DataFrame:
    rare = w.index.term_stats.select("term", F.log(1.0 + F.col("df")).alias("value"))
    rows = importance.with_feature(w.features, rare, "log_df")
    return importance.with_custom(rows, {"log_df": -0.1}, *WEIGHTS).select("qid", "rank", "term", *r("log_df", "importance"))


@query
def term_features(w: Workload) -> DataFrame:
    found = importance.extract_features(w.index, w.expansion, w.query_tokens, w.encoder, DIM, "document", _top_doc(w))
    return found.join(_top_doc(w), "qid").select("qid", F.col("doc_id").alias("reference_doc_id"), "rank", "term", *r(*importance.FEATURES))


@query
def feature_stats(w: Workload) -> DataFrame:
    return importance.feature_statistics(w.features)


@query
def feature_dataset_stats(w: Workload) -> DataFrame:
    return importance.dataset_statistics(w.features)


@query
def feature_coverage(w: Workload) -> DataFrame:
    return importance.coverage(w.features)


@query
def score_variance(w: Workload) -> DataFrame:
    return w.run(10).groupBy("qid").agg(*N.spread(F.col("score")))


# -- reranking


@query
def maxsim_scores(w: Workload) -> DataFrame:
    return w.similarities.select("qid", "doc_id", "term", *r("similarity"))


def _importance(w: Workload) -> DataFrame:
    return importance.weighted(w.features, *WEIGHTS)


@query
def query_vectors(w: Workload) -> DataFrame:
    return rerank.query_vectors(w.query_tokens, _importance(w), w.encoder).select("qid", "n", "part", "term", *r("weight"), F.size("vec").cast("long").alias("dim"))


@query
def query_vectors_explain(w: Workload) -> DataFrame:
    told = rerank.explain(rerank.query_vectors(w.query_tokens, _importance(w), w.encoder))
    return told.select("qid", F.array_join("own_terms", " ").alias("own_terms"), F.array_join("expansion_terms", " ").alias("expansion_terms"), "n_vectors")


@query
def rerank_info(w: Workload) -> DataFrame:
    return rerank.model_info(rerank.query_vectors(w.query_tokens, _importance(w), w.encoder), w.run(CANDIDATES))


@query
def rerank_topk(w: Workload) -> DataFrame:
    return w.reranked.select("qid", "rank", "doc_id", *r("score"))


@query
def rerank_sentence(w: Workload) -> DataFrame:
    found = rerank.rerank_sentences(w.run(CANDIDATES), w.query_tokens, _importance(w), w.document_vectors, w.encoder, DIM, CANDIDATES)
    return found.select("qid", "rank", "doc_id", *r("score"))


# -- metrics


def _metric(name: str, *columns: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = Workload(spark, sf_dir)
        return metrics.per_query(w.run(100), w.qrels).select("qid", *(N.rounded(F.col(f"`{c}`")).alias(c) for c in columns))

    QUERIES[name] = run


_metric("p_at_k", "P_1", "P_5", "P_10", "P_100")
_metric("recall_at_k", "recall_5", "recall_10", "recall_100")
_metric("recip_rank", "recip_rank")
_metric("average_precision", "map", "map_cut_5", "map_cut_10", "map_cut_100")
_metric("ndcg_cut_10", "ndcg_cut_10")
_metric("ndcg_cut_100", "ndcg_cut_100", "ndcg")
_metric("rprec", "Rprec")
_metric("success_k", "success_1", "success_5", "success_10")
_metric("set_metrics", "num_ret", "num_rel", "num_rel_ret", "set_P", "set_recall", "set_F")
_metric("bpref", "bpref")
_metric("iprec_at_recall", *(f"iprec_at_recall_{x:.2f}".replace(".", "_") for x in metrics.LEVELS), "11pt_avg")


@query
def evaluate_all(w: Workload) -> DataFrame:
    return metrics.evaluate(w.run(100), w.qrels, ALL_METRICS).select("metric", *r("value"))


def _results(w: Workload) -> DataFrame:
    return metrics.evaluate(w.runs, w.qrels, RUN_METRICS, ["run_name", "qid"])


@query
def evaluate_runs_long(w: Workload) -> DataFrame:
    return _results(w).select("run_name", "metric", *r("value"))


@query
def compare_runs(w: Workload) -> DataFrame:
    return evaluation.compare(_results(w), "bm25").select("run_name", "metric", *r("value", "baseline_value", "improvement_pct", "improvement_abs", places=5))


@query
def results_pivot(w: Workload) -> DataFrame:
    return evaluation.table(_results(w).select("run_name", "metric", N.rounded(F.col("value"), 9).alias("value")), "bm25", ["map", "ndcg_cut_10"])


@query
def original_vs_reranked(w: Workload) -> DataFrame:
    return evaluation.original_and_reranked(w.run(CANDIDATES), w.reranked, w.qrels, ["map", "ndcg_cut_10", "recip_rank"]).select("metric", *r("original", "reranked", "difference"))


@query
def paired_significance(w: Workload) -> DataFrame:
    a, b = (metrics.per_query(x, w.qrels).select("qid", N.rounded(F.col("ndcg_cut_10"), 9).alias("ndcg_cut_10")) for x in (w.run(CANDIDATES), w.reranked))
    return evaluation.significance(a, b, "ndcg_cut_10")


@query
def ablation_eval(w: Workload) -> DataFrame:
    weights = importance.ablation_weights(w.spark, *WEIGHTS)
    found = evaluation.ablation(w.features, weights, w.run(CANDIDATES), w.query_tokens, w.docs, w.qrels, w.encoder, ["map", "ndcg_cut_10"], CANDIDATES, similarities=w.similarities)
    return found.select("run_name", "metric", *r("value", "baseline_value", "improvement_pct", "improvement_abs", places=5))


@query
def ablation_from_feedback(w: Workload) -> DataFrame:
    weights = importance.ablation_weights(w.spark, *WEIGHTS)
    found = evaluation.ablation_from_feedback(w.items, w.run(10), w.index, weights, w.run(CANDIDATES), w.docs, w.qrels, w.encoder, DIM, ["map", "ndcg_cut_10"], EXPANSION_TERMS, CANDIDATES)
    return found.select("run_name", "metric", *r("value", "baseline_value", "improvement_pct", "improvement_abs", places=5))


@query
def simple_ablation_eval(w: Workload) -> DataFrame:
    found = evaluation.simple_ablation(w.queries, w.run(CANDIDATES), w.query_tokens, w.docs, w.qrels, w.encoder, ["map", "ndcg_cut_10"], CANDIDATES)
    return found.select("run_name", "metric", *r("value", "baseline_value", "improvement_pct", "improvement_abs", places=5))


# -- weights


def _objective(w: Workload, points: list, **options) -> DataFrame:
    return optimize.objective_scores(w.parts, optimize.weights_frame(w.spark, points), w.qrels, **options)


GRID = optimize.grid()
SAMPLES = optimize.Sampler(((0.1, 5.0),) * 3, 42).points(1000)
SENSITIVITY = [(1.0, 1.0, 1.0), (2.0, 1.0, 1.0), (1.0, 2.0, 1.0), (1.0, 1.0, 2.0), (0.1, 1.0, 1.0), (1.0, 0.1, 1.0), (1.0, 1.0, 0.1)]


@query
def grid_search_scores(w: Workload) -> DataFrame:
    return _objective(w, GRID).select("weights_id", *r("alpha", "beta", "gamma", "score"))


@query
def grid_search_best(w: Workload) -> DataFrame:
    return optimize.best_of(_objective(w, GRID)).select("weights_id", *r("alpha", "beta", "gamma", "score"))


@query
def weight_sensitivity(w: Workload) -> DataFrame:
    return _objective(w, SENSITIVITY).agg(F.count("*").alias("n"), *N.spread(F.col("score")))


@query
def optimizer_comparison(w: Workload) -> DataFrame:
    """Grid and random search: each one's best weights on half of the queries, and their score on the others."""
    groups = crossval.holdout(w.queries, 0.5).select("qid", F.col("split").alias("group"))
    rows = [("grid", i) for i in range(len(GRID))] + [("random", len(GRID) + i) for i in range(len(SAMPLES))]
    methods = w.spark.createDataFrame(rows, "method string, weights_id int")
    return optimize.compare_methods(_objective(w, GRID + SAMPLES, groups=groups), methods).select("method", "weights_id", *r("train_score", "test_score"))


@query
def random_search(w: Workload) -> DataFrame:
    return optimize.best_of(_objective(w, SAMPLES)).select("weights_id", *r("alpha", "beta", "gamma", "score"))


@query
def lbfgs_search(w: Workload) -> DataFrame:
    """The quasi-Newton search on the retrieval objective, moved to the best step of each coordinate; a batch of points is a job."""
    found = optimize.LimitedMemoryBFGS().optimize_batches(optimize.batch_objective(w.parts, w.qrels))
    start = found.history[0][1]
    found = optimize.polished(w.parts, w.qrels, found)
    return optimize.weights_frame(w.spark, [found.weights]).select(*r("alpha", "beta", "gamma"), F.lit(start).alias("start_score"), F.lit(found.score).alias("score"), F.lit(found.evaluations).cast("long").alias("evaluations"))


@query
def line_search(w: Workload) -> DataFrame:
    """The steps of the objective along the first weight, the others as they are."""
    steps = optimize.line_scores(w.parts, w.qrels, (0.0, *WEIGHTS[1:]), (1.0, 0.0, 0.0), 0.1, 5.0)
    return steps.select(*r("t", "until", "score"))


@query
def boundary_check(w: Workload) -> DataFrame:
    """Whether the best weights of the grid lie at its edge."""
    best = optimize.best_of(_objective(w, GRID))
    return optimize.near_bounds(best, 0.1, 3.0).withColumn("value", N.rounded(F.col("value")))


# -- cross-validation and data checks


@query
def cv_folds(w: Workload) -> DataFrame:
    return crossval.folds(w.queries, 5)


def _best_by_fold(w: Workload) -> DataFrame:
    groups = crossval.folds(w.queries, 5).filter("split = 'training'").select("qid", F.col("fold").alias("group"))
    return crossval.best_weights_by_fold(_objective(w, GRID, groups=groups))


@query
def cv_best_weights(w: Workload) -> DataFrame:
    return _best_by_fold(w).select("fold", "weights_id", *r("score"))


@query
def cv_aggregated_run(w: Workload) -> DataFrame:
    """Every query ranked with the weights that its fold's training queries gave."""
    runs = crossval.test_runs(w.parts, crossval.folds(w.queries, 5), _best_by_fold(w))
    return crossval.aggregated_run(runs).select("qid", "rank", "doc_id", *r("score"))


@query
def rerank_for_evaluation(w: Workload) -> DataFrame:
    """The evaluation recipe at full depth: 1,000 candidates, missing feedback leaves a query's own vectors."""
    candidates = w.run(CANDIDATES)
    own = importance.weighted(w.features, 1.0, 1.0, 1.0)
    runs = rerank.rerank(candidates, w.query_tokens, own, w.docs, w.encoder, CANDIDATES, similarities=w.similarities)
    both = runs.select(F.lit("reranked").alias("run_name"), "qid", "rank", "doc_id", "score").unionByName(candidates.select(F.lit("first_stage").alias("run_name"), "qid", "rank", "doc_id", "score"))
    return metrics.evaluate(both, w.qrels, metrics.DEFAULT, ["run_name", "qid"]).select("run_name", "metric", *r("value"))


@query
def holdout_split(w: Workload) -> DataFrame:
    return crossval.holdout(w.queries, 0.2)


@query
def train_alignment(w: Workload) -> DataFrame:
    return crossval.alignment(queries=w.queries, features=w.features, qrels=w.qrels, runs=w.run(10))


@query
def cross_dataset_eval(w: Workload) -> DataFrame:
    part = w.run(100).join(w.queries.select("qid", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd").alias("dataset")), "qid")
    return metrics.evaluate(part, w.qrels, ["map", "ndcg_cut_10"], ["dataset", "qid"]).select("dataset", "metric", *r("value"))


@query
def run_parse(w: Workload) -> DataFrame:
    lines = trec.run_lines(w.run(10), "bm25").unionByName(w.queries.select(F.concat(F.lit("too few "), F.col("qid").cast("string")).alias("value")))
    return trec.parse_run(lines)


@query
def qrels_parse(w: Workload) -> DataFrame:
    return trec.parse_qrels(trec.qrels_lines(w.qrels))


@query
def scored_docs_scan(w: Workload) -> DataFrame:
    labelled = w.table("labels").select((F.col("quality") * 2 + F.col("toxic")).alias("qid"), "doc_id", ((F.col("doc_id") * 7919) % 1000).alias("score"))
    return records.scored_docs(labelled)


@query
def id_overlap(w: Workload) -> DataFrame:
    left, right = w.table("labels").select("doc_id").distinct(), w.run(100).select("doc_id").distinct()
    both = left.intersect(right).agg(F.count("*").alias("both"))
    only = left.exceptAll(right).agg(F.count("*").alias("only_labels"))
    n = right.agg(F.count("*").alias("n_run"))
    return both.crossJoin(only).crossJoin(n).withColumn("match_rate", N.rounded(F.when(F.col("n_run") > 0, F.col("both") / F.col("n_run")).otherwise(0.0)))


@query
def id_shape(w: Workload) -> DataFrame:
    ids = w.table("documents").select(F.explode(F.array(F.col("doc_id").cast("string"), "source", "lang")).alias("id"))
    share = lambda c: N.rounded(F.avg(c.cast("double")))
    return ids.agg(F.count("*").alias("n"), share(F.col("id").rlike("[A-Za-z]")).alias("with_letters"), share(F.col("id").rlike("^[0-9]+$")).alias("all_digits"))
