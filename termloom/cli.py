"""``python -m termloom <command>``: index, search, expand, features, train, evaluate, cross-validate.

Paths are whatever Spark can read and write. Collections have doc_id and text (or
body); queries qid and text (or title); judgments and runs are in the usual text formats.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import bm25, crossval, evaluation, expansion, importance, index, metrics, optimize, rerank, similarity
from termloom.sources import files, records, shared, store, trec


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termloom", description=__doc__)
    p.add_argument("--log-level", default="INFO")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str, **optional):
        c = sub.add_parser(name)
        for r in required:
            c.add_argument(f"--{r}", required=True)
        for o, default in optional.items():
            c.add_argument(f"--{o.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        return c

    command("create-index", "collection", "index", max_docs=0, stemmer="none", buckets=0)
    command("index-stats", "index", k1=bm25.K1, b=bm25.B)
    command("search", "index", "queries", "output", k=1000, k1=bm25.K1, b=bm25.B, tag="bm25")
    command("expand", "index", "collection", "queries", "output", model="rm3", terms=expansion.TERMS, feedback=expansion.FEEDBACK_DOCS)
    command("create-training-data", "index", "collection", "queries", "qrels", "vectors", "output", terms=expansion.TERMS, feedback=expansion.FEEDBACK_DOCS, dim=64, bm25_scope="collection", query_ids=None)
    command("train-weights", "training", "collection", "run", "vectors", "output", method="grid", metric="ndcg_cut_10", resolution=10, samples=1000, dim=64)
    command("evaluate", "qrels", "runs", "output", metrics=",".join(metrics.DEFAULT), baseline=None)
    command("cross-validate", "training", "collection", "run", "vectors", "output", folds=5, metric="ndcg_cut_10", resolution=10, dim=64)
    return p


def _objective_parts(spark, a):
    """Features, the parts of the candidates' scores, and judgments of a training set."""
    tables, _ = store.load_training_set(spark, a.training)
    importance.validate(tables["features"])
    run = trec.read_run(spark, a.run).select("qid", "doc_id", "rank", "score")
    features = tables["features"].withColumn("qid", F.col("qid").cast("string"))
    queries = tables["queries"].withColumn("qid", F.col("qid").cast("string"))
    qrels = tables["qrels"].withColumn("qid", F.col("qid").cast("string")).withColumn("doc_id", F.col("doc_id").cast("string"))
    features = crossval.aligned(features, queries, qrels, run)
    docs = records.collection(records.read(spark, a.collection)).withColumn("doc_id", F.col("doc_id").cast("string"))
    vectors = records.read(spark, a.vectors)
    encoder = similarity.table_encoder(vectors, vectors.count())
    tokens = T.token_rows(crossval.aligned(queries, features), "qid")
    candidates = crossval.aligned(run, features)
    sims = evaluation.similarities_of(features, candidates, tokens, docs, encoder)
    return features, shared.materialize(rerank.score_parts(candidates, tokens, features, sims), "parts")[0], qrels


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    log = files.setup_logging(a.log_level)
    spark = SparkSession.builder.appName(f"termloom-{a.command}").getOrCreate()
    with files.timed(a.command, spark):
        if a.command == "create-index":
            built = index.write_index(records.collection(records.read(spark, a.collection)), a.index, max_docs=a.max_docs or None, stemmed=a.stemmer == "porter", buckets=a.buckets or None)
            log.info("valid: %s", index.validate_index(built).first().asDict())
        elif a.command == "index-stats":
            log.info("%s", index.index_statistics(index.open_index(spark, a.index)).first().asDict() | index.index_settings(spark, a.index, a.k1, a.b).first().asDict())
        elif a.command == "search":
            queries = records.queries(records.read(spark, a.queries))
            own = index.open_index(spark, a.index)
            trec.write_run(bm25.search(own, own.query_terms(queries), a.k, a.k1, a.b), a.output, a.tag)
        elif a.command == "expand":
            docs, queries = records.collection(records.read(spark, a.collection)), records.queries(records.read(spark, a.queries))
            own = index.open_index(spark, a.index)
            expansion.expand_queries(own, docs, own.query_terms(queries), a.model, a.terms, feedback_docs=a.feedback).write.mode("overwrite").parquet(a.output)
        elif a.command == "create-training-data":
            docs, queries = records.collection(records.read(spark, a.collection)), records.queries(records.read(spark, a.queries))
            if a.query_ids:
                queries = records.only(queries, records.query_ids(spark, a.query_ids))
            own = index.open_index(spark, a.index)
            terms = own.query_terms(queries)
            vectors = records.read(spark, a.vectors)
            expanded, _ = shared.materialize(expansion.rm3(own, docs, terms, a.feedback, a.terms), "expansion")
            reference = bm25.search(own, terms, 1).select("qid", "doc_id")
            features = importance.extract_features(own, expanded, T.token_rows(queries, "qid"), similarity.table_encoder(vectors, vectors.count()), a.dim, a.bm25_scope, reference)
            store.save_training_set(spark, a.output, {"terms": a.terms}, queries=queries, qrels=trec.read_qrels(spark, a.qrels), features=features, expansion_terms=expanded, statistics=importance.feature_statistics(features))
        elif a.command == "train-weights":
            _, parts, qrels = _objective_parts(spark, a)
            if a.method == "lbfgs":
                found = optimize.LimitedMemoryBFGS().optimize_batches(optimize.batch_objective(parts, qrels, a.metric))
                weights, score = found.weights, found.score
            else:
                points = optimize.grid(resolution=a.resolution) if a.method == "grid" else optimize.Sampler(((0.1, 5.0),) * 3).points(a.samples)
                best = optimize.best_of(optimize.objective_scores(parts, optimize.weights_frame(spark, points), qrels, a.metric)).first()
                weights, score = (best["alpha"], best["beta"], best["gamma"]), best["score"]
            store.save_weights(spark, weights, a.output, {"metric": a.metric, "score": score})
            log.info("weights %s, %s %.4f", weights, a.metric, score)
        elif a.command == "evaluate":
            names, qrels = a.metrics.split(","), trec.read_qrels(spark, a.qrels)
            runs, order = None, []
            for part in a.runs.split(","):
                name, _, path = part.rpartition("=")
                order.append(name or path)
                run = trec.read_run(spark, path).withColumn("run_name", F.lit(name or path))
                runs = run if runs is None else runs.unionByName(run)
            results = metrics.evaluate(runs, qrels, names, ["run_name", "qid"]).persist()
            results.write.mode("overwrite").parquet(f"{a.output}/results")
            baseline = evaluation.baseline_of(order, a.baseline)
            evaluation.compare(results, baseline).write.mode("overwrite").parquet(f"{a.output}/comparison")
            evaluation.table(results, baseline, names).orderBy(F.col("is_baseline").desc(), "run_name").show(100, False)
        elif a.command == "cross-validate":
            features, parts, qrels = _objective_parts(spark, a)
            split, _ = shared.materialize(crossval.folds(features.select("qid").distinct(), a.folds), "folds")
            training = split.filter("split = 'training'").select("qid", F.col("fold").alias("group"))
            scores = optimize.objective_scores(parts, optimize.weights_frame(spark, optimize.grid(resolution=a.resolution)), qrels, a.metric, groups=training)
            best, _ = shared.materialize(crossval.best_weights_by_fold(scores), "best")
            final = crossval.aggregated_run(crossval.test_runs(parts, split, best))
            best.write.mode("overwrite").parquet(f"{a.output}/weights")
            trec.write_run(final, f"{a.output}/run", "cv")
            metrics.evaluate(final, qrels).show(20, False)
