"""Importance, reranking and the search for weights."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import numbers as N
from termloom.functions import vectors as V
from termloom.operators import crossval, importance, metrics, optimize, rerank, similarity

TARGET = (1.2, 0.8, 1.5)


def quadratic(p):
    return max(0.0, 1 - 0.07 * sum((a - b) ** 2 for a, b in zip(p, TARGET, strict=True)))


def test_lbfgs_converges_and_stays_inside():
    assert np.allclose(optimize.optimizer("lbfgs").optimize_weights(quadratic).weights, TARGET, atol=0.1)
    inside = optimize.LimitedMemoryBFGS(bounds=((0.5, 1.5),) * 3).optimize_weights(lambda p: -sum((a - b) ** 2 for a, b in zip(p, (2.0, 0.3, 3.0), strict=True)))
    assert np.allclose(inside.weights, (1.5, 0.5, 1.5), atol=0.02) and all(0.5 <= x <= 1.5 for x in inside.weights)


def test_grid_takes_the_first_of_the_best():
    assert optimize.optimizer("grid", low=0.0, high=1.0, resolution=3).optimize_weights(quadratic).weights == (1.0, 1.0, 1.0)
    assert optimize.GridSearch(0.5, 2.0, 5).optimize_weights(quadratic).weights == (1.25, 0.875, 1.625)
    assert optimize.GridSearch(0.5, 1.5, 3).optimize_weights(lambda p: 0.0).weights == (0.5, 0.5, 0.5)


def test_random_search_repeats_and_continues():
    first, again = (optimize.RandomSearch(50, seed=42).optimize_weights(quadratic) for _ in range(2))
    assert first.weights == again.weights and first.score == max(s for _, s in first.history)
    sampler = optimize.Sampler(((0, 1),) * 3, 1)
    assert sampler.points(2) != sampler.points(2)


def test_failing_objectives_lose():
    def broken(p):
        if p[0] > 0.5:
            raise RuntimeError("no")
        return p[0]

    assert optimize.GridSearch(0.0, 1.0, 3).optimize_weights(broken).weights[0] == 0.5
    with pytest.raises(ValueError):
        optimize.optimizer("simplex")


def test_defaults():
    assert optimize.LimitedMemoryBFGS().bounds == ((0.1, 5.0),) * 3 and optimize.LimitedMemoryBFGS().max_iterations == 50
    assert optimize.GridSearch().resolution == 10 and optimize.RandomSearch().n_samples == 1000


def test_multi_start_and_train():
    assert np.allclose(optimize.multi_start(quadratic, 2).weights, TARGET, atol=0.1)
    told = optimize.train(quadratic, "grid", resolution=4)
    assert told["score"] >= told["baseline"] and told["improvement_pct"] >= 0


FEATURES = [("q", 1, "machine", 0.8, 2.1, 0.7), ("q", 2, "other", 0.1, None, 0.5)]
SCHEMA = "qid string, rank int, term string, rm_weight double, bm25_score double, semantic_score double"


def test_importance_by_hand(spark):
    rows = importance.weighted(spark.createDataFrame(FEATURES, SCHEMA), *TARGET).orderBy("rank").collect()
    assert rows[0].importance == pytest.approx(3.69) and rows[1].importance == pytest.approx(0.12 + 0.75)
    with pytest.raises(ValueError):
        importance.model("magic")
    with pytest.raises(ValueError):
        importance.validate(spark.createDataFrame(FEATURES, SCHEMA))
    with pytest.raises(ValueError):
        importance.validate(spark.createDataFrame([], SCHEMA))


def test_ablation_has_eight_models(spark):
    own = importance.ablation_importance(spark.createDataFrame(FEATURES[:1], SCHEMA), importance.ablation_weights(spark, *TARGET))
    got = {r.model: r.importance for r in own.collect()}
    assert len(got) == 8 and got["uniform"] == 1 and got["rm_only"] == 0.8 and got["our_method"] == pytest.approx(3.69) and got["rm_bm25"] == pytest.approx(2.64)


def test_cosine_edges(spark):
    row = spark.sql("SELECT array(0d, 0d) z, array(1d, 0d) a, array(-1d, 0d) b, array(3d, 4d) c").select(
        V.cosine(F.col("z"), F.col("a")).alias("zero"), V.cosine(F.col("a"), F.col("b")).alias("opposite"), V.cosine(F.col("a"), F.col("c")).alias("some"), V.euclidean(F.col("a"), F.col("b")).alias("far")
    ).first()
    assert tuple(row) == (0, 0, pytest.approx(0.6), 2)


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_pairs_by_blocks_have_the_values_of_columns(spark, monkeypatch, metric, few):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    monkeypatch.setattr(similarity, "STRIP", 2)
    monkeypatch.setattr(similarity, "FEW_QUERIES", few)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).astype("float32").tolist()) for i in range(40)]
    rows += [(3, [0.5] * 5), (None, [-1.0] * 5), (50, [0.0] * 5), (51, None), (52, [1.0, None, 1.0, 1.0, 1.0]), (53, [1.0, 2.0]), (54, []), (55, [float("nan")] * 5), (56, [float("inf")] * 5), (57, [2e3, -3.25, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = vectors.filter("vec_id % 5 = 0 or vec_id > 50")
    pairs = vectors.select("vec_id", V.doubles(F.col("embedding")).alias("b")).crossJoin(asked.select(F.col("vec_id").alias("query_id"), V.doubles(F.col("embedding")).alias("a")))
    column = {"cosine": V.cosine, "dot": V.dot, "euclidean": V.euclidean}[metric](F.col("a"), F.col("b"))
    want = pairs.select("query_id", "vec_id", N.rounded(column).alias("value"))
    got = similarity.pairs(asked, vectors, metric)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.dtypes == want.dtypes
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()  # which are not compiled
    assert similarity.pairs(asked.filter("false"), vectors, metric).count() == similarity.pairs(asked, vectors.filter("false"), metric).count() == 0


VECTORS = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.6, 0.8]}


def fixed(terms):
    rows = terms.sparkSession.createDataFrame(list(VECTORS.items()), "term string, vec array<double>")
    return terms.select("term").distinct().join(rows, "term")


def test_maxsim_by_hand(spark):
    """Query a, b and the expansion term a with weight 2 against the document a c: 1 + 0.8 + 2."""
    docs = spark.createDataFrame([(1, "a c"), (2, "nothing known")], "doc_id long, text string")
    query = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b"), ("q", 2, "unknown")], "qid string, pos int, term string")
    own = spark.createDataFrame([("q", 1, "a", 2.0), ("q", 2, "b", 0.0)], "qid string, rank int, term string, importance double")
    candidates = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.4)], "qid string, doc_id long, score double")
    got = {r.doc_id: r.score for r in rerank.rerank(candidates, query, own, docs, fixed).collect()}
    assert got[1] == pytest.approx(3.8) and got[2] == pytest.approx(0.4)
    whole = spark.createDataFrame([(1, [9.0, 9.0]), (2, [0.0, 3.0])], "doc_id long, vec array<double>")
    got = {r.doc_id: r.score for r in rerank.rerank(candidates, query, own, docs, fixed, sentences=whole).collect()}
    assert got[1] == pytest.approx(3.8) and got[2] == pytest.approx(3.0)  # 2 takes its own vector: a 0, b 3, a 0
    info = rerank.model_info(rerank.query_vectors(query, own, fixed), candidates).first()
    assert tuple(info) == (1, 3, 3, 2, 2, 64, 512)
    parts = rerank.explain(rerank.query_vectors(query, own, fixed)).first()
    assert parts.own_terms == ["a", "b"] and parts.expansion_terms == ["a"] and parts.n_vectors == 3


def test_vector_cap(spark):
    query = spark.createDataFrame([("q", i, "abc"[i % 3]) for i in range(40)], "qid string, pos int, term string")
    own = spark.createDataFrame([("q", i, "abc"[i % 3], 1.0) for i in range(1, 41)], "qid string, rank int, term string, importance double")
    rows = rerank.query_vectors(query, own, fixed).collect()
    assert len(rows) == 64 and sum(r.part == 0 for r in rows) == 32


def test_factorised_scores_are_linear_in_importance(spark):
    docs = spark.createDataFrame([(1, "a c"), (2, "b c")], "doc_id long, text string")
    query = spark.createDataFrame([("q", 0, "a")], "qid string, pos int, term string")
    candidates = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.4)], "qid string, doc_id long, score double")

    def scores(w):
        own = spark.createDataFrame([("q", 1, "b", w)], "qid string, rank int, term string, importance double")
        return np.array([r.score for r in rerank.rerank(candidates, query, own, docs, fixed).orderBy("doc_id").collect()])

    assert np.allclose(scores(2.0) - scores(1.0), scores(3.0) - scores(2.0))


def test_score_parts_give_what_reranking_gives(spark):
    docs = spark.createDataFrame([(1, "a c"), (2, "b c"), (3, "nothing known")], "doc_id long, text string")
    tokens = spark.createDataFrame([("q", 0, "a"), ("q", 1, "c")], "qid string, pos int, term string")
    candidates = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.4), ("q", 3, 0.3)], "qid string, doc_id long, score double")
    rows = spark.createDataFrame([("q", 1, "b", 0.8, 2.1, 0.7), ("q", 2, "c", 0.1, None, 0.5)], SCHEMA)
    asked = tokens.select("qid", "term").unionByName(rows.select("qid", "term"))
    sims = rerank.term_similarities(candidates, asked, docs, fixed)
    parts = rerank.score_parts(candidates, tokens, rows, sims)
    for weights in (TARGET, (0.0, 1.0, 0.0), (0.1, 5.0, 2.0)):
        want = {r.doc_id: r.score for r in rerank.rerank(candidates, tokens, importance.weighted(rows, *weights), docs, fixed).collect()}
        a, b, g = weights
        got = {r.doc_id: r.first_score if r.base is None else r.base + a * r.rm_weight + b * r.bm25_score + g * r.semantic_score for r in parts.collect()}
        assert got == pytest.approx(want)
    many = spark.createDataFrame([("q", i, "abc"[i % 3], 0.1, 0.1, 0.1) for i in range(33)], SCHEMA)
    with pytest.raises(Exception, match="more than 32"):
        rerank.score_parts(candidates, tokens, many, sims).collect()


def test_objective_and_searches_against_plain_sums(spark):
    rng = np.random.default_rng(3)
    parts = [(f"q{q}", d, 0.0, *map(float, rng.random(4))) for q in range(4) for d in range(12)]
    frame = spark.createDataFrame(parts, "qid string, doc_id long, first_score double, base double, rm_weight double, bm25_score double, semantic_score double")
    qrels = [(f"q{q}", int(d), int(r)) for q in range(4) for d, r in zip(rng.choice(12, 4, replace=False), (2, 1, 1, 0))]
    judged = spark.createDataFrame(qrels, "qid string, doc_id long, rel int")
    rel = {(q, d): r for q, d, r in qrels}

    def plain(point):
        out = []
        for q in ("q0", "q1", "q2", "q3"):
            own = sorted(((round(b + point[0] * x + point[1] * y + point[2] * z, 6), str(d), d) for q_, d, _, b, x, y, z in parts if q_ == q), reverse=True)[:10]
            dcg = sum(rel.get((q, d), 0) / np.log2(i + 2) for i, (_, _, d) in enumerate(own))
            best = sorted((r for (q_, _), r in rel.items() if q_ == q), reverse=True)
            out.append(dcg / sum(r / np.log2(i + 2) for i, r in enumerate(best)))
        return float(np.mean(out))

    points = optimize.grid(0.1, 3.0, 3)
    got = {r.weights_id: r.score for r in optimize.objective_scores(frame, optimize.weights_frame(spark, points), judged).collect()}
    assert [got[i] for i in range(27)] == pytest.approx([plain(p) for p in points], abs=1e-8)
    general = {r.weights_id: r.score for r in optimize.objective_scores(frame, optimize.weights_frame(spark, points), judged, "recip_rank").collect()}
    assert len(general) == 27
    search = optimize.LimitedMemoryBFGS(max_iterations=5)
    by_jobs, by_hand = search.optimize_batches(optimize.batch_objective(frame, judged)), search.optimize_weights(plain)
    assert by_jobs.weights == pytest.approx(by_hand.weights) and by_jobs.score == pytest.approx(plain(by_jobs.weights), abs=1e-8)
    split = crossval.folds(frame.select("qid").distinct(), 2)
    best = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 0.0, 2.0)], "fold int, alpha double, beta double, gamma double")
    runs = {(r.qid, r.doc_id): r.score for r in crossval.test_runs(frame, split, best).collect()}
    own = {r.qid: r.fold for r in split.filter("split = 'testing'").collect()}
    assert runs == pytest.approx({(q, d): b + (x if own[q] == 0 else 2 * z) for q, d, _, b, x, _, z in parts})


def test_encoder_from_a_function(spark):
    terms = spark.createDataFrame([("aa",), ("b",), (None,), ("b",)], "term string")
    got = {r.term: r.vec for r in similarity.udf_encoder(lambda ts: [[float(len(t))] for t in ts], 1)(terms).collect()}
    assert got == {"aa": [2.0], "b": [1.0]}


def test_folds_cover_each_query_once(spark):
    queries = spark.createDataFrame([(str(i),) for i in range(11)] + [("x",)], "qid string")
    split = crossval.folds(queries, 3)
    assert split.filter("split = 'testing'").count() == 12 and split.count() == 36
    own = crossval.folds_from_assignment(spark.createDataFrame([("f1", "a"), ("f2", "b")], "fold string, qid string")).collect()
    assert {tuple(r) for r in own} == {("f1", "testing", "a"), ("f1", "training", "b"), ("f2", "testing", "b"), ("f2", "training", "a")}


def test_alignment(spark):
    a, b = (spark.createDataFrame([(q,) for q in qs], "qid string") for qs in ("xy", "yz"))
    got = {r.qid: (r.complete, r.missing) for r in crossval.alignment(a=a, b=b).collect()}
    assert got == {"x": (False, "b"), "y": (True, ""), "z": (False, "a")}
    assert [r.qid for r in crossval.aligned(a, b).collect()] == ["y"]


def test_describe_one_row(spark):
    row = spark.sql("SELECT 2d AS x").agg(*N.describe(F.col("x"))).first()
    assert tuple(row) == (1, 2, 2, 2, 2, 0)


def _random_parts(spark, seed):
    rng = np.random.RandomState(seed)
    rows = [(q, d, float(rng.rand()), None if d == 3 else float(rng.rand()), *(float(x) for x in rng.rand(3))) for q in range(4) for d in range(12)]
    rows += [(0, 50 + i, 0.5, 0.4, 0.3, 0.2, 0.1) for i in range(3)]  # equal copies
    parts = spark.createDataFrame(rows, "qid int, doc_id int, first_score double, base double, rm_weight double, bm25_score double, semantic_score double")
    judged = [(0, 51, 2), (0, 1, 1), (0, 4, 0), (1, 3, 1), (1, 7, 2), (2, 0, 1), (2, 99, 2), (3, 5, 0), (8, 1, 1)]
    return parts, spark.createDataFrame(judged, "qid int, doc_id int, rel int")


@pytest.mark.parametrize(("start", "direction", "k"), [((0.0, 0.8, 1.5), (1.0, 0.0, 0.0), 8), ((1.0, 1.0, 1.0), (0.5, -0.2, 0.0), 10), ((0.2, 0.0, 0.3), (0.0, 1.0, 0.0), 5), ((0.0, 0.8, 1.5), (1.0, 0.0, 0.0), 1)])
def test_steps_of_a_line_are_the_objective_between_them(spark, start, direction, k):
    parts, qrels = _random_parts(spark, 7)
    steps = sorted(map(tuple, optimize.line_scores(parts, qrels, start, direction, 0.1, 5.0, k).collect()))
    assert steps[0][0] == 0.1 and steps[-1][1] == 5.0 and all(a[1] == b[0] for a, b in zip(steps, steps[1:], strict=False))
    wide = [s for s in steps if s[1] - s[0] > 1e-4]
    assert len(wide) > (2 if k >= 8 else 0)
    points = [tuple(a + (t + u) / 2 * b for a, b in zip(start, direction, strict=True)) for t, u, _ in wide]
    found = {r.weights_id: r.score for r in optimize.objective_scores(parts, optimize.weights_frame(spark, points), qrels, f"ndcg_cut_{k}").collect()}
    assert [s[2] for s in wide] == pytest.approx([found[i] for i in range(len(wide))], abs=1e-8)


def test_a_polished_result_is_the_best_of_its_coordinates(spark):
    parts, qrels = _random_parts(spark, 9)
    values = optimize.batch_objective(parts, qrels, "ndcg_cut_3")
    first = (1.0, 1.0, 1.0)
    got = optimize.polished(parts, qrels, optimize.Result(first, values([first])[0], 1), k=3, rounds=4)
    assert got.score >= values([first])[0] and got.score == pytest.approx(values([got.weights])[0])
    for axis in range(3):
        tried = [tuple(x if i == axis else w for i, w in enumerate(got.weights)) for x in np.linspace(0.1, 5.0, 40)]
        assert max(values(tried)) <= got.score + 1e-9


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_many_points_lay_out_no_row_a_point_and_candidate(spark, monkeypatch, cells):
    monkeypatch.setattr(optimize, "CELLS", cells)
    parts, qrels = _random_parts(spark, 5)
    points = optimize.weights_frame(spark, [*optimize.grid(0.1, 3.0, 3), (-1.0, -2.0, 0.0)])
    scores = optimize.objective_scores(parts, points, qrels, "ndcg_cut_3")
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Window" not in plan.split("FlatMapGroupsInArrow")[0]
    total = F.coalesce(F.expr("base + alpha * rm_weight + beta * bm25_score + gamma * semantic_score"), F.col("first_score"))
    runs = parts.crossJoin(points).select("weights_id", "qid", "doc_id", total.alias("score"))
    for k in (1, 3, 100):
        want = {(r[0], r[1]): r[2] for r in metrics.ndcg_cut(runs, qrels, ["weights_id", "qid"], k).collect()}
        got = {(r[0], r[1]): r[2] for r in optimize.ndcg_by_query(parts, points, qrels, k).collect()}
        assert got == pytest.approx(want) and len(want) == 28 * 4
