"""Metrics against known values."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from termloom.operators import evaluation, metrics

QRELS = [("query1", "doc1", 2), ("query1", "doc2", 1), ("query1", "doc3", 0), ("query2", "doc4", 2), ("query2", "doc5", 0), ("query2", "doc6", 1)]
RUNS = [
    ("baseline", "query1", "doc2", 0.8), ("baseline", "query1", "doc3", 0.7), ("baseline", "query1", "doc1", 0.6),
    ("baseline", "query2", "doc4", 0.85), ("baseline", "query2", "doc6", 0.75), ("baseline", "query2", "doc5", 0.65),
    ("improved", "query1", "doc1", 0.9), ("improved", "query1", "doc2", 0.8), ("improved", "query1", "doc3", 0.7),
    ("improved", "query2", "doc4", 0.95), ("improved", "query2", "doc6", 0.85), ("improved", "query2", "doc5", 0.75),
]


@pytest.fixture(scope="module")
def qrels(spark):
    return spark.createDataFrame(QRELS, "qid string, doc_id string, rel int")


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(RUNS, "run_name string, qid string, doc_id string, score double")


def values(df):
    return {(r.run_name, r.metric): r.value for r in df.collect()}


def test_known_values(runs, qrels):
    got = values(metrics.evaluate(runs, qrels, ["map", "ndcg_cut_10", "P_1", "recip_rank", "nonsense"], ["run_name", "qid"]))
    assert got["improved", "map"] == 1.0 and got["baseline", "map"] == pytest.approx(11 / 12)
    assert got["baseline", "ndcg_cut_10"] == pytest.approx(0.88009, abs=1e-5) and got["improved", "ndcg_cut_10"] == pytest.approx(1)
    assert got["baseline", "P_1"] == got["baseline", "recip_rank"] == 1 and got["improved", "nonsense"] == 0


def test_improvement(runs, qrels):
    results = metrics.evaluate(runs, qrels, ["map"], ["run_name", "qid"])
    row = evaluation.compare(results, "baseline").first()
    assert row.improvement_abs == pytest.approx(0.0833, abs=1e-4) and row.improvement_pct == pytest.approx(9.09, abs=0.005)
    assert evaluation.baseline_of(["a", "b"], "c") == "a" and evaluation.baseline_of(["a", "b"], "b") == "b"
    cells = {r.run_name: r["map"] for r in evaluation.table(results, "baseline", ["map"]).collect()}
    assert cells == {"baseline": "0.9167", "improved": "1.0000 (+0.0833)"}


def test_empty_inputs_give_zero(spark, runs, qrels):
    one = runs.filter("run_name = 'baseline'").drop("run_name")
    for run, q in ((one.limit(0), qrels), (one, qrels.limit(0))):
        assert [r.value for r in metrics.evaluate(run, q, ["map", "num_ret", "gm_map"]).collect()] == [0, 0, 0]


def test_ties_go_to_the_larger_id(spark):
    run = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0000001)], "qid string, doc_id string, score double")
    qrels = spark.createDataFrame([("q", "b", 1)], "qid string, doc_id string, rel int")
    assert metrics.per_query(run, qrels).first().recip_rank == 1


def brute_ap(ranking, rel):
    hits, total = 0, 0.0
    for i, d in enumerate(ranking, 1):
        if rel.get(d, 0) >= 1:
            hits += 1
            total += hits / i
    n = sum(x >= 1 for x in rel.values())
    return total / n if n else 0.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(-1, 3)), min_size=1, max_size=10, unique_by=lambda x: x[0]), st.permutations(range(10)))
def test_metrics_stay_in_bounds_and_agree_with_brute_force(spark, judged, ranking):
    rel = {f"d{d}": x for d, x in judged}
    run = spark.createDataFrame([("q", f"d{d}", float(10 - i)) for i, d in enumerate(ranking)], "qid string, doc_id string, score double")
    qrels = spark.createDataFrame([("q", d, x) for d, x in rel.items()], "qid string, doc_id string, rel int")
    row = metrics.per_query(run, qrels).first().asDict()
    assert row["map"] == pytest.approx(brute_ap([f"d{d}" for d in ranking], rel))
    assert all(-1e-9 <= v <= 1 + 1e-9 for k, v in row.items() if k != "qid" and not k.startswith("num_"))


def test_ideal_run_has_ndcg_1(spark, qrels):
    ideal = qrels.selectExpr("qid", "doc_id", "cast(rel as double) score")
    assert all(r.ndcg == pytest.approx(1) for r in metrics.per_query(ideal, qrels).collect())


def test_significance(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "qid int, map double")
    b = spark.createDataFrame([(1, 0.2), (2, 0.4), (3, 0.3)], "qid int, map double")
    row = evaluation.significance(a, b, "map").first()
    assert (row.n, row.better, row.worse, row.equal) == (3, 2, 0, 1) and row.t == pytest.approx(1.732051, abs=1e-5)
