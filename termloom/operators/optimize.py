"""Finding weights: grid, random and quasi-Newton search over a black-box objective.

The retrieval objective is a plan over a *frame of weights*: the parts of a score
(``rerank.score_parts``) are computed once and each weight vector is a weighted sum of
them, so a whole grid or sample is one job. The quasi-Newton search runs on the driver
and asks for the objective at a batch of points, a point's neighbours or the lengths of a
step, which is one job, too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import numbers as N
from termloom.operators import metrics

Weights = tuple[float, float, float]
Objective = Callable[[Weights], float]
BatchObjective = Callable[[Sequence[Weights]], list[float]]


def weights_frame(spark: SparkSession, points: Sequence[Weights]) -> DataFrame:
    """(weights_id, alpha, beta, gamma), numbered from 0 in the order given."""
    rows = [(i, *(float(x) for x in p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "weights_id int, alpha double, beta double, gamma double")


def grid(low: float = 0.1, high: float = 3.0, resolution: int = 10) -> list[Weights]:
    """All points, the last weight moving fastest."""
    axis = N.linspace(low, high, resolution)
    return list(product(axis, axis, axis))


class Sampler:
    """Uniform points; a second call continues the stream of the seed."""

    def __init__(self, bounds: Sequence[tuple[float, float]], seed: int = 42):
        self.bounds, self.random = list(bounds), np.random.RandomState(seed)

    def points(self, n: int) -> list[Weights]:
        low, high = np.array(self.bounds).T
        return [tuple(map(float, p)) for p in self.random.uniform(low, high, (n, len(self.bounds)))]


def objective_scores(parts: DataFrame, weights: DataFrame, qrels: DataFrame, metric: str = "ndcg_cut_10", top_k: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(weights_id, alpha, beta, gamma, [group,] score) of every row of ``weights`` in one job.

    ``parts`` are those of ``rerank.score_parts``, a row a query and candidate; the weights
    are few numbers and go to every task. ``groups`` (qid, group) splits the mean by group.
    nDCG at a cut leaves a query's task as one number a point (``ndcg_by_query``); other metrics,
    and runs cut at ``top_k``, need whole rankings and lay out a row a point and candidate.
    """
    cuts = tuple(int(x) for x in [metric.rsplit("_", 1)[-1]] if x.isdigit()) or (10,)
    if metric == f"ndcg_cut_{cuts[0]}" and top_k is None:
        by_query = ndcg_by_query(parts, weights, qrels, cuts[0])
    else:
        sums = sum((F.col(w) * F.col(f) for w, f in (("beta", "bm25_score"), ("gamma", "semantic_score"))), F.col("alpha") * F.col("rm_weight"))
        runs = parts.crossJoin(F.broadcast(weights)).withColumn("score", F.coalesce(F.col("base") + sums, F.col("first_score")))
        if top_k is not None:
            order = Window.partitionBy("weights_id", "qid").orderBy(F.round("score", 9).desc(), "doc_id")
            runs = runs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
        by_query = metrics.per_query(runs.select("weights_id", "qid", "doc_id", "score"), qrels, ["weights_id", "qid"], cuts)
    keys = ["weights_id"]
    if groups is not None:
        by_query, keys = by_query.join(groups, "qid"), ["weights_id", "group"]
    return by_query.groupBy(*keys).agg(N.rounded(F.avg(metric), 9).alias("score")).join(F.broadcast(weights), "weights_id")


#: Scores that a task holds at a time.
CELLS = 1 << 20


def ndcg_by_query(parts: DataFrame, weights: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(weights_id, qid, ndcg_cut_k): a query's candidates meet the points as a matrix, ``CELLS`` scores at a time.

    Only a query's candidates and one number a point pass between tasks, however many points there are.
    """
    rows = weights.select("weights_id", "alpha", "beta", "gamma").collect()  # a row a point
    ids, points = np.array([r[0] for r in rows], np.int32), np.array([tuple(r)[1:] for r in rows], float).reshape(-1, 3)
    judged = qrels.select("qid", "doc_id", F.greatest("rel", F.lit(0)).cast("double").alias("gain"))
    best = metrics.ideal(qrels, (k,)).select("qid", F.col(f"ideal_{k}").alias("best"))
    names = ["first_score", "base", "rm_weight", "bm25_score", "semantic_score"]
    held = parts.join(best, "qid").join(judged, ["qid", "doc_id"], "left")
    held = held.select("qid", F.col("doc_id").cast("string").alias("name"), F.coalesce("gain", F.lit(0.0)).alias("gain"), "best", *(F.col(n).cast("double").alias(n) for n in names))
    kind = parts.schema["qid"].dataType.simpleString()

    def values(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("name", "descending")]))
        of = {n: table.column(n).to_numpy().astype(float) for n in ("gain", "best", *names)}
        features = np.array([of[n] for n in names[2:]])
        found = np.zeros(len(points))
        if of["best"][0] > 0:
            step = max(1, CELLS // table.num_rows)
            for at in range(0, len(points), step):
                own = of["base"] + points[at : at + step] @ features
                first = _first(np.where(np.isnan(own), of["first_score"], own), k)
                found[at : at + step] = of["gain"][first] @ (1 / np.log2(np.arange(first.shape[1]) + 2)) / of["best"][0]
        qids = pa.repeat(table.column("qid")[0], len(points))
        return pa.Table.from_arrays([pa.array(ids), qids, pa.array(found)], names=["weights_id", "qid", f"ndcg_cut_{k}"])

    return held.groupBy("qid").applyInArrow(values, f"weights_id int, qid {kind}, ndcg_cut_{k} double")


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest of each row, in order: scores count with six decimals, equal ones in the order of columns."""
    rounded = np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5), scores)
    n, bits = scores.shape[1], scores.shape[1].bit_length()
    if n <= k or not np.abs(rounded).max() < 2.0 ** (62 - bits):
        return np.argsort(-rounded, axis=1, kind="stable")[:, :k]
    keys = -(rounded.astype(np.int64) << bits) + np.arange(n)  # no two are equal
    some = np.argpartition(keys, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(keys, some, axis=1), axis=1), axis=1)


def batch_objective(parts: DataFrame, qrels: DataFrame, metric: str = "ndcg_cut_10") -> BatchObjective:
    """The objective as a function of a list of points, a job each call."""
    spark = parts.sparkSession

    def values(points: Sequence[Weights]) -> list[float]:
        found = {r["weights_id"]: r["score"] for r in objective_scores(parts, weights_frame(spark, points), qrels, metric).collect()}  # a number a point
        return [float(found.get(i, float("-inf"))) for i in range(len(points))]

    return values


#: Parts of a line that are summed up on their own.
LINE_PARTS = 256


def line_scores(parts: DataFrame, qrels: DataFrame, start: Weights, direction: Weights, low: float = 0.1, high: float = 5.0, k: int = 10) -> DataFrame:
    """(t, until, score): the mean nDCG at k of the weights ``start + t * direction`` as steps from ``low`` to ``high``.

    A candidate's score is a line in t, so the ranking changes only where two lines cross, and
    nDCG only where one of them is relevant. The crossings of a query's relevant documents
    with its candidates, in order, give each one's rank as a running sum; the changes of
    all queries, in order, give the mean. Between the steps it is constant: nothing is sampled.
    Crossings are told apart to nine places; lines that coincide keep the order of their ids.
    """
    names = ("rm_weight", "bm25_score", "semantic_score")
    along = lambda w: sum((F.lit(float(x)) * F.col(n) for x, n in zip(w, names, strict=True)), F.lit(0.0))
    there = F.col("base").isNotNull()
    lines = parts.select("qid", "doc_id", F.when(there, F.col("base") + along(start)).otherwise(F.col("first_score")).alias("a"), F.when(there, along(direction)).otherwise(F.lit(0.0)).alias("b"))
    best = metrics.ideal(qrels, (k,)).filter(F.col(f"ideal_{k}") > 0).select("qid", (F.lit(1.0) / F.col(f"ideal_{k}")).alias("unit"))
    good = qrels.filter("rel > 0").join(best, "qid").select("qid", "doc_id", (F.col("rel") * F.col("unit")).alias("gain"))
    judged = lines.join(good, ["qid", "doc_id"]).select("qid", F.col("doc_id").alias("good_id"), "gain", F.col("a").alias("good_a"), F.col("b").alias("good_b"))
    pairs = lines.join(judged, "qid").filter(F.col("doc_id") != F.col("good_id"))
    d, slope = F.col("a") - F.col("good_a"), F.col("b") - F.col("good_b")
    pairs = pairs.withColumn("t", F.when(slope != 0, F.round(-d / slope, 9))).withColumn("up", F.when(slope > 0, 1).otherwise(-1))
    never = (d > 0) | ((d == 0) & (F.col("doc_id").cast("string") > F.col("good_id").cast("string")))
    ahead = F.when(slope == 0, never).when(slope > 0, F.col("t") <= low).otherwise(F.col("t") > low)
    key = ["qid", "good_id", "gain"]
    first = judged.select(*key).join(pairs.groupBy(*key).agg(F.sum(ahead.cast("long")).alias("before")), key, "left").select(*key, F.lit(float(low)).alias("t"), (F.coalesce("before", F.lit(0)) + 1).alias("moved"))
    moves = pairs.filter((F.col("t") > low) & (F.col("t") < high)).groupBy(*key, "t").agg(F.sum("up").cast("long").alias("moved"))
    order = Window.partitionBy(*key).orderBy("t")
    ranks = first.unionByName(moves).withColumn("rank", F.sum("moved").over(order))
    worth = F.when(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1.0)).otherwise(F.lit(0.0))
    worths = ranks.withColumn("worth", worth).withColumn("change", F.col("worth") - F.coalesce(F.lag("worth").over(order), F.lit(0.0)))
    n = parts.select("qid").distinct().join(qrels.select("qid").distinct(), "qid").agg(F.count("*").alias("n"))
    changes = worths.filter((F.col("change") != 0) | (F.col("t") == low)).groupBy("t").agg(F.sum("change").alias("change")).crossJoin(F.broadcast(n))  # one row
    changes = changes.select("t", (F.col("change") / F.col("n")).alias("change"), F.floor((F.col("t") - low) / ((high - low) / LINE_PARTS)).cast("int").alias("part"))
    every = Window.orderBy("part")  # a row for each part of the line
    sums = changes.groupBy("part").agg(F.sum("change").alias("sum"), F.min("t").alias("first"))
    sums = sums.select("part", (F.sum("sum").over(every) - F.col("sum")).alias("before"), F.lead("first").over(every).alias("next"))
    within = Window.partitionBy("part").orderBy("t")
    steps = changes.join(F.broadcast(sums), "part")
    return steps.select("t", F.coalesce(F.lead("t").over(within), "next", F.lit(float(high))).alias("until"), (F.col("before") + F.sum("change").over(within)).alias("score"))


def polished(parts: DataFrame, qrels: DataFrame, result: Result, low: float = 0.1, high: float = 5.0, k: int = 10, rounds: int = 2) -> Result:
    """A result moved to the best step of each coordinate in turn, as long as that is better.

    The steps are exact; a point is taken only if the objective itself is better there.
    """
    values = batch_objective(parts, qrels, f"ndcg_cut_{k}")
    weights, score, asked, history = result.weights, result.score, result.evaluations, list(result.history)
    for _ in range(rounds):
        before = score
        for axis in range(3):
            start = tuple(0.0 if i == axis else w for i, w in enumerate(weights))
            unit = tuple(float(i == axis) for i in range(3))
            steps = line_scores(parts, qrels, start, unit, low, high, k).filter(F.col("until") - F.col("t") > 1e-6)
            best = steps.orderBy(F.round("score", 9).desc(), "t").select("t", "until", "score").first()
            if best is None or best["score"] <= score + 1e-9:
                continue
            point = tuple((best["t"] + best["until"]) / 2 if i == axis else w for i, w in enumerate(weights))
            found = values([point])[0]
            asked += 1
            if found > score:
                weights, score = point, found
                history.append((point, found))
        if score <= before:
            break
    return Result(weights, score, asked, history)


def best_of(scores: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """The best row (of each group); of equals the first."""
    groups = groups or []
    order = Window.partitionBy(*groups).orderBy(F.col("score").desc(), "weights_id")
    if not groups:
        return scores.orderBy(F.col("score").desc(), "weights_id").limit(1)
    return scores.withColumn("i", F.row_number().over(order)).filter("i = 1").drop("i")


def compare_methods(scores: DataFrame, methods: DataFrame, train: str = "train", test: str = "test") -> DataFrame:
    """(method, weights_id, train_score, test_score): each method's best weights on ``train``, scored on ``test``.

    ``scores`` has weights_id, group and score; ``methods`` (method, weights_id) the points of each method.
    """
    of = lambda g: scores.filter(F.col("group") == g).select("weights_id", F.col("score").alias(f"{g}_score"))
    rows = methods.join(of(train), "weights_id").withColumn("score", F.col(f"{train}_score"))
    best = best_of(rows, ["method"]).drop("score")
    return best.join(of(test), "weights_id").select("method", "weights_id", F.col(f"{train}_score").alias("train_score"), F.col(f"{test}_score").alias("test_score"))


@dataclass
class Result:
    weights: Weights
    score: float
    evaluations: int
    history: list[tuple[Weights, float]] = field(default_factory=list)


def _safe(objective: Objective, point: Weights) -> float:
    """An objective that fails at a point makes that point the worst."""
    try:
        value = float(objective(point))
    except Exception:
        return float("-inf")
    return value if np.isfinite(value) else float("-inf")


def search_points(objective: Objective, points: Sequence[Weights]) -> Result:
    """The best of the points, the first of equals."""
    history = [(p, _safe(objective, p)) for p in points]
    if not history:
        raise ValueError("there are no points")
    best = max(history, key=lambda h: h[1])
    return Result(best[0], best[1], len(history), history)


@dataclass
class GridSearch:
    low: float = 0.1
    high: float = 3.0
    resolution: int = 10

    def optimize_weights(self, objective: Objective) -> Result:
        return search_points(objective, grid(self.low, self.high, self.resolution))


class RandomSearch:
    def __init__(self, n_samples: int = 1000, bounds: Sequence[tuple[float, float]] = ((0.1, 5.0),) * 3, seed: int = 42):
        self.n_samples, self.sampler = n_samples, Sampler(bounds, seed)

    def optimize_weights(self, objective: Objective) -> Result:
        return search_points(objective, self.sampler.points(self.n_samples))


@dataclass
class LimitedMemoryBFGS:
    """Projected quasi-Newton ascent with central differences inside a box.

    Ranking metrics are piecewise constant, so steps below ``step`` see nothing: the
    differences use that step, and a final search over neighbours polishes the point.
    """

    bounds: tuple[tuple[float, float], ...] = ((0.1, 5.0),) * 3
    max_iterations: int = 50
    tolerance: float = 1e-4
    step: float = 1e-2
    start: Weights = (1.0, 1.0, 1.0)

    def optimize_weights(self, objective: Objective, start: Weights | None = None) -> Result:
        return self.optimize_batches(lambda points: [_safe(objective, p) for p in points], start)

    def optimize_batches(self, objective: BatchObjective, start: Weights | None = None) -> Result:
        """The search over an objective of lists of points; each list is asked for at once."""
        low, high = np.array(self.bounds, float).T
        x = np.clip(np.array(start or self.start, float), low, high)
        history: list[tuple[Weights, float]] = []
        known: dict[Weights, float] = {}

        def ask(points: list[np.ndarray]) -> list[float]:
            keys = [tuple(map(float, p)) for p in points]
            if new := [p for p in dict.fromkeys(keys) if p not in known]:
                known.update(zip(new, objective(new), strict=True))
                history.extend((p, known[p]) for p in new)
            return [known[p] for p in keys]

        def around(p: np.ndarray) -> list[np.ndarray]:
            out = []
            for i in range(len(p)):
                for sign in (1, -1):
                    q = p.copy()
                    q[i] = np.clip(p[i] + sign * self.step, low[i], high[i])
                    out.append(q)
            return out

        def gradient(p: np.ndarray) -> np.ndarray:
            points = around(p)
            values = ask(points)
            out = np.zeros(len(p))
            for i in range(len(p)):
                width = points[2 * i][i] - points[2 * i + 1][i]
                up, down = values[2 * i], values[2 * i + 1]
                if width > 0 and np.isfinite(up) and np.isfinite(down):
                    out[i] = (up - down) / width
            return out

        ask([x, *around(x)])
        inverse = np.eye(len(x))
        best, g = ask([x])[0], gradient(x)
        for _ in range(self.max_iterations):
            free = ~(((x <= low) & (g < 0)) | ((x >= high) & (g > 0)))
            direction = np.where(free, inverse @ np.where(free, g, 0), 0)
            if direction @ g <= 0:
                inverse, direction = np.eye(len(x)), np.where(free, g, 0)
            if np.abs(direction).max(initial=0) < 1e-12:
                break
            line = [np.clip(x + 0.5**k * direction, low, high) for k in range(14)]
            values = ask(line)
            at = next((k for k, v in enumerate(values) if v > best), None)
            if at is None:
                break
            new, new_value = line[at], values[at]
            s, gain = new - x, new_value - best
            new_g = gradient(new)
            y = g - new_g
            if (sy := s @ y) > 1e-12:
                r = np.eye(len(x)) - np.outer(s, y) / sy
                inverse = r @ inverse @ r.T + np.outer(s, s) / sy
            x, best, g = new, new_value, new_g
            if gain < self.tolerance * max(abs(best), 1.0) and np.abs(np.where(free, g, 0)).max() < self.tolerance:
                break
        size = 10 * self.step
        while size >= self.step:
            near = [np.clip(x + size * np.array(d), low, high) for d in product((-1, 0, 1), repeat=len(x)) if any(d)]
            values = ask(near)
            if max(values) > best:
                best, x = max(values), near[int(np.argmax(values))]
            else:
                size /= 2
        return Result(tuple(map(float, x)), best, len(history), history)


OPTIMIZERS = {"lbfgs": LimitedMemoryBFGS, "grid": GridSearch, "random": RandomSearch}


def optimizer(name: str, **options):
    if name not in OPTIMIZERS:
        raise ValueError(f"unknown optimizer {name!r}; known: {sorted(OPTIMIZERS)}")
    return OPTIMIZERS[name](**options)


def multi_start(objective: Objective, starts: int = 5, low: float = 0.5, high: float = 2.0, seed: int = 42, **options) -> Result:
    """The best of several quasi-Newton searches from random points."""
    results = [LimitedMemoryBFGS(**options).optimize_weights(objective, p) for p in Sampler([(low, high)] * 3, seed).points(starts)]
    return max(results, key=lambda r: r.score)


def near_bounds(weights: DataFrame, low: float, high: float, margin: float = 0.01) -> DataFrame:
    """(weights_id, weight, value, at_bound) of each weight."""
    long = weights.select("weights_id", F.inline(F.array(*(F.struct(F.lit(n).alias("weight"), F.col(n).alias("value")) for n in ("alpha", "beta", "gamma")))))
    return long.withColumn("at_bound", (F.col("value") - low < margin) | (high - F.col("value") < margin))


def train(objective: Objective, method: str = "lbfgs", **options) -> dict:
    """Baseline at (1, 1, 1), the optimum and the improvement."""
    baseline = _safe(objective, (1.0, 1.0, 1.0))
    result = optimizer(method, **options).optimize_weights(objective)
    pct = (result.score - baseline) / baseline * 100 if baseline > 0 else 0.0
    return {"weights": result.weights, "baseline": baseline, "score": result.score, "improvement_pct": pct, "evaluations": result.evaluations}
