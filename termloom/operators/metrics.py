"""Ranking metrics in one pass over a run and its judgments.

Conventions of the usual evaluation tool: scores count with six decimals, ties go to
the larger document id as a string, the run's own ranks are ignored; a document is
relevant from rel 1 on; gains are linear and discounted by log2(rank + 1), the ideal
ranks all judged documents; only queries in both run and judgments are evaluated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 5, 10, 20, 100, 1000)
LEVELS = tuple(i / 10 for i in range(11))
DEFAULT = ("map", "ndcg_cut_10", "ndcg_cut_100", "recip_rank", "recall_100")


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def judged(run: DataFrame, qrels: DataFrame, keys: list[str]) -> DataFrame:
    """The run with its rank, judgment and running number of relevant documents."""
    evaluated = run.join(qrels.select("qid").distinct(), "qid", "left_semi")
    rows = evaluated.withColumn("score_", F.round("score", 6)).join(qrels.select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left")
    order = Window.partitionBy(*keys).orderBy(F.col("score_").desc(), F.col("doc_id").cast("string").desc())
    hit = (F.coalesce("rel", F.lit(0)) >= 1).cast("int")
    numbered = rows.withColumn("rank", F.row_number().over(order)).withColumn("hit", hit)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bad = (F.col("rel").isNotNull() & (F.col("rel") < 1)).cast("int")
    return numbered.withColumn("hits", F.sum("hit").over(so_far)).withColumn("bad", bad).withColumn("bads", F.sum(bad).over(so_far))


def ideal(qrels: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """By query: relevant documents, judged non-relevant ones, and ideal gains at each cut."""
    order = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id")
    gain = F.greatest(F.col("rel"), F.lit(0)) / F.log2(F.row_number().over(order) + 1.0)
    rows = qrels.withColumn("place", F.row_number().over(order)).withColumn("gain", gain)
    at = [F.sum(F.when(F.col("place") <= k, F.col("gain")).otherwise(0.0)).alias(f"ideal_{k}") for k in cuts]
    positive = F.sum((F.col("rel") >= 1).cast("long"))
    return rows.groupBy("qid").agg(positive.alias("n_rel"), (F.count("*") - positive).alias("n_nonrel"), F.sum("gain").alias("ideal"), *at)


def per_query(run: DataFrame, qrels: DataFrame, keys: list[str] | None = None, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(keys..., one column a metric) for each evaluated query; ``keys`` holds qid and for instance run_name."""
    keys = keys or ["qid"]
    rows = judged(run, qrels, keys).join(ideal(qrels, cuts), "qid")
    hit, rank = F.col("hit"), F.col("rank")
    gain = F.when(F.col("rel") > 0, F.col("rel")).otherwise(0) / F.log2(rank + 1.0)
    precision = F.col("hits") / rank
    within = lambda k, c: F.sum(F.when(rank <= k, c).otherwise(0))
    sums = [F.first(c).alias(c) for c in ("n_rel", "n_nonrel", "ideal", *(f"ideal_{k}" for k in cuts))]
    sums += [F.count("*").alias("n_ret"), F.sum(hit).alias("n_hit"), F.min(F.when(hit == 1, rank)).alias("first_hit"), F.sum(gain).alias("dcg"), F.sum(hit * precision).alias("ap")]
    sums += [within(k, hit).alias(f"hit_{k}") for k in cuts] + [within(k, gain).alias(f"dcg_{k}") for k in cuts] + [within(k, hit * precision).alias(f"ap_{k}") for k in cuts]
    sums += [F.sum(F.when(rank <= F.col("n_rel"), hit).otherwise(0)).alias("hit_r")]
    least = F.least(F.col("n_rel"), F.col("n_nonrel"))
    spoiled = F.least(F.col("bads"), F.col("n_rel"))
    sums += [F.sum(F.when(hit == 1, F.when(F.col("bads") > 0, 1.0 - spoiled / least).otherwise(1.0)).otherwise(0.0)).alias("pref")]
    for x in LEVELS:
        reached = F.col("hits") >= F.greatest(F.ceil(F.round(x * F.col("n_rel"), 9)), F.lit(1))
        sums.append(F.max(F.when(reached, precision).otherwise(0.0)).alias(f"ip_{x:.1f}"))
    g = rows.groupBy(*keys).agg(*sums)
    set_p, set_r = _over(F.col("n_hit"), F.col("n_ret")), _over(F.col("n_hit"), F.col("n_rel"))
    out: list[Column] = [
        F.col("n_ret").cast("double").alias("num_ret"),
        F.col("n_rel").cast("double").alias("num_rel"),
        F.col("n_hit").cast("double").alias("num_rel_ret"),
        _over(F.col("ap"), F.col("n_rel")).alias("map"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("recip_rank"),
        _over(F.col("dcg"), F.col("ideal")).alias("ndcg"),
        _over(F.col("hit_r"), F.col("n_rel")).alias("Rprec"),
        _over(F.col("pref"), F.col("n_rel")).alias("bpref"),
        set_p.alias("set_P"),
        set_r.alias("set_recall"),
        _over(2.0 * set_p * set_r, set_p + set_r).alias("set_F"),
        (reduce(lambda a, b: a + b, (F.col(f"`ip_{x:.1f}`") for x in LEVELS)) / 11.0).alias("11pt_avg"),
    ]
    for k in cuts:
        out += [
            (F.col(f"hit_{k}") / float(k)).alias(f"P_{k}"),
            _over(F.col(f"hit_{k}"), F.col("n_rel")).alias(f"recall_{k}"),
            _over(F.col(f"dcg_{k}"), F.col(f"ideal_{k}")).alias(f"ndcg_cut_{k}"),
            _over(F.col(f"ap_{k}"), F.col("n_rel")).alias(f"map_cut_{k}"),
            (F.col(f"hit_{k}") > 0).cast("double").alias(f"success_{k}"),
        ]
    out += [F.col(f"`ip_{x:.1f}`").alias(f"iprec_at_recall_{x:.2f}".replace(".", "_")) for x in LEVELS]
    return g.select(*keys, *out)


def ndcg_cut(run: DataFrame, qrels: DataFrame, keys: list[str], k: int, top_k: int | None = None) -> DataFrame:
    """(keys..., ndcg_cut_k) alone: only the k first of a query pass on, so many runs cost little.

    ``top_k`` is the depth of the run, which is ranked by scores of nine decimals.
    """
    evaluated = run.join(qrels.select("qid").distinct(), "qid", "left_semi")
    if top_k is not None:
        depth = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "doc_id")
        evaluated = evaluated.withColumn("depth_", F.row_number().over(depth)).filter(F.col("depth_") <= top_k).drop("depth_")
    order = Window.partitionBy(*keys).orderBy(F.round("score", 6).desc(), F.col("doc_id").cast("string").desc())
    first = evaluated.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    rows = first.join(qrels.select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left")
    gain = F.when(F.col("rel") > 0, F.col("rel")).otherwise(0) / F.log2(F.col("rank") + 1.0)
    sums = rows.groupBy(*keys).agg(F.sum(gain).alias("dcg"))
    return sums.join(ideal(qrels, (k,)).select("qid", f"ideal_{k}"), "qid").select(*keys, _over(F.col("dcg"), F.col(f"ideal_{k}")).alias(f"ndcg_cut_{k}"))


def supported(cuts: tuple[int, ...] = CUTS) -> list[str]:
    names = ["num_ret", "num_rel", "num_rel_ret", "map", "gm_map", "recip_rank", "ndcg", "Rprec", "bpref", "set_P", "set_recall", "set_F", "11pt_avg"]
    return names + [f"{m}_{k}" for k in cuts for m in ("P", "recall", "ndcg_cut", "map_cut", "success")] + [f"iprec_at_recall_{x:.2f}".replace(".", "_") for x in LEVELS]


def evaluate(run: DataFrame, qrels: DataFrame, metrics: tuple[str, ...] | list[str] = DEFAULT, keys: list[str] | None = None) -> DataFrame:
    """(keys without qid..., metric, value): means over evaluated queries; sums for num_*; unknown names give 0."""
    keys = keys or ["qid"]
    groups = [k for k in keys if k != "qid"]
    cuts = tuple(sorted({int(m.rsplit("_", 1)[1]) for m in metrics if m.rsplit("_", 1)[-1].isdigit() and not m.startswith("iprec")} | {10}))
    known = set(supported(cuts))
    rows = per_query(run, qrels, keys, cuts)

    def value(m: str) -> Column:
        if m not in known:
            return F.lit(0.0)
        if m == "gm_map":
            return F.exp(F.avg(F.log(F.greatest(F.col("map"), F.lit(1e-5)))))
        return F.sum(f"`{m}`") if m.startswith("num_") else F.avg(f"`{m}`")

    means = rows.groupBy(*groups).agg(*(F.coalesce(value(m), F.lit(0.0)).alias(f"m{i}") for i, m in enumerate(metrics)), F.count("*").alias("n_"))
    long = F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"m{i}").alias("value")) for i, m in enumerate(metrics))))
    return means.select(*groups, long)
