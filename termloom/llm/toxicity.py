"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every document is unlabelled (the
labels 0 are not used as negatives). A linear classifier over hashed words is fitted
with numpy by the class-prior-corrected risk

    pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1)),

whose second term cannot go below zero (where it would, the step goes the other way).
The class prior pi is the share of positives among the labelled training rows.

The fit uses bounded samples: ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED``
unlabelled documents, chosen by a hash of id and text. Of the 2^18 word bins only
``N_FEATURES`` with the largest margin between both samples get a weight.

The bias is then moved so that ``CALLED_SHARE`` of the prior's part of the unlabelled
sample scores at least 0.5.

Defined cases: null or empty texts have no features and get the score of the bias
alone (below 0.5); without positives every score is 0. Repeated rows are scored alike;
very long texts are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import common

BITS = 18
MAX_POSITIVE = 4000
MAX_UNLABELLED = 8000
N_FEATURES = 512
STEPS = 1500
#: Of the documents that are toxic by the class prior this share is called toxic.
CALLED_SHARE = 0.95
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 256)]] = False


def word_bins(text: bytes) -> np.ndarray:
    """Distinct bins of the words (runs of letters, digits and bytes beyond ASCII) of the lower-cased text."""
    b = np.frombuffer(text.lower(), np.uint8)
    inside = ~_SEPARATOR[b]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64)
    lengths = ends - starts
    place = np.arange(len(b), dtype=np.int64)[inside] - np.repeat(starts, lengths)
    value = (b[inside].astype(np.uint64) + np.uint64(1)) * (_MULT * (2 * place.astype(np.uint64) + np.uint64(1)))
    value ^= value >> np.uint64(29)
    sums = np.add.reduceat(value * _MULT, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    sums = (sums ^ (sums >> np.uint64(32))) * _MULT
    return np.unique(sums >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class ToxicityModel:
    weights: np.ndarray  #: of each bin, mostly zero
    bias: float
    fitted: bool

    def score(self, text: bytes) -> float:
        if not self.fitted:
            return 0.0
        z = self.bias + float(self.weights[word_bins(text)].sum()) if text else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the sigmoid loss, by Adam on all rows."""
    w = np.zeros(xp.shape[1] + 1)
    w[:-1] = (xp.mean(axis=0) - xu.mean(axis=0)) * 4
    w[-1] = -1.0
    xp, xu = (np.hstack([x, np.ones((len(x), 1))]) for x in (xp, xu))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (xp, xu))
        # the loss of calling z positive is 1 - sigmoid(z), of calling it negative sigmoid(z)
        negative = su.mean() - prior * sp.mean()
        dp = xp.T @ (sp * (1 - sp)) / len(xp)
        du = xu.T @ (su * (1 - su)) / len(xu)
        grad = -prior * dp + (du - prior * dp) if negative >= 0 else prior * dp - du
        grad = grad + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def decision(z: np.ndarray, bias: float, prior: float, share: float = CALLED_SHARE) -> float:
    """Where to part unlabelled documents: ``share`` of the prior's part lies above, and always some evidence.

    The risk settles the direction well, but its sigmoid loss leaves the level of the
    bias to the documents with much evidence; the class prior says how many are positive.
    """
    z = np.sort(z)[::-1]
    least = bias + 1e-6  # a document without any feature is not called toxic
    k = int(share * prior * len(z))
    above = z[z > least]
    if not len(above):
        return max(0.0, least)
    if k >= len(above):
        return max(least, float(above[-1]) - 1e-6)
    return max(least, float(z[max(k - 1, 0)] + z[k]) / 2)


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, toxic_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED
) -> ToxicityModel:
    """Learn from the rows of ``labels`` where ``train`` (over doc_id) holds, and from unlabelled texts."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(toxic_col).cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic")), F.lit(0))).first()
    none = ToxicityModel(np.zeros(1 << BITS), 0.0, False)
    if not n_toxic:
        return none
    rows = common.documents(docs)
    slots = 1 << 20
    # the filter on ids comes before the join with texts, so few texts are shuffled
    share = min(slots, max_positive * slots // n_toxic + 1)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    chosen = known.filter("toxic = 1").filter(slot < share).orderBy(slot, "doc_id").limit(max_positive).select("doc_id")
    total = docs.count()
    share = min(slots, max_unlabelled * slots // max(total, 1) + 1)
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots))
    positive = _bins(rows.join(chosen, "doc_id", "left_semi").withColumn("slot", slot))
    unlabelled = _bins(rows.withColumn("slot", slot).filter(F.col("slot") < share), 2 * max_unlabelled)
    if not positive or not unlabelled:
        return none
    rates = [np.bincount(np.concatenate(x), minlength=1 << BITS) / len(x) for x in (positive, unlabelled)]
    spread = np.sqrt((rates[0] * (1 - rates[0]) + 1e-3) / len(positive) + (rates[1] * (1 - rates[1]) + 1e-3) / len(unlabelled))
    gain = (rates[0] - rates[1]) / spread
    features = np.sort(np.argsort(-gain, kind="stable")[:N_FEATURES])
    features = features[gain[features] > 3]
    if not len(features):
        return none
    xp, xu = (np.array([np.isin(features, x, assume_unique=True) for x in rows_], float) for rows_ in (positive, unlabelled))
    w, bias = nnpu(xp, xu, n_toxic / n)
    bias -= decision(xu @ w + bias, bias, n_toxic / n)
    weights = np.zeros(1 << BITS)
    weights[features] = w
    return ToxicityModel(weights, bias, True)


def _bins(df: DataFrame, limit: int | None = None) -> list[np.ndarray]:
    """The word bins of a bounded sample, in an order that does not depend on the partitions; the first by hash if they are too many."""
    def found(batch: pa.RecordBatch) -> dict:
        return {"slot": batch.column("slot"), "x": [word_bins(t).astype("<u4").tobytes() for t in common.byte_texts(batch)]}

    rows = common.map_batches(df, found, "slot long, x binary")
    if limit is not None:
        rows = rows.orderBy("slot", "x").limit(limit)
    return [np.frombuffer(x, "<u4") for x in sorted(r["x"] for r in rows.collect())]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every document."""
    sparse = np.flatnonzero(model.weights)
    values, bias, fitted = model.weights[sparse], model.bias, model.fitted

    def scored(batch: pa.RecordBatch) -> dict:
        weights = np.zeros(1 << BITS)
        weights[sparse] = values
        own = ToxicityModel(weights, bias, fitted)
        s = [own.score(x) for x in common.byte_texts(batch)]
        return {"doc_id": batch.column("doc_id"), "score": s, "predicted": [int(x >= 0.5) for x in s]}

    return common.map_batches(common.documents(docs, id_col, text_col), scored, "doc_id long, score double, predicted int")
