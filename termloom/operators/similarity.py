"""Semantic similarity between texts, terms and vectors.

An encoder is a function from distinct terms to vectors: it takes a DataFrame with a
column ``term`` and returns (term, vec array<double>). Each distinct term is encoded
once, however many rows use it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import numbers as N
from termloom.functions import vectors as V

Encoder = Callable[[DataFrame], DataFrame]
#: Vectors of a block that meets other blocks whole, and queries whose products with a block are made at a time.
BLOCK, STRIP = 1024, 16
#: Queries whose blocks go to every task; more meet the vectors as a product of both tables' partitions.
FEW_QUERIES = 50_000


def table_encoder(vectors: DataFrame, n: int, id_col: str = "vec_id", vec_col: str = "embedding") -> Encoder:
    """Terms take the row of a vector table that a portable hash (md5, first 32 bits, modulo n) names."""

    def encode(terms: DataFrame) -> DataFrame:
        slot = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % F.lit(n)
        rows = vectors.select(F.col(id_col).cast("long").alias("slot"), V.doubles(F.col(vec_col)).alias("vec"))
        return terms.select("term").distinct().withColumn("slot", slot).join(rows, "slot").select("term", "vec")

    return encode


def udf_encoder(fn: Callable[[list[str]], list[list[float]]], batch_size: int = 32) -> Encoder:
    """A model as a Python function over lists of texts, called by Arrow batches on the executors."""

    def encode(terms: DataFrame) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                texts = batch.column("term").to_pylist()
                vectors = [v for i in range(0, len(texts), batch_size) for v in fn(texts[i : i + batch_size])]
                yield pa.RecordBatch.from_arrays([pa.array(texts), pa.array(vectors, pa.list_(pa.float64()))], names=["term", "vec"])

        return terms.select("term").filter("term is not null").distinct().mapInArrow(run, "term string, vec array<double>")

    return encode


def text_vectors(term_rows: DataFrame, encoder: Encoder, dim: int, key: str = "qid") -> DataFrame:
    """(key, vec): the sum of the vectors of a text's terms; terms without vector are skipped."""
    counted = term_rows.groupBy(key, "term").agg(F.count("*").alias("times"))
    joined = counted.join(encoder(term_rows), "term").select(key, V.scale(F.col("vec"), F.col("times").cast("double")).alias("vec"))
    return joined.groupBy(key).agg(*V.sum_of(F.col("vec"), dim)).select(key, V.packed(dim).alias("vec"))


def term_similarities(query_terms: DataFrame, terms: DataFrame, encoder: Encoder, dim: int) -> DataFrame:
    """(qid, term, similarity) of the terms of each query with the query's own vector; blank or unknown terms 0."""
    queries = text_vectors(query_terms, encoder, dim)
    asked = terms.select("qid", "term").distinct()
    joined = asked.join(encoder(asked), "term", "left").join(queries.withColumnRenamed("vec", "query_vec"), "qid", "left")
    similar = F.when(F.col("vec").isNull() | F.col("query_vec").isNull(), F.lit(0.0)).otherwise(V.cosine(F.col("query_vec"), F.col("vec")))
    return joined.select("qid", "term", similar.alias("similarity"))


METRICS = ("cosine", "dot", "euclidean")


def pairs(queries: DataFrame, vectors: DataFrame, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, value) of a stated query set against all vectors.

    Blocks of vectors meet blocks of queries, so a task holds two blocks and a strip of results
    whatever the tables' sizes. Sums are made one dimension after the other in double
    precision, as SQL makes them. Vectors without value, of different lengths or with a null in
    them have no product: null, or a cosine of 0.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(METRICS)}")
    asked = queries.count()
    left = _blocks(queries, id_col, vec_col, asked).select(F.col("ids").alias("query_ids"), F.col("vecs").alias("query_vecs"))
    right = _blocks(vectors, id_col, vec_col, vectors.count())
    both = right.crossJoin(F.broadcast(left) if asked <= FEW_QUERIES else left)  # rows are blocks
    kinds = [x.schema[id_col].dataType.simpleString() for x in (queries, vectors)]
    return both.mapInArrow(_products(metric), f"query_id {kinds[0]}, vec_id {kinds[1]}, value double")


def _blocks(rows: DataFrame, id_col: str, vec_col: str, n: int) -> DataFrame:
    """(ids, vecs): a row for each partition of about ``BLOCK`` of ``n`` vectors."""
    kind = rows.schema[id_col].dataType.simpleString()
    dealt = rows.select(F.col(id_col).alias("id"), V.doubles(F.col(vec_col)).alias("vec")).repartition(max(1, -(-n // BLOCK)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = pa.array([0, batch.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, batch.column(c)) for c in ("id", "vec")], names=["ids", "vecs"])

    return dealt.mapInArrow(pack, f"ids array<{kind}>, vecs array<array<double>>")


def _products(metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (ids, vecs, query_ids, query_vecs) of two blocks to a row for each of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs, query_ids, query_vecs = (batch.column(c) for c in ("ids", "vecs", "query_ids", "query_vecs"))
            for i in range(batch.num_rows):
                b, size_b = _matrix(vecs[i].values)
                a, size_a = _matrix(query_vecs[i].values)
                own, asked = ids[i].values, query_ids[i].values
                for at in range(0, len(asked), STRIP):
                    strip, sizes = a[at : at + STRIP], size_a[at : at + STRIP]
                    value = _values(metric, strip, b)
                    there = (sizes[:, None] == size_b) & (sizes[:, None] >= 0)
                    value = (np.where(there, value, 0.0) if metric == "cosine" else value).ravel()
                    lost = None if metric == "cosine" or there.all() else ~there.ravel()
                    query = np.repeat(np.arange(at, at + len(strip)), len(own))
                    vec = np.tile(np.arange(len(own)), len(strip))
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(query)), own.take(pa.array(vec)), pa.array(value, mask=lost)], names=["query_id", "vec_id", "value"])

    return run


def _matrix(vecs: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, shorter ones filled up by zeros, and their lengths, -1 where there is none or a null in it."""
    sizes = vecs.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, held = vecs.flatten(), np.maximum(sizes, 0)
    out = np.zeros((len(sizes), int(held.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), held)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    sizes[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, sizes


def _values(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rounded values of all rows of ``a`` with all of ``b``."""
    with np.errstate(all="ignore"):
        if metric == "euclidean":
            return _rounded(np.sqrt(_sums(a, b, np.subtract)))
        value = _sums(a, b, np.multiply)
        if metric == "cosine":
            size = np.sqrt(_squares(a))[:, None] * np.sqrt(_squares(b))
            value = np.where(size == 0, 0.0, np.maximum(0.0, value / size))
        return _rounded(value)


def _sums(a: np.ndarray, b: np.ndarray, of: np.ufunc) -> np.ndarray:
    """Sums of products, or of squared differences, one dimension after the other."""
    total = np.zeros((len(a), len(b)))
    part = np.empty_like(total)
    columns = np.ascontiguousarray(b.T)
    for d in range(min(a.shape[1], b.shape[1])):
        of(a[:, d, None], columns[d], out=part)
        if of is np.subtract:
            np.multiply(part, part, out=part)
        total += part
    return total


def _squares(a: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * a[:, d]
    return total


def _rounded(x: np.ndarray, places: int = 6) -> np.ndarray:
    """Halves away from zero, no negative zero."""
    scaled = np.abs(x) * 10.0**places
    whole = np.floor(scaled)
    whole += scaled - whole >= 0.5
    out = np.copysign(whole / 10.0**places, x) + 0.0
    return np.where(np.isfinite(out), out, x)


def distribution(similarities: DataFrame, threshold: float = 0.6) -> DataFrame:
    """By query: mean, population deviation, min, max, and the terms above a threshold."""
    s = F.col("similarity")
    high = F.array_sort(F.collect_list(F.when(s > threshold, F.col("term"))))
    return similarities.groupBy("qid").agg(
        N.rounded(F.avg(s)).alias("mean"), N.rounded(F.stddev_pop(s)).alias("stdev"), N.rounded(F.min(s)).alias("min"), N.rounded(F.max(s)).alias("max"), high.alias("high_terms")
    )


def quality(scored: DataFrame, value: str, truth: str) -> DataFrame:
    """Pearson correlation of a similarity with a truth, and both means and population deviations."""
    a, b = F.col(value), F.col(truth).cast("double")
    return scored.agg(
        N.rounded(F.corr(a, b)).alias("pearson"),
        N.rounded(F.avg(a)).alias("mean_value"),
        N.rounded(F.stddev_pop(a)).alias("stdev_value"),
        N.rounded(F.avg(b)).alias("mean_truth"),
        N.rounded(F.stddev_pop(b)).alias("stdev_truth"),
    )
