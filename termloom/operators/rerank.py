"""Late-interaction reranking: MaxSim with importance-scaled query vectors.

For an importance w > 0, max_d (w q).d = w max_d q.d. So the similarities of query
vectors and documents are computed once, by term, and every set of weights is a
weighted sum of them: ``term_similarities`` does the vector work, ``scores`` the sums.

Query vectors: the query's own tokens first (at most half of ``MAX_VECTORS``, weight
1), then the expansion terms in order of rank, those with an importance not above 0
left out, at most ``MAX_VECTORS`` in all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions import vectors as V
from termloom.operators import bm25
from termloom.operators.index import is_few
from termloom.operators.similarity import Encoder
from termloom.sources import shared

MAX_VECTORS, MAX_DOC_TOKENS = 64, 512
#: Documents of a block, in which a term's vector is there once.
BLOCK_DOCS = 256


def query_vectors(query_terms: DataFrame, importance: DataFrame, encoder: Encoder, keys: list[str] | None = None, max_vectors: int = MAX_VECTORS) -> DataFrame:
    """(keys..., n, part, term, weight, vec) in order n from 1.

    ``importance`` has the keys (qid, and for instance model), rank, term, importance.
    Terms without vector are skipped before places are counted.
    """
    keys = keys or ["qid"]
    extra = [k for k in keys if k != "qid"]
    own = query_terms.select("qid", F.lit(0).alias("part"), F.col("pos").alias("place"), "term", F.lit(1.0).alias("weight"))
    own = own.join(encoder(own), "term")
    first = Window.partitionBy("qid").orderBy("place")
    own = own.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= max_vectors // 2).drop("i")
    if extra:
        own = own.join(importance.select(*keys).distinct(), "qid")
    terms = importance.filter("importance > 0").select(*keys, F.lit(1).alias("part"), F.col("rank").alias("place"), "term", F.col("importance").alias("weight"))
    terms = terms.join(encoder(terms), "term")
    order = Window.partitionBy(*keys).orderBy("part", "place", "term")
    both = own.select(*keys, "part", "place", "term", "weight", "vec").unionByName(terms.select(*keys, "part", "place", "term", "weight", "vec"))
    return both.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_vectors).select(*keys, "n", "part", "term", "weight", "vec")


def term_similarities(candidates: DataFrame, terms: DataFrame, docs: DataFrame, encoder: Encoder, max_tokens: int = MAX_DOC_TOKENS, sentences: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, term, similarity): the largest dot product of a term's vector with a document's vectors.

    ``terms`` is (qid, term). Documents lie in blocks of some ``BLOCK_DOCS``, and a block gets
    the vector of a term once, however many of its documents and queries have it. Rows carry
    terms, not vectors; in a block terms are numbers of rows of one matrix, and a document takes one
    product with the terms of all queries that have it as a candidate. A block holds at most
    ``BLOCK_DOCS * max_tokens`` vectors of documents besides those of its queries.
    """
    wanted, asked = candidates.select("qid", "doc_id").distinct(), terms.select("qid", "term").distinct()
    of_doc = wanted.groupBy("doc_id").agg(F.collect_list("qid").alias("qids"))  # at most all queries
    n_docs = of_doc.count()
    blocks = max(1, -(-n_docs // BLOCK_DOCS))
    of_doc = F.broadcast(of_doc) if is_few(wanted) else of_doc  # so that the texts of others stay where they are
    held = docs.select("doc_id", "text").join(of_doc, "doc_id").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "qids", F.array_distinct(T.first(T.tokens(F.col("text")), max_tokens)).alias("words")
    )
    if sentences is not None:
        held = held.join(sentences.select("doc_id", F.col("vec").alias("lone")), "doc_id", "left")
    held, _ = shared.materialize(held, "reranked-documents")
    queries = held.select("block", F.explode("qids").alias("qid")).distinct().join(asked.groupBy("qid").agg(F.collect_list("term").alias("terms")), "qid")
    vocabulary = held.select("block", F.explode("words").alias("term")).unionByName(queries.select("block", F.explode("terms").alias("term"))).distinct()
    vectors = vocabulary.join(encoder(vocabulary), "term").select("block", "term", "vec")
    given = vectors.unionByName(queries, allowMissingColumns=True).toDF("of_block", "term", "vec", "qid", "terms")
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema}
    return held.groupBy("block").cogroup(given.groupBy("of_block")).applyInArrow(_products, f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, term string, similarity double")


def _products(held: pa.Table, given: pa.Table) -> pa.Table:
    """The similarities of a block: its documents, and the vectors and queries that they need."""
    kinds = [given.schema.field("qid").type, held.schema.field("doc_id").type, pa.string(), pa.float64()]
    known = given.filter(pc.is_valid(given.column("term")))
    words, matrix = known.column("term").combine_chunks(), _matrix(known.column("vec").combine_chunks())
    asked = given.filter(pc.is_valid(given.column("qid")))
    queries = dict(zip(asked.column("qid").to_pylist(), _codes(asked.column("terms"), words), strict=True))
    lone = held.column("lone").to_pylist() if "lone" in held.column_names else [None] * held.num_rows
    qids, doc_ids, terms, best = [], [], [np.zeros(0, np.int64)], [np.zeros(0)]
    for doc_id, own, codes, spare in zip(held.column("doc_id").to_pylist(), held.column("qids").to_pylist(), _codes(held.column("words"), words), lone, strict=True):
        vectors = matrix[codes] if len(codes) else np.array([spare], float) if spare is not None else None
        own = [q for q in own if len(queries.get(q, ()))]
        if vectors is None or not own:
            continue
        rows = np.concatenate([queries[q] for q in own])
        best.append((matrix[rows] @ vectors.T).max(axis=1))
        terms.append(rows)
        qids += [q for q in own for _ in range(len(queries[q]))]
        doc_ids += [doc_id] * len(rows)
    columns = [pa.array(qids, kinds[0]), pa.array(doc_ids, kinds[1]), words.take(pa.array(np.concatenate(terms))).cast(pa.string()), pa.array(np.concatenate(best))]
    return pa.Table.from_arrays(columns, names=["qid", "doc_id", "term", "similarity"])


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _codes(column: pa.ChunkedArray, words: pa.StringArray) -> list[np.ndarray]:
    """For each list of words the numbers of those that have a vector."""
    lists = column.combine_chunks()
    numbers = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy()
    ends = np.cumsum([0, *(n or 0 for n in lists.value_lengths().to_pylist())])
    return [x[x >= 0] for x in (numbers[a:b].astype(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True))]


def scores(vectors: DataFrame, similarities: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., doc_id, score): sums of weight times similarity over the query vectors."""
    keys = keys or ["qid"]
    joined = vectors.select(*keys, "term", "weight").join(similarities, ["qid", "term"])
    return joined.groupBy(*keys, "doc_id").agg(F.sum(F.col("weight") * F.col("similarity")).alias("score"))


def score_parts(candidates: DataFrame, query_tokens: DataFrame, features: DataFrame, similarities: DataFrame, max_vectors: int = MAX_VECTORS) -> DataFrame:
    """(qid, doc_id, first_score, base, rm_weight, bm25_score, semantic_score) of the candidates.

    A score is ``base`` plus the weights times the three sums, for all weights not below 0:
    importance is linear in them, and terms whose importance is 0 add nothing. The first
    half of the vectors is the query's, so that many terms always have a place; features
    beyond them raise, as which of these have one depends on the weights.
    """
    sims = candidates.select("qid", "doc_id").join(similarities, ["qid", "doc_id"])
    half = max_vectors // 2
    own = query_tokens.select("qid", "pos", "term").join(sims, ["qid", "term"])
    first = Window.partitionBy("qid", "doc_id").orderBy("pos")
    base = own.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= half).groupBy("qid", "doc_id").agg(F.sum("similarity").alias("base"))
    beyond = F.raise_error(F.lit(f"a query has more than {half} expansion terms"))
    names = ("rm_weight", "bm25_score", "semantic_score")
    values = (F.sum(F.coalesce(n, F.lit(0.0)) * F.col("similarity")).alias(n) for n in names)
    sums = sims.join(features, ["qid", "term"]).groupBy("qid", "doc_id").agg(*values, F.count("*").alias("n_terms"))
    sums = sums.withColumn("base_", F.when(F.col("n_terms") > half, beyond.cast("double")).otherwise(F.lit(0.0)))
    joined = candidates.select("qid", "doc_id", F.col("score").alias("first_score")).join(base, ["qid", "doc_id"], "left").join(sums, ["qid", "doc_id"], "left")
    known = F.col("base").isNotNull() | F.col("base_").isNotNull()
    total = F.when(known, F.coalesce("base", F.lit(0.0)) + F.coalesce("base_", F.lit(0.0)))
    return joined.select("qid", "doc_id", "first_score", total.alias("base"), *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names))


def rerank(candidates: DataFrame, query_terms: DataFrame, importance: DataFrame, docs: DataFrame, encoder: Encoder, top_k: int = 100, keys: list[str] | None = None, similarities: DataFrame | None = None, sentences: DataFrame | None = None) -> DataFrame:
    """(keys..., rank, doc_id, score) of the candidates (qid, doc_id, score).

    A candidate that has no vectors, nor one of ``sentences``, keeps its first-stage score.
    """
    keys = keys or ["qid"]
    vectors = query_vectors(query_terms, importance, encoder, keys)
    if similarities is None:
        terms = query_terms.select("qid", "term").unionByName(importance.select("qid", "term"))
        similarities = term_similarities(candidates, terms, docs, encoder, sentences=sentences)
    new = scores(vectors, similarities, keys)
    base = candidates.select("qid", "doc_id", F.col("score").alias("first_score"))
    if len(keys) > 1:
        base = base.join(importance.select(*keys).distinct(), "qid")
    joined = base.join(new, [*keys, "doc_id"], "left").withColumn("score", F.coalesce("score", "first_score"))
    return bm25.ranked(joined, keys, top_k).select(*keys, "rank", "doc_id", "score")


def rerank_sentences(candidates: DataFrame, query_terms: DataFrame, importance: DataFrame, doc_vectors: DataFrame, encoder: Encoder, dim: int, top_k: int = 100) -> DataFrame:
    """One vector a document: the maximum is that vector's product, so the score is (sum of w q).d."""
    vectors = query_vectors(query_terms, importance, encoder)
    scaled = vectors.select("qid", V.scale(F.col("vec"), F.col("weight")).alias("vec"))
    summed = scaled.groupBy("qid").agg(*V.sum_of(F.col("vec"), dim)).select("qid", V.packed(dim).alias("query_vec"))
    joined = candidates.select("qid", "doc_id").join(summed, "qid").join(doc_vectors, "doc_id")
    scored = joined.select("qid", "doc_id", V.dot(F.col("query_vec"), F.col("vec")).alias("score"))
    return bm25.ranked(scored, ["qid"], top_k).select("qid", "rank", "doc_id", "score")


def explain(vectors: DataFrame) -> DataFrame:
    """(qid, own_terms, expansion_terms, weights, n_vectors) after the cap."""
    rows = F.array_sort(F.collect_list(F.struct("n", "part", "term", "weight")))
    grouped = vectors.groupBy("qid").agg(rows.alias("r"))
    pick = lambda part: F.transform(F.filter("r", lambda x: x["part"] == part), lambda x: x["term"])
    weights = F.transform(F.filter("r", lambda x: x["part"] == 1), lambda x: F.round(x["weight"], 6))
    return grouped.select("qid", pick(0).alias("own_terms"), pick(1).alias("expansion_terms"), weights.alias("weights"), F.size("r").alias("n_vectors"))


def model_info(vectors: DataFrame, candidates: DataFrame, max_vectors: int = MAX_VECTORS, max_tokens: int = MAX_DOC_TOKENS) -> DataFrame:
    """One row on what a reranking takes: queries, query vectors, most of one query, candidates, documents and the limits."""
    per_query = vectors.groupBy("qid").agg(F.count("*").alias("n"))
    asked = per_query.agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_vectors"), F.coalesce(F.max("n"), F.lit(0)).alias("most_vectors"))
    found = candidates.agg(F.count("*").alias("n_candidates"), F.countDistinct("doc_id").alias("n_documents"))
    limits = (F.lit(max_vectors).cast("long").alias("max_vectors"), F.lit(max_tokens).cast("long").alias("max_tokens"))
    return asked.crossJoin(found).select("*", *limits)  # one row each
