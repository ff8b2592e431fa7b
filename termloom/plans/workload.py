"""The evaluation workload on the test tables: which table plays which part.

``documents`` is the collection, ``benchmark`` the queries (whole texts), and judgments
follow from the texts: a document that holds the query's terms as a phrase has rel 2, one
with at least three quarters of its distinct terms rel 1. Index and expansion take the
analyser's terms, without stop words; vectors take all tokens of a text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import bm25, expansion, importance, index, rerank, scan, similarity
from termloom.sources import shared

DIM = 64
CANDIDATES, EXPANSION_TERMS = 1000, 15
WEIGHTS = (1.2, 0.8, 1.5)
_kept: dict[tuple, DataFrame] = {}


def keep(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table of the workload, written once a session and state of the folder: every query would make it anew otherwise."""
    key = (spark.sparkContext.applicationId, sf_dir, state(spark, sf_dir), name)
    if key not in _kept:
        _kept[key] = shared.materialize(make(), name)[0]
    return _kept[key]


def forget(spark: SparkSession, but: tuple[str, ...] = ()) -> None:
    """Drop what this session keeps, except the names given."""
    own = [k for k in _kept if k[0] == spark.sparkContext.applicationId and k[-1] not in but]
    for key in own:
        kept = _kept.pop(key)
        for path in kept.inputFiles()[:1] if isinstance(kept, DataFrame) else ():
            shared.drop_path(spark, path.rsplit("/", 1)[0])


def state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


class Workload:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text")

    @cached_property
    def index(self) -> index.Index:
        """The collection's index, built on first use as one builds it before searching; its queries come as one batch, so it has no postings."""
        return self._index("index", inverted=False)

    @cached_property
    def inverted(self) -> index.Index:
        """The same with postings and their maxima, for the search that reads some of them."""
        return self._index("inverted-index")

    @cached_property
    def piece_index(self) -> index.Index:
        """The same with spans in pieces of four characters."""
        return self._index("piece-index", widths=index.fixed_pieces(4), inverted=False)

    def _index(self, name: str, **options) -> index.Index:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, state(self.spark, self.sf_dir), name)
        if key not in _kept:
            _kept[key] = index.write_index(self.docs, shared.new_path(self.spark, name), **options)
        return _kept[key]

    @cached_property
    def items(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("qid"), "text")

    @cached_property
    def query_terms(self) -> DataFrame:
        return self.index.query_terms(self.items)

    @cached_property
    def query_tokens(self) -> DataFrame:
        """All tokens, stop words too: those of the vectors."""
        return T.token_rows(self.items, "qid")

    @cached_property
    def queries(self) -> DataFrame:
        return self.items.select("qid", F.array_join(T.tokens(F.col("text")), " ").alias("text"))

    @cached_property
    def qrels(self) -> DataFrame:
        def make() -> DataFrame:
            near = scan.covering(self.index, self.query_terms, 0.75)
            exact = bm25.phrases(self.index, self.items).select("qid", "doc_id", F.lit(2).alias("rel"))
            some = near.select("qid", "doc_id", F.lit(1).alias("rel"))
            return exact.unionByName(some).groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))

        return keep(self.spark, self.sf_dir, "qrels", make)

    def run(self, k: int, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
        return keep(self.spark, self.sf_dir, f"run-{k}-{k1}-{b}", lambda: bm25.search(self.index, self.query_terms, k, k1, b))

    @cached_property
    def encoder(self) -> similarity.Encoder:
        vectors = self.table("embeddings")
        return similarity.table_encoder(vectors, vectors.count())

    @cached_property
    def expansion(self) -> DataFrame:
        def make() -> DataFrame:
            model = expansion.indexed_model(self.index, self.run(10))
            return expansion.top_terms(expansion.with_query_terms(model, self.query_terms), EXPANSION_TERMS)

        return keep(self.spark, self.sf_dir, "expansion", make)

    @cached_property
    def features(self) -> DataFrame:
        return keep(self.spark, self.sf_dir, "features", lambda: importance.extract_features(self.index, self.expansion, self.query_tokens, self.encoder, DIM))

    @cached_property
    def similarities(self) -> DataFrame:
        terms = self.query_tokens.select("qid", "term").unionByName(self.features.select("qid", "term"))
        return keep(self.spark, self.sf_dir, "similarities", lambda: rerank.term_similarities(self.run(CANDIDATES), terms, self.docs, self.encoder))

    @cached_property
    def document_vectors(self) -> DataFrame:
        """(doc_id, vec): the sum of the vectors of a candidate's first tokens."""
        ids = self.run(CANDIDATES).select("doc_id").distinct()
        wanted = self.docs.join(F.broadcast(ids) if index.is_few(ids) else ids, "doc_id", "left_semi")
        rows = T.token_rows(wanted, "doc_id", limit=rerank.MAX_DOC_TOKENS)
        return similarity.text_vectors(rows, self.encoder, DIM, "doc_id")

    @cached_property
    def runs(self) -> DataFrame:
        """(run_name, qid, rank, doc_id, score) of two parameter settings and one reranked run."""
        own = self.run(100).select(F.lit("bm25").alias("run_name"), "qid", "rank", "doc_id", "score")
        short = self.run(100, 0.9, 0.4).select(F.lit("bm25_short").alias("run_name"), "qid", "rank", "doc_id", "score")
        return own.unionByName(short).unionByName(self.reranked.select(F.lit("reranked").alias("run_name"), "qid", "rank", "doc_id", "score"))

    @cached_property
    def reranked(self) -> DataFrame:
        own = importance.weighted(self.features, *WEIGHTS)
        return keep(self.spark, self.sf_dir, "reranked", lambda: rerank.rerank(self.run(CANDIDATES), self.query_tokens, own, self.docs, self.encoder, CANDIDATES, similarities=self.similarities))

    @cached_property
    def parts(self) -> DataFrame:
        """What every objective over weights is a sum of, by query and candidate."""
        return keep(self.spark, self.sf_dir, "parts", lambda: rerank.score_parts(self.run(CANDIDATES), self.query_tokens, self.features, self.similarities))
