"""The index of a collection: a forward table by document, and postings with maxima by term.

``forward(part, doc_id, dl, block, counts, heads, widths, places, starts)`` is sorted by doc_id
and lies in a folder for each range of ids (``part``); ``settings`` tells the ranges, so the
documents that somebody asks for are read from their own folders. ``counts`` are a document's
terms in order, each with its number of occurrences; ``heads`` count those among the first
``HEAD`` terms of the text; ``places`` number the occurrences among the document's terms (stop
words left out), ``starts`` among the pieces of all its words, of which the term has
``widths``. Both are delta-coded: the first number, then the gaps.

``postings(bucket, term, doc_id, tf, dl, block)`` lie in a folder for
each bucket (a hash of the term), sorted by term and document. A very frequent term is spread
over several files because doc_id is part of the sort key. The spans of its occurrences are
in the document's row alone (``Index.spans``): they are most of a posting's bytes, and writing them
twice would shuffle them too. ``maxima(bucket, term, block, n,
cf, max_tf, min_dl)`` has a row for each term and block of ``BLOCK_DOCS`` neighbouring
documents: no document of the block scores higher for the term than one of length ``min_dl``
that holds it ``max_tf`` times. ``terms(bucket, term, df, cf, max_tf, min_dl, best)`` says the same
of the collection; ``best`` is the largest term frequency part of any document at the usual
parameters.

A text is tokenised once, in its own row; the numbering and counting of a batch of documents
are array operations. Building shuffles the texts into their ranges and the postings into
their order. The analyser leaves out stop words; stemming is an option, and an index
remembers which analyser it was built with, so that queries take the same. Ids are to be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions.stem import stem, stems

#: Text of a folder of postings and of one of documents, as long as there are no more folders than these.
BUCKET_BYTES, MAX_BUCKETS, PART_BYTES, MAX_PARTS = 64 << 20, 65_536, 64 << 20, 65_536
#: As many folders of documents are read rather than chosen from, which is a job.
FEW_PARTS = 8
#: Text that is worth a task of its own while tasks are fewer than cores.
TASK_BYTES = 2 << 20
#: Neighbouring documents whose postings share a maximum.
BLOCK_DOCS = 16
#: Terms of a document that a relevance model counts.
HEAD = 1000
#: Parameters that ``best`` of the terms is for.
K1, B = 1.2, 0.75
_COUNTS = "array<struct<term:string,tf:bigint>>"
_SETTINGS = "buckets int, stemmed boolean, id_type string, n_docs long, avgdl double"
_SPANS = ("width", "places", "starts")
_LISTS = "heads array<int>, widths array<int>, places array<array<int>>, starts array<array<int>>"


#: Rows of ids that go to every task rather than have a table of documents shuffled.
FEW_IDS = 500_000


def is_few(ids: DataFrame, most: int | None = None) -> bool:
    """Whether rows are at most ``most`` (``FEW_IDS``); no more are counted."""
    most = FEW_IDS if most is None else most
    return ids.limit(most + 1).count() <= most


def to_tasks(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``rows`` of a small side of a join, which go to every task if they are few, so that the other side is not shuffled."""
    return F.broadcast(rows) if is_few(rows, most) else rows


def bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def one_piece(terms: list[str]) -> list[int]:
    """Every word is a piece of its own."""
    return [1] * len(terms)


def fixed_pieces(size: int) -> Callable[[list[str]], list[int]]:
    """Words are cut into pieces of ``size`` characters, as ``text.subwords`` does."""

    def widths(terms: list[str]) -> list[int]:
        return [max(1, -(-len(t) // size)) for t in terms]

    return widths


@dataclass
class Index:
    postings: DataFrame
    documents: DataFrame  #: the forward table
    terms: DataFrame | None = None
    maxima: DataFrame | None = None
    bounds: DataFrame | None = None  #: (part, first, last) of the folders of documents
    buckets: int = 0  #: of the folders of postings; 0 where they have none
    stemmed: bool = False
    size: tuple[int, float | None] | None = field(default=None)  #: documents and their mean length, where known

    @property
    def doc_stats(self) -> DataFrame:
        return self.documents.select("doc_id", "dl")

    @property
    def term_stats(self) -> DataFrame:
        if self.terms is not None:
            return self.terms.select("term", "df", "cf")
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    @property
    def collection(self) -> DataFrame:
        if self.size is not None:
            return self.documents.sparkSession.range(1, numPartitions=1).select(*self._size())
        return self.documents.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def _size(self) -> list[Column]:
        return [F.lit(self.size[0]).cast("long").alias("n"), F.lit(self.size[1]).cast("double").alias("avgdl")]

    def with_size(self, rows: DataFrame) -> DataFrame:
        """``rows`` with n and avgdl of the collection."""
        return rows.select("*", *self._size()) if self.size is not None else rows.crossJoin(F.broadcast(self.collection))  # one row

    def query_terms(self, queries: DataFrame, key: str = "qid", text_col: str = "text") -> DataFrame:
        """(key, pos, term) of the queries by the index's own analyser."""
        rows = T.token_rows(queries, key, text_col, analyze=True)
        return rows.withColumn("term", stems(F.col("term"))) if self.stemmed else rows

    def _folders(self, asked: DataFrame) -> Column:
        """Which folders hold the asked terms (bucket, term): at most as many numbers as there are folders come to the driver."""
        if self.buckets == 1:
            return F.lit(True)
        wanted = [r[0] for r in asked.select("bucket").distinct().collect() if r[0] is not None]
        return F.col("bucket").isin(wanted) if len(wanted) < self.buckets else F.lit(True)

    def in_few_folders(self, terms: DataFrame) -> bool:
        """Whether terms lie in at most half of the folders of postings, so that reading those pays."""
        most = self.buckets // 2
        return most > 0 and terms.select(bucket_of("term", self.buckets).alias("bucket")).distinct().limit(most + 1).count() <= most

    def stats_of(self, terms: DataFrame) -> DataFrame:
        """Rows of ``terms`` for some terms, from their folders alone."""
        asked = terms.select("term").distinct()
        if not self.buckets and self.terms is not None:
            return self.terms.join(asked, "term")
        if not self.buckets:
            own = self.postings.join(asked, "term", "left_semi")
            return own.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        asked = asked.withColumn("bucket", bucket_of("term", self.buckets))
        return self.terms.filter(self._folders(asked)).join(to_tasks(asked), ["bucket", "term"])

    def of_terms(self, terms: DataFrame, *more: str) -> DataFrame:
        """Postings of some terms with df and dl: (term, doc_id, tf, df, dl), and more columns of postings if named."""
        asked = terms.select("term").distinct()
        columns = ("term", "doc_id", "tf", "df", "dl", *more)
        if not self.buckets:
            own = self.postings.join(asked, "term", "left_semi")
            df = own.groupBy("term").agg(F.count("*").alias("df"))
            return own.join(df, "term").select(*columns)
        asked = asked.withColumn("bucket", bucket_of("term", self.buckets))
        here = self._folders(asked)
        few = is_few(asked)
        found = self.terms.filter(here).join(F.broadcast(asked) if few else asked, ["bucket", "term"]).select("bucket", "term", "df")
        return self.postings.filter(here).join(F.broadcast(found) if few else found, ["bucket", "term"]).select(*columns)

    def spans(self, wanted: DataFrame) -> DataFrame:
        """(doc_id, term, tf, width, places, starts) of the terms of some doc_ids, from the forward table."""
        return _postings(self.of_documents(wanted)).select("doc_id", "term", "tf", *_SPANS)

    def maxima_of(self, terms: DataFrame) -> DataFrame:
        """(term, block, max_tf, min_dl) of the blocks of some terms."""
        asked = terms.select("term").distinct().withColumn("bucket", bucket_of("term", self.buckets))
        return self.maxima.filter(self._folders(asked)).join(to_tasks(asked), ["bucket", "term"]).select("term", "block", "max_tf", "min_dl")

    def of_documents(self, wanted: DataFrame) -> DataFrame:
        """Rows of the forward table for some doc_ids, from the folders whose ranges hold them."""
        ids = wanted.select("doc_id").distinct()
        return self.near(wanted).join(to_tasks(ids), "doc_id", "left_semi")

    def near(self, wanted: DataFrame) -> DataFrame:
        """All rows of the folders that hold some doc_ids: for joins that leave the others out themselves."""
        return self.documents.filter(self._ranges(wanted.select("doc_id").distinct()))

    def _ranges(self, ids: DataFrame) -> Column:
        if self.bounds is None:
            return F.lit(True)
        ranges = F.broadcast(self.bounds)  # a row for each folder
        found = ids.join(ranges, (ids["doc_id"] >= ranges["first"]) & (ids["doc_id"] <= ranges["last"]))
        parts = [r[0] for r in found.select("part").distinct().collect()]
        return F.col("part").isin(parts)


def forward(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int | None = None, stopwords=T.STOPWORDS, stemmed: bool = False, widths: Callable[[list[str]], list[int]] = one_piece) -> DataFrame:
    """(doc_id, dl, block, counts, heads, widths, places, starts) of each document. A null text is no document.

    ``block`` numbers the documents of a partition in their order, ``BLOCK_DOCS`` at a time.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    if max_docs is not None:
        rows = rows.orderBy("doc_id").limit(max_docs)
    words = rows.select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    kind = words.schema["doc_id"].dataType.simpleString()
    count = _Counter(frozenset(stopwords or ()), stemmed, widths)
    return words.mapInArrow(count, f"doc_id {kind}, dl long, block long, counts {_COUNTS}, {_LISTS}")


class _Counter:
    """Batches of (doc_id, tokens) to rows of the forward table."""

    def __init__(self, stopwords: frozenset, stemmed: bool, widths: Callable[[list[str]], list[int]]):
        self.stopwords, self.stemmed, self.widths = stopwords, stemmed, widths

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            block = (part << 32) + (n + np.arange(batch.num_rows)) // BLOCK_DOCS
            n += batch.num_rows
            yield self.rows(batch, block)

    def rows(self, batch: pa.RecordBatch, block: np.ndarray) -> pa.RecordBatch:
        lists = batch.column("tokens")
        n, sizes = batch.num_rows, lists.value_lengths().to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        own = [stem(w) for w in words] if self.stemmed else words
        terms = sorted(set(own), key=str.encode)
        number = {t: i for i, t in enumerate(terms)}
        codes = np.array([number[t] for t in own], np.int64)
        kept = np.array([w not in self.stopwords for w in words], bool)
        wide, term_widths = (np.array(self.widths(x), np.int64) for x in (words, terms))

        at = coded.indices.to_numpy().astype(np.int64) if len(coded) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(n), sizes)
        first = np.cumsum(sizes) - sizes
        stays, width = kept[at], wide[at]
        start = _within(np.cumsum(width) - width, doc, first)
        place = _within(np.cumsum(stays) - stays, doc, first)
        doc, code, start, place = (x[stays] for x in (doc, codes[at], start, place))
        dl = np.bincount(doc, minlength=n)
        order = np.lexsort((place, code, doc))
        doc, code, start, place = (x[order] for x in (doc, code, start, place))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
        runs = np.flatnonzero(new)
        ends = np.append(runs, len(doc))
        head = np.add.reduceat(place < HEAD, runs) if len(runs) else runs
        by_doc = np.searchsorted(doc[runs], np.arange(n + 1))
        counts = pa.StructArray.from_arrays([pa.array(terms, pa.string()).take(pa.array(code[runs])), pa.array(np.diff(ends))], names=["term", "tf"])
        gaps = [pa.ListArray.from_arrays(_offsets(ends), pa.array(_gaps(x, new), pa.int32())) for x in (place, start)]
        lists = [pa.ListArray.from_arrays(_offsets(by_doc), x) for x in (counts, pa.array(head, pa.int32()), pa.array(term_widths[code[runs]], pa.int32()), *gaps)]
        names = ["doc_id", "dl", "block", "counts", "heads", "widths", "places", "starts"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(dl, pa.int64()), pa.array(block), *lists], names=names)


def _within(running: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums over all documents as sums within each."""
    return running - running[first[doc]] if len(running) else running


def _gaps(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.diff(values, prepend=0)
    out[new] = values[new]
    return out.astype(np.int32)


def _offsets(ends: np.ndarray) -> pa.Array:
    return pa.array(ends, pa.int32())


def positions(rows: DataFrame, gaps: str, into: str) -> DataFrame:
    """A row for each number of the delta-coded list ``gaps``, as ``into`` in its place."""
    kept = [c for c in rows.columns if c != gaps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(gaps)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sums, first = np.cumsum(flat), np.cumsum(sizes) - sizes
            before = np.concatenate([[0], sums])[first]
            for at in range(0, len(row), 1 << 16):
                own = row[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(own)) for c in kept), pa.array(sums[at : at + len(own)] - before[own])], names=[*kept, into])

    return rows.mapInArrow(run, rows.select(*kept).schema.add(into, "long"))


def _postings(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "dl", "block", F.inline(F.arrays_zip("counts", "widths", "places", "starts")))
    return rows.select("counts.term", "doc_id", "counts.tf", "dl", "block", F.col("widths").alias("width"), "places", "starts")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int | None = None, stopwords=T.STOPWORDS, stemmed: bool = False, widths: Callable[[list[str]], list[int]] = one_piece) -> Index:
    """An index that is not written: its tables are computed when they are used."""
    documents = forward(docs, id_col, text_col, max_docs, stopwords, stemmed, widths)
    return Index(_postings(documents), documents, stemmed=stemmed)


def write_index(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_docs: int | None = None,
    stopwords=T.STOPWORDS,
    stemmed: bool = False,
    buckets: int | None = None,
    widths: Callable[[list[str]], list[int]] = one_piece,
    inverted: bool = True,
) -> Index:
    """Build and write an index and open it. ``buckets`` follows from the size of the texts unless it is given.

    Without ``inverted`` the forward table and the terms are written, which is all that batches of
    queries read (``scan``): postings are views of them, and searches leave none out.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    if max_docs is not None:
        named = named.orderBy("doc_id").limit(max_docs)
    bytes_ = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    tasks = max(min(spark.sparkContext.defaultParallelism, -(-bytes_ // TASK_BYTES)), min(MAX_PARTS, -(-bytes_ // PART_BYTES)), 1)
    buckets = (buckets or min(MAX_BUCKETS, max(1, -(-bytes_ // BUCKET_BYTES)))) if inverted else 0
    ranged = named.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id")
    table = forward(ranged, stopwords=stopwords, stemmed=stemmed, widths=widths).withColumn("part", F.shiftright("block", 32).cast("int"))
    table.write.mode("overwrite").partitionBy("part").parquet(f"{path}/forward")
    id_type = named.schema["doc_id"].dataType.simpleString()
    documents = _table(spark, path, "forward", id_type)
    ranges = documents.groupBy("part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.sum("dl").alias("tokens")).collect()  # a row for each folder
    n, tokens = sum(r["n"] for r in ranges), sum(r["tokens"] for r in ranges)
    size = (n, tokens / n if n else None)

    # one row at least, so that an index without documents can be opened
    settings = [(r["part"], r["first"], r["last"], buckets, stemmed, id_type, n, size[1]) for r in ranges] or [(None, None, None, buckets, stemmed, id_type, 0, None)]
    bounds = spark.createDataFrame(settings, f"part int, first {id_type}, last {id_type}, {_SETTINGS}").coalesce(1)
    bounds.write.mode("overwrite").parquet(f"{path}/settings")

    if not inverted:
        dealt = documents.select("dl", F.inline("counts")).groupBy("term")
        stats = dealt.agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.max(tf_part(K1, B, size[1])).alias("best"))
        stats.withColumn("bucket", F.lit(0)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        return _opened(spark, path, id_type, 0, stemmed, size, len(ranges))
    placed = _postings(documents).drop(*_SPANS).withColumn("bucket", bucket_of("term", buckets))
    order = ["bucket", "term", "doc_id"]
    _dealt(placed, order, buckets, tasks).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    _write_statistics(spark, path, id_type, size, buckets, tasks)
    return _opened(spark, path, id_type, buckets, stemmed, size, len(ranges))


def _dealt(rows: DataFrame, order: list[str], buckets: int, tasks: int) -> DataFrame:
    """By ranges of the order; the one folder of a small index by term, which needs no sample."""
    return rows.repartitionByRange(*order) if buckets > 1 else rows.repartition(tasks, "term")


def _write_statistics(spark: SparkSession, path: str, id_type: str, size: tuple[int, float | None], buckets: int, tasks: int) -> None:
    """The maxima by term and block, and from them the terms."""
    order = ["bucket", "term", "block"]
    # grouped where they are dealt, so the postings are shuffled once
    of_block = _dealt(_table(spark, path, "postings", id_type).select(*order, "tf", "dl"), order, buckets, tasks).groupBy(*order)
    maxima = of_block.agg(F.count("*").alias("n"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.max(tf_part(K1, B, size[1])).alias("best"))
    maxima.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/maxima")
    terms = _table(spark, path, "maxima", id_type).groupBy("bucket", "term")
    terms = terms.agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"), F.max("best").alias("best"))
    terms = terms.repartition("bucket") if buckets > 1 else terms
    terms.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")


def tf_part(k1: float, b: float, avgdl: Column | float | None, tf: str = "tf", dl: str = "dl") -> Column:
    """tf / (tf + k1 * (1 - b + b * dl / avgdl)): it grows with tf and falls with dl."""
    mean = avgdl if isinstance(avgdl, Column) else F.lit(avgdl).cast("double")
    return F.col(tf) / (F.col(tf) + k1 * (1.0 - b + b * F.col(dl) / mean))


def _table(spark: SparkSession, path: str, name: str, id_type: str) -> DataFrame:
    columns = {
        "forward": f"doc_id {id_type}, dl long, block long, counts {_COUNTS}, {_LISTS}, part int",
        "postings": f"term string, doc_id {id_type}, tf long, dl long, block long, bucket int",
        "maxima": "term string, block long, n long, cf long, max_tf long, min_dl long, best double, bucket int",
        "terms": "term string, df long, cf long, max_tf long, min_dl long, best double, bucket int",
        "settings": f"part int, first {id_type}, last {id_type}, {_SETTINGS}",
    }
    return spark.read.schema(columns[name]).parquet(f"{path}/{name}")


def _opened(spark: SparkSession, path: str, id_type: str, buckets: int, stemmed: bool, size: tuple[int, float | None], parts: int) -> Index:
    documents, terms, bounds = (_table(spark, path, x, id_type) for x in ("forward", "terms", "settings"))
    if not buckets:
        return Index(_postings(documents), documents, terms, None, bounds if parts > FEW_PARTS else None, 0, stemmed, size)
    postings, maxima = (_table(spark, path, x, id_type) for x in ("postings", "maxima"))
    return Index(postings, documents, terms, maxima, bounds if parts > FEW_PARTS else None, buckets, stemmed, size)


def open_index(spark: SparkSession, path: str) -> Index:
    """Raises Spark's own error if there is no index at ``path``."""
    settings = spark.read.parquet(f"{path}/settings")
    s = settings.agg(*(F.first(c).alias(c) for c in ("buckets", "stemmed", "id_type", "n_docs", "avgdl")), F.count("part").alias("parts")).first()
    return _opened(spark, path, s["id_type"], s["buckets"], s["stemmed"], (s["n_docs"], s["avgdl"]), s["parts"])


def index_name(collection: str, model: str) -> str:
    return f"{collection}_{model}".replace("/", "_")


def index_statistics(index: Index) -> DataFrame:
    """One row: n_docs, avgdl, n_terms, n_postings, n_tokens."""
    terms = index.term_stats.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.sum("cf").alias("n_tokens"))
    docs = index.collection.select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"))
    return docs.crossJoin(terms)  # one row each


def index_settings(spark: SparkSession, path: str, k1: float, b: float) -> DataFrame:
    """One row: size_mb of the files, folders, whether terms are stemmed, and the scoring parameters k1 and b."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    own = spark.read.parquet(f"{path}/settings").limit(1)
    return own.select(F.lit(round(size / 2**20, 3)).alias("size_mb"), "buckets", "stemmed", F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"))


def validate_index(index: Index) -> DataFrame:
    """One row: documents there, token counts agree, no null or empty terms."""
    bad = F.sum((F.col("term").isNull() | (F.col("term") == "")).cast("long"))
    postings = index.postings.agg(F.sum("tf").alias("tokens"), F.coalesce(bad, F.lit(0)).alias("bad_terms"))
    docs = index.documents.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("lengths"))
    return postings.crossJoin(docs).select(
        (F.col("n_docs") > 0).alias("has_documents"), (F.coalesce("tokens", F.lit(0)) == F.col("lengths")).alias("counts_agree"), (F.col("bad_terms") == 0).alias("terms_valid")
    )
