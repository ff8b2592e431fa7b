"""Incremental indexing: a stream of new, changed and deleted documents becomes segments of an index.

Every micro-batch becomes a segment: the forward table of its documents, the
statistics of its terms, and tombstones, the ids whose versions in earlier segments are dead.
Postings are views of the forward tables: as segments have no folders by term, stored ones would be
a second copy of all occurrences, sorted anew at each merge, that no search reads a part of.
A null text deletes a document. When ``fanout`` segments of one level follow each other at
the end they are merged into one of the next level, without their dead documents; tombstones
go when nothing is earlier. So a document is rewritten once a level, and the number of segments
grows with the logarithm of the number of batches.

``manifest/<batch>`` lists the segments after a batch; it is written last. A batch that is run
again after a failure starts from the manifest before it and overwrites its own segments,
which have names of its number, so there are no double rows (exactly once together with
the stream's checkpoint). Segments stay for one batch after they are merged, so that an index that
was opened just before can still be read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.functions import text as T
from termloom.operators import index

FANOUT = 4
#: Ids of dead documents that go to every task rather than have forward tables shuffled.
FEW_DEAD = 2_000_000
#: (name, level) of the segments, the oldest first.
Segments = list[tuple[str, int]]


def index_stream(updates: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, trigger: dict | None = None, fanout: int = FANOUT, stopwords=T.STOPWORDS, stemmed: bool = False) -> StreamingQuery:
    """Of several rows for one id in a batch the one with the largest ``order_col`` counts (the largest text without it)."""

    def add(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, path, batch_id, id_col, text_col, order_col, fanout, stopwords, stemmed)

    return updates.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def apply_batch(batch: DataFrame, path: str, batch_id: int, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, fanout: int = FANOUT, stopwords=T.STOPWORDS, stemmed: bool = False) -> Segments:
    """Add a batch of updates as a segment, merge what has become too many, and return the segments."""
    spark = batch.sparkSession
    segments = _manifest(spark, path, batch_id)
    at = F.lit(None) if order_col is None else F.col(order_col)
    named = batch.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), at.alias("at")).filter("doc_id is not null")
    last = F.max("text") if order_col is None else F.max(F.struct("at", "text"))["text"]
    newest = named.groupBy("doc_id").agg(last.alias("text"))
    name = f"{batch_id:08d}-0"
    _write(spark, f"{path}/segments/{name}", index.forward(newest, stopwords=stopwords, stemmed=stemmed), named.select("doc_id").distinct().filter(F.lit(bool(segments))))
    segments = [*segments, (name, 0)]
    while len(segments) >= fanout and len({level for _, level in segments[-fanout:]}) == 1:
        level = segments[-1][1] + 1
        earlier, merged = segments[:-fanout], segments[-fanout:]
        name = f"{batch_id:08d}-{level}"
        dead = reduce(DataFrame.unionByName, [_tombstones(spark, path, x) for x, _ in merged]).distinct()
        _write(spark, f"{path}/segments/{name}", _live(spark, path, merged, "forward"), dead.filter(F.lit(bool(earlier))))
        segments = [*earlier, (name, level)]
    told = spark.createDataFrame([(i, *x) for i, x in enumerate(segments)], "place int, name string, level int").coalesce(1)
    told.write.mode("overwrite").json(f"{path}/manifest/{batch_id:08d}")
    _drop_old(spark, path, batch_id, {x for x, _ in segments})
    return segments


def _write(spark: SparkSession, path: str, documents: DataFrame, tombstones: DataFrame) -> None:
    tombstones.write.mode("overwrite").parquet(f"{path}/tombstones")
    documents.write.mode("overwrite").parquet(f"{path}/forward")
    counts = spark.read.schema(documents.schema).parquet(f"{path}/forward").select(F.inline("counts"))
    counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.mode("overwrite").parquet(f"{path}/terms")


def _files(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> Segments:
    """The segments of the last batch, or of the last one before a batch; only finished manifests count."""
    fs, _ = _files(spark, path)
    done = [x for x in _names(spark, f"{path}/manifest") if fs.exists(_files(spark, f"{path}/manifest/{x}/_SUCCESS")[1])]
    done = [x for x in done if before is None or int(x) < before]
    if not done:
        return []
    rows = spark.read.schema("place int, name string, level int").json(f"{path}/manifest/{done[-1]}").collect()  # a row for each segment
    return [(r["name"], r["level"]) for r in sorted(rows, key=lambda r: r["place"])]


def _drop_old(spark: SparkSession, path: str, batch_id: int, live: set[str]) -> None:
    """Segments that neither this batch nor the one before it names go; so do older manifests."""
    kept = live | {x for x, _ in _manifest(spark, path, batch_id)}
    for name in _names(spark, f"{path}/segments"):
        if name not in kept and int(name.split("-")[0]) <= batch_id:
            fs, target = _files(spark, f"{path}/segments/{name}")
            fs.delete(target, True)
    for name in [x for x in _names(spark, f"{path}/manifest") if int(x) < batch_id][:-1]:
        fs, target = _files(spark, f"{path}/manifest/{name}")
        fs.delete(target, True)


def _tombstones(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/segments/{name}/tombstones").select("doc_id")


def _live(spark: SparkSession, path: str, segments: Segments, table: str, how: str = "left_anti") -> DataFrame:
    """Rows of a table of the segments whose documents no later segment has; with ``left_semi`` the dead ones."""
    parts, later = [], None
    for name, _ in reversed(segments):
        rows = spark.read.parquet(f"{path}/segments/{name}/{table}")
        if later is not None:
            ids = later.distinct()
            parts.append(rows.join(F.broadcast(ids) if index.is_few(later, FEW_DEAD) else ids, "doc_id", how))
        elif how == "left_anti":
            parts.append(rows)
        own = _tombstones(spark, path, name)
        later = own if later is None else later.unionByName(own)
    columns = spark.read.parquet(f"{path}/segments/{segments[-1][0]}/{table}").columns
    empty = spark.read.parquet(f"{path}/segments/{segments[-1][0]}/{table}").limit(0)
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in parts], empty)


def open_parts(spark: SparkSession, path: str, stemmed: bool = False) -> index.Index:
    """All segments as one index of the documents that live.

    Statistics of terms are those of the segments less those of their dead documents.
    Segments have no folders by term: write an index of the forward table when the stream rests.
    """
    segments = _manifest(spark, path)
    if not segments:
        raise ValueError(f"no finished batch at {path}")
    dead = _live(spark, path, segments, "forward", "left_semi").select(F.inline("counts"))
    gone = dead.groupBy("term").agg((-F.count("*")).alias("df"), (-F.sum("tf")).alias("cf"))
    own = [spark.read.parquet(f"{path}/segments/{name}/terms").select("term", "df", "cf") for name, _ in segments]
    terms = reduce(DataFrame.unionByName, [*own, gone]).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")
    documents = _live(spark, path, segments, "forward")
    return index.Index(index._postings(documents), documents, terms, stemmed=stemmed)
