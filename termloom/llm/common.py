"""Helpers that the operators of this subpackage share.

Row-wise work on texts runs in ``mapInArrow``: Arrow batches of bounded length go
to Python once, and each document is handled on its own, so memory is bounded by
one batch. Intermediate results that are used more than once are written as
Parquet below ``spark.checkpoint.dir``: every executor can read them again, and a
lost executor costs only its running tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.sources.shared import drop_path, materialize, new_path, shared_dir  # noqa: F401

#: Rows of an Arrow batch: with texts of some KB each a few MB.
BATCH_ROWS = 1000
#: ASCII white space that separates words; ``bytes.split()`` uses the same set.
WORD_SPACE = b" \t\n\x0b\x0c\r"


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: Column) -> DataFrame:
    """Only the columns that an operator uses, so that others cannot clash with its own."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra
    )


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``fn`` takes a batch and returns columns by name (lists or Arrow arrays)."""
    spark = df.sparkSession
    target = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in range(0, batch.num_rows, BATCH_ROWS):
                out = fn(batch.slice(rows, BATCH_ROWS))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def joined(known: dict, keys: list) -> bytes:
    """The remembered bytes of all keys in a row; KeyError if one is not known."""
    return b"".join(itemgetter(*keys)(known)) if len(keys) > 1 else b"".join([known[k] for k in keys])


class Memory:
    """What a worker remembers, in two generations of ``size`` entries.

    A full generation becomes the old one; what is asked for again moves on from there,
    so frequent keys stay while rare ones go. ``young`` is a plain dict, which sets can
    be compared with without reading all of it.
    """

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def unknown(self, keys: set, may_age: bool = True) -> set:
        """The keys that are in neither generation; those of the old one are taken over."""
        if may_age and len(self.young) > self.size:
            self.old, self.young = self.young, {}
        new = keys.difference(self.young)
        old = self.old
        known = [k for k in new if k in old]
        self.young.update([(k, old[k]) for k in known])
        return new.difference(known)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null is empty."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts of a batch; null is empty."""
    return [x if x is not None else b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]
