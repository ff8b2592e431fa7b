"""Encode documents with a byte-level BPE tokenizer and store the ids bit-packed.

The documents are range-partitioned by doc_id, so shard k holds smaller ids than
shard k + 1. Each task streams its documents into one file of the format of
``packing`` in the shared folder. Its name carries the attempt, and only the manifest
row of the attempt that succeeded names it: a lost or speculative task leaves an
unused file, never a wrong one. Global starts are sums over the manifest.

Byte-level BPE splits a text by a fixed pattern and encodes each piece on its own, so
pieces are encoded once by the library and remembered. Texts beyond the code points
for which both pattern engines surely agree go to the library whole.

Defined cases: a null text is empty and stores the end id alone; a null doc_id is
not stored; repeated doc_ids are stored as often as they occur; a very long text spans blocks of its
file; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm import common, packing

END_ID = 2
#: Text bytes of a shard, as long as they are fewer than ``MAX_SHARDS``; then shards grow.
SHARD_BYTES = 24 << 20
#: Range bounds come from a sample of at most a million rows, some 20 for each of so many shards.
MAX_SHARDS = 50_000
#: Documents that are split and looked up together.
DOCS = 256
#: Remembered pieces of a worker, some 200 bytes each.
CACHE_PIECES = 400_000
#: Code points up to here have had their letters and numbers fixed for long.
_PLAIN = 0x52F
_OTHER = re.compile(f"[^\x00-\x1b\x20-{chr(_PLAIN)}]")


def _is_plain(text: str) -> bool:
    """Whether both pattern engines surely see the same letters, numbers and white space."""
    if text.isascii():
        return not any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _OTHER.search(text) is None


def _of_category(first: str) -> str:
    """The plain code points whose general category begins with ``first``, as ranges of a character class."""
    points = [c for c in range(_PLAIN + 1) if unicodedata.category(chr(c))[0] == first]
    starts = [c for c in points if c - 1 not in points]
    ends = [c for c in points if c + 1 not in points]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True))


def splitter() -> re.Pattern:
    """The splitting pattern of this tokenizer family (fixed value), its classes written out for plain code points."""
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    letters, numbers = _of_category("L"), _of_category("N")
    for old, new in ((r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]")):
        pattern = pattern.replace(old, new)
    return re.compile(pattern)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find = splitter().findall
        self.cache: dict[str, bytes] = {}
        plain = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.by_piece = plain and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.n_ids = self.tokenizer.get_vocab_size()
        self.n_bytes = np.zeros(self.n_ids, np.int64)  # that an id stands for: in this alphabet a character each
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = len(token)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        whole = [not (self.by_piece and _is_plain(x)) or any(s in x for s in self.special) for x in texts]
        pieces = [[] if w else self.find(x) for x, w in zip(texts, whole, strict=True)]
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        if new := set().union(*pieces).difference(cache):
            # a space before a character begins a piece wherever it stands, so such pieces can be encoded in a row
            joint = [x for x in new if len(x) > 1 and x[0] == " " and not x[1].isspace()]
            alone = list(new.difference(joint))
            cache.update(zip(alone, self._direct(alone), strict=True))
            for start in range(0, len(joint), 500):
                cache.update(self._in_a_row(joint[start : start + 500]))
        return [self._direct([x])[0] if w else common.joined(cache, p) for x, w, p in zip(texts, whole, pieces, strict=True)]

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _in_a_row(self, row: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of all pieces at once, parted where each piece's bytes end."""
        ids = np.frombuffer(self._direct(["".join(row)])[0], "<u4")
        ends = np.cumsum([len(x.encode()) for x in row])
        reach = np.cumsum(self.n_bytes[ids])
        cuts = np.searchsorted(reach, ends) + 1
        if cuts[-1] > len(ids) or (reach[cuts - 1] != ends).any():  # an id spans two pieces: each on its own
            yield from zip(row, self._direct(row), strict=True)
            return
        data, at = ids.tobytes(), 0
        for piece, cut in zip(row, (4 * cuts).tolist(), strict=True):
            yield piece, data[at:cut]
            at = cut


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that Spark knows by this URI, and the path in it.

    Arrow has local, HDFS (``viewfs`` too), S3, GCS and Azure file systems; the connectors
    that Spark uses for some of them have schemes of their own. Others raise.
    """
    scheme, mark, rest = uri.partition("://")
    known = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gs": "gs"}
    if uri.startswith("file:") and not mark:
        return pyarrow.fs.LocalFileSystem(), uri[5:]
    return pyarrow.fs.FileSystem.from_uri(known.get(scheme, scheme) + mark + rest if mark else uri)


def write_ids(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Write the shards and return their manifest: shard, path, n_docs, n_ids and start."""
    spark = docs.sparkSession
    rows = common.documents(docs, id_col, text_col).filter("doc_id is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = min(total // shard_bytes + 1, MAX_SHARDS)
    folder = common.new_path(spark, "token-ids")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    bits = packing.bits_for(max(encoder(tokenizer_path).n_ids, end_id + 1))
    tail = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        own = encoder(tokenizer_path)
        shard = TaskContext.get().partitionId()
        name = f"{path}/{shard:08d}-{uuid.uuid4().hex}.ids"
        writer = sink = None
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS):
                part = batch.slice(start, DOCS)
                for doc_id, data in zip(part.column("doc_id").to_pylist(), own.encode(common.texts(part)), strict=True):
                    if writer is None:
                        sink = fs.open_output_stream(name)
                        writer = packing.Writer(sink, bits)
                    writer.add(doc_id, np.frombuffer(data + tail, "<u4"))
        if writer is not None:
            writer.close()
            sink.close()
            row = {"shard": [shard], "path": [name], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.starts[-1]]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # equal ids are parted by their texts, so that a repeated id does not fill one shard
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(n_shards, *order).sortWithinPartitions(*order)
    manifest, _ = common.materialize(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"), "token-ids-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, folder_uri: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, read back from the files."""
    base = folder_uri or common.shared_dir(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(base)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    out: list[tuple] = []
                    for doc_id, start, parts in packing.Reader(source).docs():
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        out.append((doc_id, first + start, sum(map(len, parts)), crc))
                        if len(out) >= 10_000:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    n_shards = max(1, manifest.count())  # a task for each: rows so small would be coalesced
    return manifest.select("path", "start").repartition(n_shards, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=list(names))
