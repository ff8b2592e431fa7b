"""Pack tokenised documents into sequences of fixed capacity: best-fit decreasing.

Best fit looks at lengths only, and pieces of one length are interchangeable, as are
open sequences with the same remaining capacity. So the decisions need no more than the
number of pieces of each length: at most ``capacity`` rows, whatever the size of the
corpus. ``plan`` takes lengths in decreasing order; a segment tree over the remaining
capacities names the tightest open sequence for a piece in logarithmic time, and the
pieces of a length that would go the same way one by one go in one step. The result is
that of best-fit decreasing over all documents, not over parts of them.

Executors tokenise, number the pieces of each length in their own partition, and look
up a piece's place by its number among all pieces of its length: the counts of the
partitions before come by a join of counts. The steps of the plan are broadcast. They are
bounded: a sequence holds at most about ``sqrt(2 * capacity)`` different lengths, and a
length splits at most two groups of sequences.

A tokenizer that drops white space looks at nothing across it, so the words between
ASCII white space are encoded on their own and remembered, short ones only; other tokenizers
get whole texts.

Defined cases: a null text is empty, which gives the end id alone; a null doc_id is packed
like any other; repeated rows are packed as often as they occur; pieces of one length are
numbered in no fixed order; a very long text is cut into pieces of the whole capacity and a rest;
an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm import common

CAPACITY, END_ID = 4096, 1
#: Remembered words of a worker, in each of two generations, and the longest such word: some 150 MB at most.
CACHE_WORDS, CACHE_BYTES = 300_000, 64
#: Marks that are pieces of their own behind a letter or digit.
MARKS = b".,;:!?%$*&#"
#: Documents that are looked up together.
DOCS = 256
#: Keys of a step: length times this, plus the number of its first piece.
_SPAN = 1 << 48


class OpenSequences:
    """Groups of open sequences by remaining capacity, under a segment tree of counts.

    A group is a range of sequence numbers. A node of the tree holds the number of groups
    below it, so ``tightest`` walks one path up and one path down.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.counts[node] += by
            node >>= 1

    def put(self, capacity: int, first: int, n: int) -> None:
        if n and capacity:
            self.groups[capacity].append((first, n))
            self._add(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        self._add(capacity, -1)
        return self.groups[capacity].pop()

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of an open sequence that is not below ``least``; 0 if there is none."""
        node = self.leaves + least
        if self.counts[node]:
            return least
        while node > 1 and (node & 1 or not self.counts[node + 1]):
            node >>= 1
        if node <= 1:
            return 0
        node += 1
        while node < self.leaves:
            node = 2 * node if self.counts[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first number, pieces a sequence, first sequence, offset) that place all pieces.

    The piece of a length with the number i, in the step with the last first number not above
    i, goes to sequence ``first sequence + (i - first number) // pieces a sequence``, behind
    the pieces of this step that are there.
    """
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("a length is not from 1 to the capacity")
    steps, opened, free = [], 0, OpenSequences(capacity)
    for length in sorted(counts, reverse=True):
        placed, left = 0, counts[length]
        while left:
            room = free.tightest(length)
            each = (room or capacity) // length  # a sequence stays the tightest until it is full for this length
            if room:
                first, n = free.take(room)
            else:
                room, first, n = capacity, opened, -(-left // each)
                opened += n
            full = min(n, left // each)
            rest = min(each - 1, left - full * each) if full < n else 0
            for at, sequences, pieces in ((first, full, each), (first + full, 1, rest)):
                if sequences and pieces:
                    steps.append((length, placed, pieces, at, capacity - room))
                    placed += sequences * pieces
                    free.put(room - pieces * length, at, sequences)
            left = counts[length] - placed
            used = full + (rest > 0)
            free.put(room, first + used, n - used)
    return steps


class Encoder:
    """Ids by words where the tokenizer drops white space, by whole texts otherwise."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = common.Memory(CACHE_WORDS)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        whole, *words = (self._ids(x) for x in (" Ab\n c.\t\x0b\x0c\rd ", "Ab", "c", ".", "d"))
        self.by_word = whole == [i for w in words for i in w]
        self.lowers = self._ids("ABC") == self._ids("abc")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        if not self.by_word:
            return [np.array(self._ids(x.decode()), "<u4").tobytes() for x in texts]
        words = [self._lowered(x).split() for x in texts]
        distinct = set().union(*words)
        new = self.memory.unknown({w for w in distinct if len(w) <= CACHE_BYTES})
        # words with marks behind them are their parts: the tokenizer parts letters and digits from marks
        parted = {w: core for w in new if (core := w.rstrip(MARKS)) != w and core[-1:].isalnum()}
        parts = {*parted.values(), *(w[len(core) :] for w, core in parted.items())}
        alone = self.memory.unknown(parts | new.difference(parted), may_age=False)
        known = self.memory.young
        known.update(self._direct(list(alone)))
        known.update([(w, known[core] + known[w[len(core) :]]) for w, core in parted.items()])
        known.update(longer := dict(self._direct([w for w in distinct if len(w) > CACHE_BYTES])))
        out = [common.joined(known, w) if w else b"" for w in words]
        for w in longer:
            del known[w]
        return out

    def _lowered(self, text: bytes) -> bytes:
        """A-Z in lower case where that changes no id: no special token arises, and no letter meets a combining mark."""
        lowered = text.lower()
        if not self.lowers or b"\xcc" in text or b"\xcd" in text or any(x in lowered for x in self.special):
            return text
        return lowered

    def _direct(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return ((w, np.array(x.ids, "<u4").tobytes()) for w, x in zip(words, found, strict=True))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(task, doc_id, piece, start, length, ids_crc32, nth, ids): the pieces of all documents, as written to the shared folder.

    ``nth`` numbers the pieces of a length within a task, from 0. ``ids`` are little-endian
    uint32, null without ``keep_ids``.
    """
    rows = common.documents(docs, id_col, text_col)
    tail = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = encoder(tokenizer_path), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                out: list[tuple] = []
                for doc_id, data in zip(part.column("doc_id").to_pylist(), own.encode(common.byte_texts(part)), strict=True):
                    data += tail
                    for piece, start in enumerate(range(0, len(data), step)):
                        ids = data[start : start + step]
                        length = len(ids) // 4
                        out.append((task, doc_id, piece, start // 4, length, zlib.crc32(ids), seen[length], ids if keep_ids else None))
                        seen[length] += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["task", "doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = "task int, doc_id long, piece int, start long, length long, ids_crc32 long, nth long, ids binary"
    return common.materialize(rows.mapInArrow(run, schema), "best-fit-pieces")[0]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: as few sequences as best-fit decreasing finds."""
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length up to the capacity
    steps = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(steps)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["task", "length"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("before") + F.col("nth")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        keys = steps[:, 0] * _SPAN + steps[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            _, first, each, sequence, offset = steps[np.searchsorted(keys, length * _SPAN + number, "right") - 1].T
            nth = number - first
            columns = [*batch.columns[:-1], pa.array(sequence + nth // each), pa.array(offset + nth % each * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = numbered.drop("number").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): whole sequences for training, with the documents in order of their places.

    ``packed`` has the ids of its pieces; a sequence has at most as many pieces as its capacity.
    """
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    grouped = packed.groupBy("sequence_id").agg(rows.alias("r"))
    return grouped.select("sequence_id", F.array_join(F.transform("r", lambda x: F.hex(x["ids"])), "").alias("h"), F.col("r.doc_id").alias("doc_ids"), F.col("r.length").alias("lengths")).select("sequence_id", F.unhex("h").alias("ids"), "doc_ids", "lengths")
