"""Benchmark decontamination by the q-gram lemma and banded alignment.

Both sides are lower-cased and their white space runs become one space. An item of m
characters may differ from a document's passage by k = floor(``EDIT_RATE`` * m) edits.
An edit spoils at most q of the item's m - q + 1 q-grams, so a passage within the
budget keeps at least t = m - q + 1 - k * q of them, and they lie on diagonals
(document position less item position) that are at most k apart. Hence:

1. each document's q-grams are looked up in the index of the items' q-grams;
2. the item's places that are hit are counted in overlapping diagonal bands of width
   2 (k + 1), which leave no interval of k + 1 diagonals undivided; a band with fewer than
   t places cannot hold a passage;
3. bands that touch are one region; a bit-parallel column of the whole item tells whether
   any part of its text is within the budget, and if so an alignment that computes only the
   cells within k diagonals of the region tells which.

Items too short for the lemma (t < 1) use a smaller q, down to 1 with their own t.
The filter compares one byte per character (equal characters have equal bytes, so it
loses nothing); the alignment compares characters.

Hits are counted in slices of at most ``SLICE_HITS``, and sorted by band once, so a text
that repeats itself (a table of zeros, a separator line) takes time in proportion to its
length times the item's, and memory of one slice.

The items are a stated query set. The driver indexes them in blocks of at most
``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters, one at a time, and writes each to a
file that Spark hands to the executors. Workers map the files into memory, so they share
them, and take a batch of documents through one block after the other.

Defined cases: null or empty texts hold nothing; null, empty and blank items are
ignored, and so are items below ``MIN_CHARS`` characters, which any text may hold by chance
(``ignored_items`` counts them); an item so short that no edit is allowed counts only where no
letter or digit goes on before or behind it; equal items each count; repeated documents are judged alike; very long texts
are searched in overlapping parts; an empty table on either side gives its plain result
(no rows, or no passages).
"""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import common

EDIT_RATE = 0.1
Q = 8
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8 << 20
#: Characters of the shortest item, normalised.
MIN_CHARS = 8
#: Characters of a document that are looked up at once; parts overlap by the longest passage.
PART = 1 << 18
#: Hits that are held at once.
SLICE_HITS = 1 << 21
_TABLE_BITS = 22
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """The q-grams (q at most 8) of a text, a 64-bit number each, from one byte per character."""
    b = (c ^ (c >> 8) ^ (c >> 16)).astype(np.uint8)
    n = len(b) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    wide = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))
    value = np.ascontiguousarray(wide).view("<u8").reshape(-1)
    return value if q == 8 else value & np.uint64((1 << (8 * q)) - 1)


def budget(m: int, edit_rate: float, q: int) -> tuple[int, int, int]:
    """Edits, q and least number of shared q-grams for an item of m characters."""
    k = int(edit_rate * m)
    while q > 1 and m - q + 1 - k * q < 1:
        q -= 1
    return k, q, m - q + 1 - k * q


def align(item: np.ndarray, text: np.ndarray, k: int, low: int | None = None, high: int | None = None) -> tuple[int, int, int] | None:
    """Fewest edits (at most k) that turn the item into a part of ``text``, and that part's bounds.

    Only diagonals (text position less item position) from ``low`` to ``high`` are
    computed, all by default. A row is a text position; of it, the cells of the item's
    positions in the band. The item may begin at any position. Ties go to the leftmost end.
    """
    m, n = len(item), len(text)
    low, high = -m if low is None else low, n if high is None else high
    far = m + n + 1
    cost = np.full(m + 1, far)
    begin = np.zeros(m + 1, np.int64)
    a, z = max(0, -high), min(m, -low)  # cells of the row before the first character
    if a <= z:
        cost[a : z + 1] = np.arange(a, z + 1)  # item characters left out before the text begins
    steps = np.arange(m + 1)
    best = (k + 1, 0, 0)
    if z == m and cost[m] < best[0]:
        best = (int(cost[m]), 0, 0)
    for j in range(max(1, low), min(n, high + m) + 1):  # cells of row j: j - high <= i <= j - low
        a, z = max(0, j - high), min(m, j - low)
        first = max(a, 1)
        take = cost[first - 1 : z] + (item[first - 1 : z] != text[j - 1])
        drop = cost[first : z + 1] + 1
        new = np.minimum(take, drop)
        start = np.where(take <= drop, begin[first - 1 : z], begin[first : z + 1])
        if a == 0:
            new, start = np.concatenate(([0], new)), np.concatenate(([j], start))
        # an item's character without partner: running minimum of cost less steps
        own = steps[a : z + 1]
        slack = new - own
        least = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == least, own, a)) - a
        if a:
            cost[a - 1] = far
        cost[a : z + 1], begin[a : z + 1] = least + own, start[source]
        if z == m and cost[m] < best[0]:
            best = (int(cost[m]), int(begin[m]), j)
    return best if best[0] <= k else None


def within(masks: dict[int, int], m: int, text: list[int], k: int) -> bool:
    """Whether an item of m characters turns into some part of ``text`` by at most k edits.

    A column of the table of edits is two numbers of m bits, whether a cell is more or less than
    the one above it; ``masks`` has the item's places of each character.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    more, less, cost = full, 0, m
    for c in text:
        same = masks.get(c, 0)
        across = (((same & more) + more) ^ more) | same
        down = same | less
        up, fall = less | (full & ~(across | more)), more & across
        if up & top:
            cost += 1
        elif fall & top:
            cost -= 1
            if cost <= k:
                return True
        up, fall = (up << 1) & full, (fall << 1) & full
        more, less = fall | (full & ~(down | up)), up & down
    return cost <= k


@dataclass
class Index:
    """q-grams of a block of items, for one q."""

    q: int
    numbers: np.ndarray  #: sorted distinct q-grams
    offsets: np.ndarray  #: of each in the two arrays below
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray  #: bit table that most other q-grams fail

    @classmethod
    def of(cls, items: list[np.ndarray], which: list[int], q: int) -> Index:
        all_grams = [grams(items[i], q) for i in which]
        flat = np.concatenate(all_grams)
        item = np.repeat(np.array(which), [len(g) for g in all_grams])
        place = np.concatenate([np.arange(len(g)) for g in all_grams])
        order = np.argsort(flat, kind="stable")
        numbers, first = np.unique(flat[order], return_index=True)
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[(numbers * _MULT) >> np.uint64(64 - _TABLE_BITS)] = True
        return cls(q, numbers, np.append(first, len(flat)), item[order].astype(np.int32), place[order].astype(np.int32), table)

    def hits(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, diagonal, place in the item) of each pair of equal q-grams, in slices of the text."""
        g = grams(c, self.q)
        at = np.flatnonzero(self.table[(g * _MULT) >> np.uint64(64 - _TABLE_BITS)])
        g = g[at]
        slot = np.searchsorted(self.numbers, g)
        slot[slot == len(self.numbers)] = 0
        same = self.numbers[slot] == g
        at, slot = at[same], slot[same]
        n = self.offsets[slot + 1] - self.offsets[slot]
        ends = np.cumsum(n)
        start = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_HITS, "right")))
            size = n[start:stop]
            source = np.arange(int(size.sum())) + np.repeat(self.offsets[slot[start:stop]] - (np.cumsum(size) - size), size)
            place = self.place[source].astype(np.int64)
            yield self.item[source].astype(np.int64), np.repeat(at[start:stop], size) - place, place
            start = stop


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over the borders of a passage."""
    before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    return not before and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


@lru_cache(maxsize=512)
def _masks(item: str) -> dict[int, int]:
    """The places of each character of an item, as bits."""
    masks: dict[int, int] = {}
    for place, c in enumerate(item):
        masks[ord(c)] = masks.get(ord(c), 0) | 1 << place
    return masks


class Matcher:
    def __init__(self, items: list[tuple[int, str]], edit_rate: float, q: int):
        self.ids = [i for i, _ in items]
        coded = [codes(t) for _, t in items]
        self.starts = np.cumsum([0, *map(len, coded)])
        self.flat = np.concatenate([np.zeros(0, "<u4"), *coded])
        plans = [budget(len(c), edit_rate, q) for c in coded]
        self.k, self.t = (np.array([p[j] for p in plans], np.int64) for j in (0, 2))
        by_q: dict[int, list[int]] = {}
        for i, p in enumerate(plans):
            by_q.setdefault(p[1], []).append(i)
        self.indexes = [Index.of(coded, which, q_) for q_, which in sorted(by_q.items())]
        self.longest = max((len(c) + k for c, k in zip(coded, self.k.tolist(), strict=True)), default=0)

    def item(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i + 1]]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of the passages in a normalised text, the best of each region."""
        c = codes(text)
        found: dict[tuple[int, int], tuple] = {}
        for start in range(0, max(1, len(c)), PART):
            part = c[start : start + PART + 2 * self.longest]
            for i, low, high in self._regions(part):
                if hit := self._verified(i, part, text, start, low, high):
                    row = (self.ids[i], int(start + hit[1]), int(start + hit[2]), int(hit[0]))
                    key = (i, row[2])
                    if key not in found or row[3] < found[key][3]:
                        found[key] = row
        return sorted(found.values())

    def _verified(self, i: int, part: np.ndarray, text: str, start: int, low: int, high: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item's best passage in a region of a part of the text."""
        k, item = int(self.k[i]), self.item(i)
        m = len(item)
        first, last = max(0, low - k), min(len(part), high + m + k)
        plain = item.tobytes().decode("utf-32-le")
        at = text.find(plain, start + first, start + last)
        while k == 0 and at >= 0 and not _stands_alone(text, at, at + m):
            at = text.find(plain, at + 1, start + last)
        if at >= 0:
            return 0, at - start, at - start + m
        if k == 0 or not within(_masks(plain), m, part[first:last].tolist(), k):
            return None
        hit = align(item, part[first:last], k, low - k - first, high + k - first)
        return hit and (hit[0], first + hit[1], first + hit[2])

    def _regions(self, c: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, least, greatest diagonal) where bands hold enough places of the item; bands that touch are joined."""
        base = len(c) + self.longest + 2
        for index in self.indexes:
            cells, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for item, diagonal, place in index.hits(c):
                cell = item * (2 * base) + diagonal // (self.k[item] + 1) + base
                if len(cell) > len(c):  # a text that repeats itself: each place of a band once
                    both = np.unique(cell * self.longest + place)
                    cell, place = both // self.longest, both % self.longest
                cells.append(cell)
                places.append(place)
            cell, place = np.concatenate(cells), np.concatenate(places)
            if not len(cell):
                continue
            key, n = np.unique(cell, return_counts=True)
            owner = key // (2 * base)
            with_next = n.copy()
            follows = key[1:] == key[:-1] + 1
            with_next[:-1] += np.where(follows, n[1:], 0)
            good = np.flatnonzero(with_next >= self.t[owner])
            if not len(good):
                continue
            order = np.argsort(cell, kind="stable")
            place, ends = place[order], np.cumsum(n)
            last: tuple[int, int, int] | None = None
            for at in good.tolist():
                i, b = int(owner[at]), int(key[at] % (2 * base)) - base
                stop = ends[at + 1] if at < len(follows) and follows[at] else ends[at]
                if len(np.unique(place[ends[at] - n[at] : stop])) < self.t[i]:  # a repeated q-gram of the text counts once
                    continue
                k = int(self.k[i])
                low, high = b * (k + 1), (b + 2) * (k + 1) - 1
                if last and last[0] == i and low <= last[2] + 1:
                    last = (i, last[1], high)
                else:
                    if last:
                        yield last
                    last = (i, low, high)
            if last:
                yield last


@dataclass
class Block:
    """A matcher whose large arrays lie in a file: what a plan carries is a few numbers for each."""

    name: str
    arrays: list[tuple[str, int, int]]  #: type, offset and length of each
    rest: int  #: offset of what is pickled

    @classmethod
    def write(cls, matcher: Matcher, path: str) -> Block:
        arrays = []
        with open(path, "wb") as out:
            for owner, name in cls._large(matcher):
                x = getattr(owner, name)
                out.write(b"\0" * (-out.tell() % 64))
                arrays.append((x.dtype.str, out.tell(), len(x)))
                out.write(x.tobytes())
                setattr(owner, name, None)
            rest = out.tell()
            pickle.dump(matcher, out)
        return cls(os.path.basename(path), arrays, rest)

    @staticmethod
    def _large(matcher: Matcher) -> list[tuple[object, str]]:
        own = [(matcher, "flat"), (matcher, "starts")]
        return own + [(index, name) for index in matcher.indexes for name in ("numbers", "offsets", "item", "place", "table")]

    def open(self) -> Matcher:
        path = SparkFiles.get(self.name)
        with open(path, "rb") as source:
            source.seek(self.rest)
            matcher = pickle.load(source)
        views = iter(np.memmap(path, np.dtype(kind), "r", at, (n,)) if n else np.zeros(0, kind) for kind, at, n in self.arrays)
        for owner, name in self._large(matcher):
            setattr(owner, name, np.asarray(next(views)))
        return matcher


#: Folders from which the driver serves the files to executors, late ones included, until it ends.
_served: list[tempfile.TemporaryDirectory] = []


@lru_cache(maxsize=256)  # what is not mapped from the file is small
def _opened(name: str, arrays: tuple, rest: int) -> Matcher:
    return Block(name, list(arrays), rest).open()


def index_blocks(benchmark: DataFrame, id_col: str, text_col: str, edit_rate: float, q: int, min_chars: int) -> list[Block]:
    """Index the items block by block; the driver holds one at a time, executors get the files."""
    context = benchmark.sparkSession.sparkContext
    folder = tempfile.TemporaryDirectory(prefix="termloom-items-")
    _served.append(folder)
    out = []
    for items in item_blocks(benchmark, id_col, text_col, min_chars):
        path = os.path.join(folder.name, f"items-{uuid.uuid4().hex}")
        out.append(Block.write(Matcher(items, edit_rate, q), path))
        context.addFile(path)
    return out


def search_all(blocks: list[Block], texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """The passages of each text: all texts through a block, then through the next."""
    plain = [normalise(x) for x in texts]
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in plain]
    for block in blocks:
        matcher = _opened(block.name, tuple(block.arrays), block.rest)
        for text, own in zip(plain, found, strict=True):
            if text:
                own.extend(matcher.find(text))
    return found


def ignored_items(benchmark: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row: n_items, and n_ignored of them that are too short to tell of anything."""
    rows = benchmark.select(F.length(F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?U)\s+", " "))).alias("n"))
    return rows.agg(F.count("*").alias("n_items"), F.coalesce(F.sum((F.col("n") < min_chars).cast("long")), F.lit(0)).alias("n_ignored"))


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of bounded size; the driver holds one block at a time."""
    block: list[tuple[int, str]] = []
    n = 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        if len(text := normalise(row[1])) >= max(1, min_chars):
            block.append((row[0], text))
            n += len(text)
        if len(block) >= BLOCK_ITEMS or n >= BLOCK_CHARS:
            yield block
            block, n = [], 0
    if block:
        yield block


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    edit_rate: float = EDIT_RATE,
    q: int = Q,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Every document with the benchmark passages in it: doc_id, n_chars and the array ``passages``.

    A passage has item_id, start and end (in the normalised text) and its edits.
    """
    kind = "array<struct<item_id:long,start:long,end:long,edits:long>>"
    blocks = index_blocks(benchmark, item_col, item_text_col, edit_rate, q, min_chars)
    names = ("item_id", "start", "end", "edits")

    def search(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        found = [[dict(zip(names, p, strict=True)) for p in own] for own in search_all(blocks, texts)]
        return {"doc_id": batch.column("doc_id"), "n_chars": [len(x or "") for x in texts], "passages": found}

    return common.map_batches(common.documents(docs, id_col, text_col), search, f"doc_id long, n_chars long, passages {kind}")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", edit_rate: float = EDIT_RATE, q: int = Q, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without any benchmark passage, with all their columns."""
    blocks = index_blocks(benchmark, "item_id", "text", edit_rate, q, min_chars)

    def keep(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for start in range(0, batch.num_rows, common.BATCH_ROWS):
                part = batch.slice(start, common.BATCH_ROWS)
                yield part.filter(pa.array([not own for own in search_all(blocks, part.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
