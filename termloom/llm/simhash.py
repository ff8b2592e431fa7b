"""SimHash near-duplicates: a byte-position index with count filtering.

Fingerprints: words are runs of other characters than ASCII white space, A-Z are
lower-cased, 3-word shingles are hashed with XXH64 (seed 42), and a bit is 1 if it is
set in over half the hashes.

Links (at most 3 differing bits): such fingerprints differ in at most 3 of their 8
bytes, so they share at least 5 positional bytes, the guaranteed minimum.

1. *Inverted index.* A posting list of one positional byte holds 1/256 of all rows, and
   pairs drawn from it would grow with the square of the input. By the prefix rule of
   count filtering a pair with 5 of 8 shared bytes has at least 4 of them among the first
   7 positions, so the index is kept by the 35 sets of 4 of these: an entry of a list
   stands for 4 shared bytes.
2. *Tally.* Within a list the postings of the other positions complete the count. Lists of
   up to ``SMALL`` entries tally each pair; in longer ones the entries that share a further
   positional byte, and so reach the minimum, are found by sorting. Further positions come
   after the list's own, so a set of 5 shared bytes is met in one list only.
3. *Verification.* Pairs that reach the minimum are compared by their differing bits.

Only distinct fingerprints enter the index, so copies cost one entry. What shares 5 bytes
has 3 left, so a group holds at most 2^24 entries; it yields links that span it (each
fingerprint to the least one it reaches there), not all its pairs. In groups of ``DENSE``
entries or more the links are found by flipping up to 3 of the 24 free bits, which gives
the same roots as comparing, with work in proportion to the entries.

Defined cases: null and empty texts have fingerprint 0 and are linked like others; a
null doc_id keeps its fingerprint and gets the component of the others with it (null
when there are none); repeated doc_ids keep a row each; very long texts are hashed whole; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import common
from termloom.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Positional bytes that linked fingerprints share at least.
MIN_SHARED = 8 - MAX_BITS
#: The positions that the lists of one set share: all but one of the minimum, of all positions but the last.
SETS = list(combinations(range(7), MIN_SHARED - 1))
#: Up to this many entries a list's pairs are tallied one by one.
SMALL = 8
#: From this many entries the links of a group are found by flipped bits.
DENSE = 3000
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - shingle + 1
    stops = (ends - 1)[shingle - 1 :].tolist()
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops, strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << _BITS).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""

    def made(batch: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(x, shingle) for x in common.byte_texts(batch)], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": fp.view(np.int64)}

    return common.map_batches(common.documents(docs, id_col, text_col), made, "doc_id long, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` linked within ``MAX_BITS`` bits."""
    masks = F.array(*(F.struct(F.lit(i).cast("byte").alias("set"), F.lit(_mask(p)).alias("mask")) for i, p in enumerate(SETS)))
    posted = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.set").alias("set"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("bytes"))
    lists = posted.repartition("set", "bytes").sortWithinPartitions("set", "bytes", "fp")
    return lists.mapInArrow(_search, "a long, b long")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries come in; complete lists are searched, the last one waits for more."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        s, b, fp = (batch.column(c).to_numpy() for c in ("set", "bytes", "fp"))
        if not len(fp):
            continue
        if held and (held[-1][0][-1] != s[0] or held[-1][1][-1] != b[0]):
            yield from _found(*map(np.concatenate, zip(*held, strict=True)))
            held = []
        change = np.flatnonzero((s[1:] != s[:-1]) | (b[1:] != b[:-1]))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            held.append([s[:cut], b[:cut], fp[:cut]])
            yield from _found(*map(np.concatenate, zip(*held, strict=True)))
            held = []
        held.append([s[cut:], b[cut:], fp[cut:]])
    if held:
        yield from _found(*map(np.concatenate, zip(*held, strict=True)))


def tally(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many positional bytes the fingerprints of two columns share."""
    return ((x ^ y).astype("<u8")[..., None].view(np.uint8) == 0).sum(axis=-1)


def _found(s: np.ndarray, b: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    fp = fp.view(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (b[1:] != b[:-1]))))
    size = np.diff(np.append(first, len(fp)))
    left, right = [], []
    for n in range(2, SMALL + 1):
        rows = fp[first[size == n][:, None] + np.arange(n)]  # the lists of n entries
        for i, j in combinations(range(n), 2):
            x, y = rows[:, i], rows[:, j]
            close = tally(x, y) >= MIN_SHARED
            x, y = x[close], y[close]
            close = np.bitwise_count(x ^ y) <= MAX_BITS
            left.append(x[close])
            right.append(y[close])
    for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        own = fp[at : at + n]
        for p in range(max(SETS[int(s[at])]) + 1, 8):  # the postings of a further position
            byte = (own >> np.uint64(8 * p)) & np.uint64(0xFF)
            order = np.argsort(byte, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], byte[order][1:] != byte[order][:-1], [True])))
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if z - a > 1:
                    group = own[order[a:z]]
                    root = _roots(group, (*SETS[int(s[at])], p))
                    other = root != np.arange(len(group))
                    left.append(group[root[other]])
                    right.append(group[other])
    a, b = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (left, right))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _roots(fp: np.ndarray, shared: tuple[int, ...]) -> np.ndarray:
    """For each entry of a group with 5 shared bytes the first entry that it reaches over links within the group."""
    n = len(fp)
    if n < DENSE:
        return _roots_by_pairs(fp)
    # the three bytes that differ, as a number of 24 bits, address a table of the entries
    free = [p for p in range(8) if p not in shared]
    own = sum(((fp >> np.uint64(8 * p)) & np.uint64(0xFF)) << np.uint64(8 * k) for k, p in enumerate(free)).astype(np.int64)
    bits = 8 * len(free)
    where = np.full(1 << bits, -1, np.int32)
    where[own] = np.arange(n)
    root = np.arange(n)
    flips = [sum(1 << b for b in c) for k in range(1, MAX_BITS + 1) for c in combinations(range(bits), k)]
    while True:
        before = root.copy()
        for f in flips:
            there = where[own ^ f]
            here = np.flatnonzero(there >= 0)
            root[here] = np.minimum(root[here], root[there[here]])
        root = _shorten(root)
        if (root == before).all():
            return root


def _roots_by_pairs(fp: np.ndarray) -> np.ndarray:
    """Breadth-first search: each entry is compared once with those not reached yet."""
    n = len(fp)
    root = np.arange(n)
    rest = np.arange(n)
    while len(rest):
        start, rest = rest[0], rest[1:]
        front = [start]
        while front and len(rest):
            x = front.pop()
            close = np.bitwise_count(fp[rest] ^ fp[x]) <= MAX_BITS
            new = rest[close]
            root[new] = start
            front += new.tolist()
            rest = rest[~close]
    return root


def _shorten(root: np.ndarray) -> np.ndarray:
    while True:
        new = root[root]
        if (new == root).all():
            return root
        root = new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (least doc_id that is reachable) of every document."""
    rows, _ = common.materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))  # pre-aggregated: copies are one entry
    edges, _ = common.materialize(links(classes.select("fp")), "links")
    roots = components(edges).withColumnsRenamed({"node": "fp"})
    joined = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    owners = joined.select("fp", "root").join(least, "root").select(F.col("fp").alias("fp_"), "component_id")
    # a frequent fingerprint is one row on the right; its many documents can be split by adaptive execution
    return rows.join(owners, rows.fp == owners.fp_).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
