"""Near copies at a similarity of five-word shingles: SimHash, completed by MinHash, decided exactly.

Words are those of ``simhash``; the shingles of a text are its runs of ``SHINGLE`` words
(a shorter text is one shingle), as XXH64 hashes. Two texts are linked if the Jaccard
similarity of their shingle sets is at least ``MIN_JACCARD``.

Candidates come from the SimHash operator: fingerprints of these shingles, linked through
its byte-position index at 3 or fewer differing bits. This alone does not give right
results at 0.8: such a pair differs in 10 of 64 bits on average, and one in twelve shares
no byte at all, so no count of shared bytes can retain it. So ``BANDS`` bands of ``ROWS``
MinHash minima over the same hashes complete the candidates: a pair of similarity s shares
a band with probability 1 - (1 - s^ROWS)^BANDS, which is 0.99994 at 0.8 and more above.

Texts are known by 64 bits of hash, so equal texts are one entry. A band's list yields
a star, not its pairs, so candidates are linear in the input. The components of the
candidates, called clusters, hold all links found; in each the shingle sets decide:

- Clusters of up to ``CLUSTER_BYTES`` of text are searched in one task, breadth first: an
  entry is compared once with all that are not reached yet.
- Larger ones never meet in one task. Each entry is first compared with one candidate, in
  parts of ``CHUNK`` entries a task. What is still outside the largest component then is
  cut into blocks, and every entry of the cluster is streamed past each block, which finds
  all links between different components. Memory is that of a block; the work grows with
  the entries outside times the cluster.

Defined cases: null and empty texts are equal; a null doc_id takes part in links; rows that
repeat get the same component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import common, simhash
from termloom.llm.components import components

SHINGLE = 5
MIN_JACCARD = 0.8
SEED = 42
BANDS = 32
#: Text bytes of a cluster, or of a block of a larger one, that a task holds.
CLUSTER_BYTES = 16 << 20
#: Entries of a large cluster that one task streams.
CHUNK = 50_000
ROWS = 6
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def shingle_hashes(text: bytes) -> np.ndarray:
    """The hashes of the shingles of a text, repeats included."""
    words = text.lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - SHINGLE + 1].tolist()
    stops = (ends - 1)[SHINGLE - 1 :].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(shingle_hashes(text))


def band_hashes(hashes: np.ndarray) -> list[int]:
    """One signed long for each band; the band's number is part of it."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1 << 11):
        least = np.minimum(least, (short[at : at + (1 << 11), None] * _FACTORS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries (band, key) come in; each list links its first key with the others."""
    last = None
    for batch in batches:
        band, key = (batch.column(c).to_numpy() for c in ("band", "key"))
        if not len(key):
            continue
        new = np.concatenate(([last is None or last[0] != band[0]], band[1:] != band[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(at >= 0, key[at], last[1] if last else 0)
        last = (band[-1], first[-1])
        other = first != key
        if other.any():
            yield pa.RecordBatch.from_arrays([pa.array(first[other]), pa.array(key[other])], names=["a", "b"])


def roots_of(sets: list[np.ndarray], min_jaccard: float = MIN_JACCARD) -> np.ndarray:
    """For each shingle set the first one that it reaches over links."""
    root = np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    own = np.split(ids, np.cumsum(size)[:-1])
    mark = np.zeros(int(ids.max()) + 1, bool)
    held, flat, rest = np.arange(len(sets)), ids, np.ones(len(sets), bool)  # rest: which of the held ones are not reached yet
    front: list[int] = []
    while rest.any():
        if not front:
            start = int(held[np.argmax(rest)])
            rest[np.argmax(rest)] = False
            front = [start]
        if 2 * rest.sum() < len(held):
            held = held[rest]
            rest = np.ones(len(held), bool)
            if not len(held):
                break
            flat = np.concatenate([own[i] for i in held])
        x = front.pop()
        mark[own[x]] = True
        starts = np.concatenate(([0], np.cumsum(size[held])[:-1]))
        common_ = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own[x]] = False
        close = rest & (common_ >= min_jaccard * (size[x] + size[held] - common_) - 1e-9)
        root[held[close]] = start
        front += held[close].tolist()
        rest &= ~close
    return root


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (cluster, key, text) come in; links of complete clusters go out."""
    keys: list[int] = []
    sets: list[np.ndarray] = []

    def found() -> Iterator[pa.RecordBatch]:
        if len(keys) > 1:
            own = np.array(keys, np.int64)
            root = roots_of(sets)
            other = root != np.arange(len(own))
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(own[root[other]]), pa.array(own[other])], names=["a", "b"])

    for _, new, row in _groups(batches, ["cluster"]):
        if new:
            yield from found()
            keys, sets = [], []
        keys.append(row["key"])
        sets.append(shingles(row["text"]))
    yield from found()


def jaccard(hits: np.ndarray, size: np.ndarray | int, n: int) -> np.ndarray:
    return hits / np.maximum(size + n - hits, 1)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, bool, dict]]:
    """(group, whether it is new, row) of sorted rows."""
    last = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in names]
        rest = {c: batch.column(c).to_pylist() for c in ("kind", "key", "root") if c in batch.schema.names}
        texts = common.byte_texts(batch)
        for i, group in enumerate(zip(*columns, strict=True)):
            yield group, group != last, {c: x[i] for c, x in rest.items()} | {"text": texts[i]}
            last = group


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _against_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group the centre comes first; entries that are alike are linked with it."""
    own, out = np.zeros(0, np.uint64), ([], [])
    for (centre, _), _, row in _groups(batches, ["centre", "part"]):
        x = shingles(row["text"])
        if row["kind"] == 0:
            own = x
        elif jaccard(np.intersect1d(own, x, True).size, len(own), len(x)) >= MIN_JACCARD - 1e-9:
            out[0].append(centre)
            out[1].append(row["key"])
            if len(out[0]) >= 10_000:
                yield _links(*out)
                out = ([], [])
    if out[0]:
        yield _links(*out)


def _against_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group the block comes first; entries that are alike but of another component are linked with its own."""
    keys: list[int] = []
    roots: list[int] = []
    sets: list[np.ndarray] = []
    flat = owner = size = None
    told: set[tuple[int, int]] = set()
    for _, new, row in _groups(batches, ["cluster", "block", "part"]):
        if new:
            keys, roots, sets, flat, told = [], [], [], None, set()
        x = shingles(row["text"])
        if row["kind"] == 0:
            keys.append(row["key"])
            roots.append(row["root"])
            sets.append(x)
            continue
        if not sets:  # nothing outside fell into this block
            continue
        if flat is None:
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
            order = np.argsort(flat, kind="stable")
            flat, owner, size = flat[order], owner[order], np.array([len(v) for v in sets])
        low, high = np.searchsorted(flat, x), np.searchsorted(flat, x, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        near = jaccard(np.bincount(owner[at], minlength=len(sets)), size, len(x)) >= MIN_JACCARD - 1e-9
        found = [(keys[i], row["root"]) for i in np.flatnonzero(near).tolist() if roots[i] != row["root"] and (keys[i], row["root"]) not in told]
        if found:
            told.update(found)
            yield _links(*map(list, zip(*found, strict=True)))


def _large_links(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Links (a, b) in clusters too large for a task, from their texts (cluster, key, text)."""
    hashed = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    centres = edges.filter("a != b").groupBy(high.alias("key")).agg(F.min(low).alias("centre"))
    own = members.join(centres, "key").select("centre", "key", "text")
    parts = own.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("n_parts"))
    entries = own.join(parts, "centre").select("centre", hashed(F.col("n_parts")).alias("part"), F.lit(1).alias("kind"), "key", "text")
    every = F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part")
    heads = members.join(parts, F.col("key") == F.col("centre")).select("centre", every, F.lit(0).alias("kind"), "key", "text")
    dealt = heads.unionByName(entries).repartition("centre", "part").sortWithinPartitions("centre", "part", "kind")
    first, _ = common.materialize(dealt.mapInArrow(_against_centre, "a long, b long"), "centre-links")

    rooted = members.join(components(first).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    counts = rooted.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("n_bytes"))
    core = F.max(F.struct("n", "root", "n_bytes"))
    plans = counts.groupBy("cluster").agg(core.alias("core"), F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    outside = F.col("n_bytes") - F.col("core.n_bytes")
    plans = plans.filter(F.col("n") > F.col("core.n")).select(
        F.col("cluster").alias("cluster_"),
        F.col("core.root").alias("core"),
        (F.floor(outside / F.lit(CLUSTER_BYTES)) + 1).cast("int").alias("n_blocks"),
        F.ceil(F.col("n") / F.lit(CHUNK)).cast("int").alias("n_parts"),
    )
    planned = rooted.join(plans, F.col("cluster") == F.col("cluster_"))
    block, part = hashed(F.col("n_blocks")), hashed(F.col("n_parts"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = planned.filter("root != core").select("cluster", block.alias("block"), spread("n_parts").alias("part"), F.lit(0).alias("kind"), "key", "root", "text")
    right = planned.select("cluster", spread("n_blocks").alias("block"), part.alias("part"), F.lit(1).alias("kind"), "key", "root", "text")
    dealt = left.unionByName(right).repartition("cluster", "block", "part").sortWithinPartitions("cluster", "block", "part", "kind")
    return first.unionByName(dealt.mapInArrow(_against_block, "a long, b long"))


def _simhash_edges(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between the keys of linked fingerprints; a fingerprint is known by its least key."""
    owners = distinct.groupBy("fp").agg(F.min("key").alias("least"))
    same = distinct.select("key", "fp").join(owners, "fp").filter("key > least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    links, _ = common.materialize(simhash.links(owners.select("fp")), "simhash-links")
    names = (owners.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_key")) for c in ("a", "b"))
    joined = links.distinct()
    for name, c in zip(names, ("a", "b"), strict=True):
        joined = joined.join(name, c)
    return same.unionByName(joined.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (hash of the text) and component (least key that is reachable) of every row."""
    texts = common.documents(docs, id_col, text_col, text_key(text_col).alias("key"))

    def made(batch: pa.RecordBatch) -> dict:
        texts = common.byte_texts(batch)
        hashes = [shingle_hashes(x) for x in texts]
        fp = np.array([simhash.majority(h) for h in hashes], np.uint64).view(np.int64)
        bands = [band_hashes(np.unique(h)) for h in hashes]
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "fp": fp, "n_bytes": [len(x) for x in texts], "bands": bands}

    rows, _ = common.materialize(common.map_batches(texts, made, "doc_id long, key long, fp long, n_bytes long, bands array<long>"), "bands")
    distinct = rows.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    lists = distinct.select("key", F.explode("bands").alias("band")).repartition("band").sortWithinPartitions("band", "key")
    stars = lists.mapInArrow(_stars, "a long, b long")
    edges, _ = common.materialize(stars.unionByName(_simhash_edges(distinct)).distinct(), "candidates")
    candidates = components(edges).select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    sized = candidates.join(rows.groupBy("key").agg(F.first("n_bytes").alias("n_bytes")), "key")
    large = sized.groupBy("cluster").agg((F.sum("n_bytes") > CLUSTER_BYTES).alias("large"))
    placed = candidates.join(large, "cluster")
    shipped = texts.select("key", "text").join(placed, "key").groupBy("cluster", "key", "large").agg(F.first("text").alias("text"))
    shipped, _ = common.materialize(shipped, "candidate-texts")
    small = shipped.filter("not large").repartition("cluster").sortWithinPartitions("cluster", "key").mapInArrow(_verify, "a long, b long")
    links = small.unionByName(_large_links(shipped.filter("large").select("cluster", "key", "text"), edges))
    links, _ = common.materialize(links, "near-copies")
    roots = components(links).select(F.col("node").alias("key"), "root")
    return rows.select("doc_id", "key").join(roots, "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("component"))
