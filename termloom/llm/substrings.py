"""Substring dedup: recurring passages by sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words (words are runs of other characters than
ASCII white space). Every word that is covered by a window whose word sequence also
starts in a document with a smaller doc_id is removed.

1. *Candidates.* Of the 8 overlapping 6-word seeds of a window the one with the least
   hash stands for it. Equal windows have equal seeds, so a window can recur only if
   its seed does. About a quarter of the positions is shuffled; of the documents of a seed
   in one batch only the least and the greatest.
2. *Confirmation.* Windows with a recurring seed are grouped by 96 bits of hash, from two
   hashes of each word that share no factor; of the documents of a window a shard sends
   the least and the greatest. The least of a group is its origin.
3. *Automata.* Documents are dealt into shards of bounded size by a hash of their
   text. A shard gets the confirmed windows that occur in it, joins neighbouring ones
   of one origin to passages, compiles an automaton over the passages' words and
   streams all its documents through it. An occurrence in a document later than the
   passage's origin removes its words.

No document meets an automaton that cannot match it, so the work grows in proportion
to the input. A frequent seed or window is two rows a shard, however many documents have
it; its sorted rows are read in batches and only the first is held. A task holds one shard
at a time, so the number of partitions does not depend on that of shards: it is bounded by
``MAX_PARTITIONS``. Copies (equal texts) are reduced to
their least doc_id before anything else, in each batch and again in the shard: all
windows of the others start in a smaller document.

Defined cases: a null text has no words; a row with a null doc_id is no origin and
keeps all its words; rows that repeat both id and text are one document and give one
row; rows that share an id but not the text are judged one by one and are no origin for
each other; texts shorter than a window keep everything; very long texts are cut into
windows like others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import common

WINDOW = 13
SEED_WORDS = 6
#: Text bytes of a shard, which one task holds with its automaton.
SHARD_BYTES = 4 << 20
#: Text bytes of a partition: many shards, one after the other.
PARTITION_BYTES = 128 << 20
#: Partitions at most; beyond that they grow.
MAX_PARTITIONS = 100_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_NONE = np.iinfo(np.int64).max
#: Windows of a pattern at most, which bounds the automaton's depth.
CHUNK = 64
#: Letters of a word that no passage has.
_OTHER_WORD = "\0\0\0"


_INSIDE = np.ones(256, bool)
_INSIDE[list(common.WORD_SPACE)] = False
#: Factors of the places of a byte in its word, for each of two hashes; later places have theirs computed.
_TABLES = [np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20, 21)]


def _factors(place: np.ndarray, longest: int, table: int) -> np.ndarray:
    """An odd factor for each place; none comes back after any number of places."""
    if longest <= 4096:
        return _TABLES[table][place]
    x = place.astype(np.uint64) + np.uint64(table << 60)
    for by in (_A, _B):
        x = (x ^ (x >> np.uint64(30))) * by
    return np.where(place < 4096, _TABLES[table][place & 4095], (x ^ (x >> np.uint64(31))) | np.uint64(1))


def word_hashes(text: bytes, table: int = 0) -> np.ndarray:
    """A 64-bit number for each word of a text, from its bytes and their places."""
    if not text:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(text, np.uint8)
    inside = _INSIDE[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    if inside[-1]:
        edges = np.concatenate((edges, [len(b)]))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    shift = np.repeat(np.cumsum(lengths) - lengths, lengths)  # place among all bytes of words, less that in the word
    place = np.arange(len(shift)) - shift
    value = b[inside].astype(np.uint64)
    value += np.uint64(1)
    value *= _factors(place, int(lengths.max()), table)
    sums = np.add.reduceat(value, np.cumsum(lengths) - lengths)
    sums ^= sums >> np.uint64(32)
    return sums * _C


def _rolled(h: np.ndarray, n: int, by: np.uint64) -> np.ndarray:
    """A hash of each n consecutive numbers."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * by + h[j : len(h) - n + 1 + j]
    out ^= out >> np.uint64(31)
    return out * _C


def window_seeds(h: np.ndarray, window: int) -> np.ndarray:
    """For each window the least hash of its seeds."""
    size = min(SEED_WORDS, window)
    s = _rolled(h, size, _A)
    span = window - size + 1
    out = s[: len(s) - span + 1]
    for j in range(1, span):
        out = np.minimum(out, s[j : len(s) - span + 1 + j])
    return out


def window_keys(text: bytes, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and another 32 bits of each window; ``h`` are the text's first word hashes."""
    return _rolled(h, window, _A).view(np.int64), _second_keys(text, window)


def _second_keys(text: bytes, window: int) -> np.ndarray:
    return (_rolled(word_hashes(text, 1), window, _B) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _numbers(n: int, kind) -> list:
    return [np.zeros(0, kind)] * n


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, keep_layout: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space) and digest (md5 of the text as it was).

    With ``keep_layout`` a text that loses no word stays as it was, white space included.
    """
    rows = common.documents(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    known = rows.filter("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = int(total // shard_bytes) + 1
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = min(n_shards, MAX_PARTITIONS, max(partitions, int(total // PARTITION_BYTES) + 1))

    # equal texts meet in a shard; of those in one batch only the least id goes there
    sharded = common.map_batches(known, _least_of_equals, "doc_id long, text string")
    sharded = sharded.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(n_shards)).cast("int"))
    texts = sharded.repartition(partitions, "shard").groupBy("shard", "text").agg(F.min("doc_id").alias("doc_id"))

    def seeds(batch: pa.RecordBatch) -> dict:
        found, owners, shards = _numbers(1, np.int64), _numbers(1, np.int64), _numbers(1, np.int32)
        for text, doc_id, shard in zip(common.byte_texts(batch), batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist(), strict=True):
            h = word_hashes(text)
            if len(h) >= window:
                own = np.unique(window_seeds(h, window)).view(np.int64)
                found.append(own)
                owners.append(np.full(len(own), doc_id, np.int64))
                shards.append(np.full(len(own), shard, np.int32))
        seed, shard, doc = _least_and_greatest([np.concatenate(found), np.concatenate(shards)], np.concatenate(owners))
        return {"seed": pa.array(seed), "doc_id": pa.array(doc), "shard": pa.array(shard)}

    by_seed = common.map_batches(texts, seeds, "seed long, doc_id long, shard int").repartition(partitions, "seed").sortWithinPartitions("seed", "doc_id")
    recurring = by_seed.mapInArrow(_recurring, "shard int, seed long")

    def candidates(key, left, right):
        wanted = np.unique(right.column("seed").to_numpy()).view(np.uint64)
        wanted.sort()
        parts: list[list[np.ndarray]] = [[], [], []]
        for text, doc_id in zip(left.column("text").cast(pa.binary()).to_pylist(), left.column("doc_id").to_pylist(), strict=True):
            h = word_hashes(text) if len(wanted) else wanted
            if len(h) < window:
                continue
            at = _within(window_seeds(h, window), wanted)
            if at.any():
                k, k2 = window_keys(text, h, window)
                for part, x in zip(parts, (k[at], k2[at], np.full(int(at.sum()), doc_id, np.int64)), strict=True):
                    part.append(x)
        k, k2, doc = (np.concatenate([*_numbers(1, t), *p]) for p, t in zip(parts, (np.int64, np.int32, np.int64), strict=True))
        columns = _least_and_greatest([k, k2], doc)
        shard = np.full(len(columns[0]), key[0].as_py(), np.int32)
        return pa.Table.from_arrays([pa.array(x) for x in (*columns, shard)], names=["k", "k2", "doc_id", "shard"])

    windows = texts.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(candidates, "k long, k2 int, doc_id long, shard int")
    by_window = windows.repartition(partitions, "k", "k2").sortWithinPartitions("k", "k2", "doc_id")
    origins = by_window.mapInArrow(_origins, "shard int, k long, k2 int, origin long")

    def cleaned(key, left, right):
        return _clean_shard(left, right, window, keep_layout)

    schema = "doc_id long, n_words long, n_removed long, text string, digest string"
    kept = texts.groupBy("shard").cogroup(origins.groupBy("shard")).applyInArrow(cleaned, schema)

    # the other copies, and rows without id, need no text of others
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    plain = rows.select("doc_id", F.md5("text").alias("digest"), words.alias("words"), "text")
    n = F.size("words").cast("long")
    whole = F.col("text") if keep_layout else F.array_join("words", " ")
    kept_text = F.when((n < window) | F.col("doc_id").isNull(), whole).otherwise(F.lit(""))
    plain = plain.select("doc_id", n.alias("n_words"), kept_text.alias("text"), "digest")
    least = known.groupBy(F.md5("text").alias("digest_")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    copies = plain.filter("doc_id is not null").join(least, F.col("digest") == F.col("digest_")).filter("doc_id > least")
    copies = copies.groupBy("doc_id", "digest").agg(F.first("n_words").alias("n_words"), F.first("text").alias("text"))
    removed = F.when(F.col("n_words") >= window, F.col("n_words")).otherwise(F.lit(0)).cast("long")
    copies = copies.select("doc_id", "n_words", removed.alias("n_removed"), "text", "digest")
    unnamed = plain.filter("doc_id is null").dropDuplicates(["digest"]).withColumn("n_removed", F.lit(0).cast("long"))
    return kept.unionByName(copies).unionByName(unnamed)


def _least_of_equals(batch: pa.RecordBatch) -> dict:
    least: dict[str, int] = {}
    for text, doc_id in zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
        if (other := least.get(text)) is None or doc_id < other:
            least[text] = doc_id
    return {"doc_id": list(least.values()), "text": list(least)}


def _within(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    slot = np.searchsorted(wanted, values)
    slot[slot == len(wanted)] = 0
    return wanted[slot] == values


def _least_and_greatest(keys: list[np.ndarray], doc: np.ndarray) -> list[np.ndarray]:
    """Rows (keys and document) of the least and the greatest document of each key; one row if they are the same."""
    if not len(doc):
        return [*keys, doc]
    order = np.lexsort((doc, *keys[::-1]))
    rows = [x[order] for x in (*keys, doc)]
    new = np.logical_or.reduce([x[1:] != x[:-1] for x in rows])
    rows = [x[np.concatenate(([True], new))] for x in rows]
    change = np.logical_or.reduce([x[1:] != x[:-1] for x in rows[:-1]])
    ends = np.concatenate(([True], change)) | np.concatenate((change, [True]))
    return [x[ends] for x in rows]


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by seed and doc_id those whose seed is in two documents or more.

    Between batches the last run waits: whole while it has one document, else by one row.
    """
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    told = False  # whether the rows of the held run are out already
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy() for c in ("seed", "doc_id", "shard")]
        n_held = len(held[0])
        seed, doc, shard = (np.concatenate(x) for x in zip(held, new, strict=True))
        first = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
        size = np.diff(np.append(first, len(seed)))
        many = doc[first + size - 1] != doc[first]
        if told:
            many[0] = True
        out = np.repeat(many, size)
        if told:
            out[:n_held] = False
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(shard[out]), pa.array(seed[out])], names=["shard", "seed"])
        told = bool(many[-1])
        keep = slice(len(seed) - 1, None) if told else slice(int(first[-1]), None)
        held = [x[keep].copy() for x in (seed, doc, shard)]


def _origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by window and doc_id, for each later document's shard the window and its first document."""
    k_, k2_, origin_ = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k, k2, doc, shard = (batch.column(c).to_numpy() for c in ("k", "k2", "doc_id", "shard"))
        start = np.concatenate(([True], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])))
        run = np.cumsum(start) - 1
        origin = doc[start]
        if k[0] == k_ and k2[0] == k2_:
            origin = origin.copy()
            origin[0] = origin_
        k_, k2_, origin_ = k[-1], k2[-1], origin[-1]
        own = origin[run]
        later = doc > own
        if later.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[later]) for x in (shard, k, k2, own)], names=["shard", "k", "k2", "origin"])


def _clean_shard(left: pa.Table, right: pa.Table, window: int, keep_layout: bool) -> pa.Table:
    ids = left.column("doc_id").to_pylist()
    originals = left.column("text").cast(pa.binary()).to_pylist()
    passages = Passages(ids, originals, *(right.column(c).to_numpy() for c in ("k", "k2", "origin")), window)
    out: dict[str, list] = {"doc_id": ids, "n_words": [], "n_removed": [], "text": [], "digest": []}
    for doc_id, original in zip(ids, originals, strict=True):
        words = original.split()
        covered = passages.covered(doc_id, words)
        n = 0 if covered is None else int(covered.sum())
        if n:
            words_left = [words[i] for i in np.flatnonzero(~covered).tolist()]
        text = b" ".join(words_left if n else words) if n or not keep_layout else original
        for name, value in (("n_words", len(words)), ("n_removed", n), ("text", text.decode()), ("digest", hashlib.md5(original).hexdigest())):
            out[name].append(value)
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "text": pa.string(), "digest": pa.string()}
    return pa.table(out, pa.schema(list(kinds.items())))


class Passages:
    """The automaton over a shard's confirmed passages.

    Its letters are digits of word numbers, three a word, each place with digits of its
    own, so that matches begin and end at words, no node has many children, and the
    depth depends on the number of words only, however long they are. A passage of more
    windows than ``CHUNK`` is several patterns; together they cover the same words.
    """

    def __init__(self, ids: list[int], texts: list[bytes], k: np.ndarray, k2: np.ndarray, origin: np.ndarray, window: int):
        self.automaton = None
        if not len(k):
            return
        order = np.lexsort((k2, k))  # a window has one origin
        k, k2, origin = k[order], k2[order], origin[order]
        found: dict[tuple[bytes, ...], int] = {}
        for doc_id, text in zip(ids, texts, strict=True):
            h = word_hashes(text)
            if len(h) < window:
                continue
            keys = _rolled(h, window, _A).view(np.int64)
            slot = np.searchsorted(k, keys)
            slot[slot == len(k)] = 0
            same = k[slot] == keys
            if not same.any():
                continue
            keys2 = _second_keys(text, window)
            while (more := np.flatnonzero(same & (k2[slot] != keys2))).size:  # windows that share the first half only
                slot[more] = np.minimum(slot[more] + 1, len(k) - 1)
                same[more] = (k[slot[more]] == keys[more]) & ((k2[slot[more]] == keys2[more]) | (slot[more] < len(k) - 1))
            first = np.where(same, origin[slot], _NONE)
            first[first >= doc_id] = _NONE
            if (first == _NONE).all():
                continue
            words = text.split()
            edge = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1], [True]))).tolist()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if first[a] != _NONE:
                    for start in range(a, b, CHUNK):
                        found[tuple(words[start : min(b, start + CHUNK) + window - 1])] = int(first[a])
        distinct = dict.fromkeys(w for passage in found for w in passage)
        base = int(len(distinct) ** (1 / 3)) + 2
        self.letters = {w: chr(1 + i % base) + chr(5001 + i // base % base) + chr(10001 + i // base // base) for i, w in enumerate(distinct)}
        if not found:
            return
        self.automaton = ahocorasick.Automaton()
        for passage, first_doc in found.items():
            self.automaton.add_word("".join(map(self.letters.__getitem__, passage)), (len(passage), first_doc))
        self.automaton.make_automaton()

    def covered(self, doc_id: int, words: list[bytes]) -> np.ndarray | None:
        """Words of a document that lie in passages of smaller documents; nothing if there are none."""
        if self.automaton is None:
            return None
        get = self.letters.get
        stream = "".join([get(w, _OTHER_WORD) for w in words])
        found = [(end, n) for end, (n, origin) in self.automaton.iter(stream) if origin < doc_id]
        if not found:
            return None
        end, n = np.array(found).T
        last = end // 3 + 1
        step = np.bincount(last - n, minlength=len(words) + 1) - np.bincount(last, minlength=len(words) + 1)
        return np.cumsum(step[:-1]) > 0
