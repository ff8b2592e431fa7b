"""Quality rules: distribution divergence of a document from its language.

For each document two histograms are made: the character classes of its words, and the
common words of its language with one bin for all other words. Both sides of the
comparison are learned from the corpus, for whatever languages it has:

1. The common words of a language are the ``COMMON`` words that occur in most of its
   documents (ties: the least word).
2. The reference of a language is the mean histogram of all its documents that pass the
   base rules.

A document is kept if the Jensen-Shannon distances (square root, base 2, so 0 to 1) of
both histograms stay within their bounds. Guards: short documents have noisy histograms,
so each test says nothing below a least number of characters or words; few documents
give a noisy reference, so a language with fewer than ``MIN_DOCS`` documents has none.

Defined cases: null or empty text has no words and fails the base rules; a null language
is compared with every reference and the nearest counts; for a language without
reference only the base rules speak, and so they do for all where there is none; rows
that repeat each count and each get their verdict; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm import common

#: Common words of a language.
COMMON = 20
#: Documents that a language needs for a reference.
MIN_DOCS = 30
#: Words of languages that a task holds before it sends their counts.
HELD_WORDS = 200_000
PUNCTUATION = ".,;:!?"
MAX_CHAR_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.29
MIN_CHARS = 200
MIN_WORDS = 100
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "sentence", "symbol", "other_ascii", "beyond_ascii")


def _class_table() -> np.ndarray:
    """Class of each byte; 7 for white space and continuation bytes, which are no characters of words."""
    table = np.full(256, 5, np.uint8)
    table[0x80:0xC0] = 7
    table[0xC0:] = 6
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", SYMBOLS)):
        table[list(chars)] = k
    table[list(common.WORD_SPACE)] = 7
    return table


_TABLE = _class_table()
_NO_CHARACTER = common.WORD_SPACE + bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    n = len(index)
    pair = ids[:-2] * n + ids[1:-1]
    if n >= 2_000_000:  # three ids would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, counts = np.unique(pair * n + ids[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] >= 2
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


_EDGE = PUNCTUATION.encode()


def measure(text: bytes, slots: dict[bytes, int]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, and the common words' slots and counts."""
    words = text.split()
    lines = Counter(x for x in text.split(b"\n") if x.strip())
    classes = np.bincount(_TABLE[np.frombuffer(text, np.uint8)], minlength=8)[:7]
    found: Counter[int] = Counter()
    for w, n in Counter(words).items():
        if (slot := slots.get(w.strip(_EDGE).lower())) is not None:
            found[slot] += n
    return (
        len(words),
        len(text.translate(None, _NO_CHARACTER)),
        len(text) - len(text.translate(None, SYMBOLS)),
        sum(lines.values()) - len(lines),
        repeated_words(words),
        classes,
        list(found),
        list(found.values()),
    )


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of ``p`` from the histogram ``q``."""
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1e-12)
    q = q / max(q.sum(), 1e-12)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def common_words(rows: DataFrame, n: int = COMMON, min_docs: int = MIN_DOCS) -> dict[str, list[bytes]]:
    """The words of each language (of rows lang, text) that most of its documents have."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def sent() -> pa.RecordBatch:
            flat = [(x, w, c) for x, found in held.items() for w, c in found.items()]
            kinds = {"lang": pa.string(), "word": pa.binary(), "n": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*flat, strict=True), kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), common.byte_texts(batch), strict=True):
                own = {w.strip(_EDGE) for w in set(text.lower().split())}
                own.add(b"")  # counts the documents
                held.setdefault(lang, Counter()).update(own)
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    # partial counts are added up before and after the shuffle; the first n of each part go on
    totals = rows.filter("lang is not null").mapInArrow(counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")  # the empty word, which all documents have, is the first
    best = totals.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= n + 1)
    out: dict[str, list[bytes]] = {}
    for r in best.filter((F.col("word") != b"") | (F.col("n") >= min_docs)).orderBy("lang", "i").collect():  # n + 1 rows a language
        if not r["word"]:
            out[r["lang"]] = []
        elif r["lang"] in out:
            out[r["lang"]].append(bytes(r["word"]))
    return out


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    words: dict[str, list[bytes]] | None = None,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    n_common: int = COMMON,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """One row per document: counts, base_failed, both distances and kept.

    The texts are read twice: for the common words (unless ``words`` gives them by
    language) and for the counts; what later steps need (some tens of numbers per
    document) is written to the shared folder. The references are sums over all
    documents, added up within each task before they are shuffled.
    """
    rows = common.documents(docs, id_col, text_col, F.col(lang_col).cast("string").alias("lang"))
    lists = common_words(rows.select("lang", "text"), n_common, min_docs) if words is None else words
    vocabulary = sorted({w for x in lists.values() for w in x})
    slots, width = {w: i for i, w in enumerate(vocabulary)}, max(map(len, lists.values()), default=0) + 1
    # for each language the bin of each slot; the last bin is that of other words
    bins = {x: np.full(len(vocabulary), width - 1) for x in lists}
    for x, own in lists.items():
        bins[x][[slots[w] for w in own]] = np.arange(len(own))

    def counts(batch: pa.RecordBatch) -> dict:
        found = [measure(x, slots) for x in common.byte_texts(batch)]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "slots", "hits")
        return dict(zip(names, zip(*found, strict=True), strict=True)) | {"doc_id": batch.column("doc_id"), "lang": batch.column("lang")}

    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted, _ = common.materialize(
        common.map_batches(rows, counts, schema + ", classes array<long>, slots array<int>, hits array<long>").withColumn("base_failed", base), "quality"
    )

    def sums(batch: pa.RecordBatch) -> dict | None:
        out: dict[str, list] = {"lang": [], "histogram": []}
        lang = np.array(batch.column("lang").to_pylist(), object)
        classes = _classes(batch)
        for x in bins:
            if (at := lang == x).any():
                shares = [m / np.maximum(m.sum(axis=1, keepdims=True), 1) for m in (classes[at], _commons(batch, at, bins[x], width))]
                out["lang"].append(x)
                out["histogram"].append(np.concatenate([m.sum(axis=0) for m in shares]))
        return out

    totals = (
        common.map_batches(counted.filter(~F.col("base_failed")), sums, "lang string, histogram array<double>")
        .groupBy("lang")
        .agg(*(F.sum(F.col("histogram")[i]).alias(f"h{i}") for i in range(len(CLASSES) + width)))
        .collect()  # a row for each language with common words
    )
    references = {r["lang"]: np.array(r[1:], float) for r in totals}

    def verdicts(batch: pa.RecordBatch) -> dict:
        classes = _classes(batch)
        lang = np.array(batch.column("lang").to_pylist(), object)
        far = np.full((batch.num_rows, 2), np.inf)
        for x in sorted(references):
            at = np.flatnonzero((lang == x) | (lang == None))  # noqa: E711
            if len(at):
                r = references[x]
                d = np.stack([js_distance(classes[at], r[: len(CLASSES)]), js_distance(_commons(batch, at, bins[x], width), r[len(CLASSES) :])], axis=1)
                nearer = d.sum(axis=1) < far[at].sum(axis=1)
                far[at[nearer]] = d[nearer]
        far[np.isinf(far)] = 0
        names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        return {c: batch.column(c) for c in names} | {"char_distance": far[:, 0], "word_distance": far[:, 1]}

    char_ok = (F.col("word_chars") < min_chars) | (F.col("char_distance") <= max_char_distance)
    word_ok = (F.col("n_words") < min_words) | (F.col("word_distance") <= max_word_distance)
    judged = schema.replace("lang string, ", "") + ", base_failed boolean, char_distance double, word_distance double"
    return common.map_batches(counted, verdicts, judged).withColumn("kept", ~F.col("base_failed") & char_ok & word_ok)


def _classes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("classes").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)


def _commons(batch: pa.RecordBatch, at: np.ndarray, bins: np.ndarray, width: int) -> np.ndarray:
    """Counts of a language's common words, and of all others, in the chosen documents."""
    lists = batch.column("slots")
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    place = bins[lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] if len(bins) else np.zeros(0, np.int64)
    hits = batch.column("hits").flatten().to_numpy(zero_copy_only=False)
    out = np.bincount(row * width + place, weights=hits, minlength=batch.num_rows * width).reshape(-1, width)[at]
    out[:, -1] = 0
    out[:, -1] = batch.column("n_words").to_numpy()[at] - out.sum(axis=1)
    return out
