"""Audit how far the sources of a language differ in their words, in exact integers.

Executors count terms and the documents that hold them in maps of bounded size; Spark adds
the counts up by language, source and term. The terms of a language that enough documents
hold are its dictionary. It is cut into chunks, ranges of terms in UTF-8 order, and a
chunk's group of rows is one task's work: its sorted array of terms gives ids by
``searchsorted``, ``bincount`` lays the counts of a source out as a dense vector, and
scaled probabilities and divergences of all sources are array operations on blocks of
them. Ids keep the order of the terms, so ties need no strings. Chunks give sums by pair and the best
terms by source, both without regard to how many documents there are.

The scaled probability of a term is ``1 + floor(SCALE * (count + 1) / (N + V))``, for the N
occurrences and V terms of the dictionary; the divergence of p from q is
``floor((p - q)^2 / q)``. The division is done in three steps of 1,000, which keeps every
number within 64 bits for N + V up to 9 * 10^15; sums of divergences stay within them too,
as the probabilities add up to SCALE + V at most.

Defined cases: a null text, lang or source is empty, which is a language or source like any
other; repeated rows are documents each; a source without terms has the probabilities of
zero counts; a language without kept terms gives pairs of value 0; ties go by UTF-8; texts
are read whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm import common

SCALE_STEPS, STEP = 3, 1000
SCALE = STEP**SCALE_STEPS
MIN_DOCS, TOP = 3, 200
#: What a worker counts before it hands the counts on: distinct terms of its sources, and their bytes.
HELD_TERMS, HELD_BYTES = 400_000, 32 << 20
#: Rows (language, source, term) of a chunk, about; a term's rows stay together, one a source.
CHUNK_ROWS = 50_000
#: Numbers of an array that a task works on at once.
CELLS = 1 << 20
#: Letters stay, A-Z in lower case, and so does every byte of a character beyond ASCII; all else parts terms.
_PARTED = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_PARTED).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents; a row with an empty term names each group."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    names = ["lang", "source", "term", "n", "d"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]

    def flushed(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in groups.items():
            terms = [b"", *n]
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *(d[t] for t in n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), common.byte_texts(batch), strict=True):
                if (lang, source) not in groups:
                    groups[lang, source] = (Counter(), Counter())
                    held += 1
                n, d = groups[lang, source]
                words = terms_of(text)
                distinct = set(words)
                before = len(n)
                size += sum(map(len, distinct.difference(n)))
                n.update(words)
                d.update(distinct)
                held += len(n) - before
                if held > HELD_TERMS or size > HELD_BYTES:
                    yield from flushed(groups)
                    groups, held, size = {}, 0, 0
        yield from flushed(groups)

    counted = rows.mapInArrow(run, "lang string, source string, term binary, n long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources (``pair``, all) and own terms (``term``, the best ``top``)."""
    counts, _ = common.materialize(term_counts(docs), "term-counts")
    n_chunks = counts.count() // CHUNK_ROWS + 1
    # a chunk is a range of terms; one that two languages meet in is two chunks
    of_term = Window.partitionBy("lang", "term")
    ranged = counts.filter(F.octet_length("term") > 0).repartitionByRange(n_chunks, "lang", "term")
    told = ranged.withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1).withColumn("docs", F.sum("d").over(of_term)).withColumn("total", F.sum("n").over(of_term))
    kept = told.filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "total", "first", F.spark_partition_id().alias("chunk"))
    kept, _ = common.materialize(kept, "kept-terms")

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum(F.col("first").cast("long")).alias("v"))
    groups = counts.filter(F.octet_length("term") == 0).select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("own", "n_lang", "v"))).withColumn("nr", (F.row_number().over(by_source) - 1).cast("long"))
    groups, _ = common.materialize(groups, "groups")

    numbered = kept.join(groups.select("lang", "source", "nr"), ["lang", "source"])
    there = kept.select("lang", "chunk").distinct().join(groups, "lang").toDF("of_lang", "of_chunk", "source", "own", "n_lang", "v", "nr")
    found = numbered.groupBy("lang", "chunk").cogroup(there.groupBy("of_lang", "of_chunk")).applyInArrow(_chunk(top), "lang string, nr long, part string, other long, term binary, value long")
    found, _ = common.materialize(found, "divergences")

    named = groups.select("lang", "nr", "source")
    sums = found.filter("part = 'pair'").groupBy("lang", "nr", "other").agg(F.sum("value").alias("value"))
    pairs = sums.join(named, ["lang", "nr"]).join(named.select("lang", F.col("nr").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    # a language without kept terms has no chunk: its pairs are told from the groups
    mute = groups.filter("v = 0").select("lang", "source")
    silent = mute.join(mute.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = pairs.select("lang", "source", "item", "value").unionByName(silent)
    terms = found.filter("part = 'term'").join(named, ["lang", "nr"]).select("lang", "source", F.col("term").cast("string").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part)) for part, x in (("pair", pairs), ("term", terms))]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def scaled(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / total) by long division in base ``STEP``; counts + 1 is not above total."""
    rest, quotient = counts + 1, np.zeros_like(counts)
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        quotient = quotient * STEP + rest // total
        rest = rest % total
    return quotient + 1


def _chunk(top: int):
    schema = pa.schema([("lang", pa.string()), ("nr", pa.int64()), ("part", pa.string()), ("other", pa.int64()), ("term", pa.binary()), ("value", pa.int64())])

    def rows(lang: str, nr: int, part: str, others: np.ndarray | None, terms: list | None, values: np.ndarray) -> pa.RecordBatch:
        n = len(values)
        columns = [pa.array([lang] * n, pa.string()), pa.array(np.full(n, nr)), pa.array([part] * n), pa.nulls(n, pa.int64()) if others is None else pa.array(others), pa.nulls(n, pa.binary()) if terms is None else pa.array(terms, pa.binary()), pa.array(values)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        column = lambda t, c: t.column(c).to_numpy()
        by_nr = np.argsort(column(groups, "nr"))
        totals = (column(groups, "own") + column(groups, "v"))[by_nr, None]
        of_lang = int(column(groups, "n_lang")[0] + column(groups, "v")[0])
        asked = np.array(counts.column("term").to_pylist(), object)
        terms = np.array(sorted(set(asked.tolist())), object)
        ids, nrs, n = np.searchsorted(terms, asked), column(counts, "nr"), column(counts, "n")
        order = np.argsort(ids, kind="stable")
        ids, nrs, n, lang_counts = ids[order], nrs[order], n[order], np.zeros(len(terms), np.int64)
        lang_counts[ids] = column(counts, "total")[order]
        sources = len(totals)
        sums = np.zeros((sources, sources), np.int64)
        best: list[list[tuple]] = [[] for _ in range(sources)]
        width = max(1, CELLS // sources)
        for start in range(0, len(terms), width):
            end = min(start + width, len(terms))
            a, b = np.searchsorted(ids, [start, end])
            dense = _dense(nrs[a:b], ids[a:b] - start, n[a:b], sources, end - start)
            p, q = scaled(dense, totals), scaled(lang_counts[start:end], of_lang)
            for nr in range(sources):
                sums[nr] += ((p[nr] - p) ** 2 // p).sum(axis=1)
                above = np.flatnonzero((dense[nr] > 0) & (p[nr] > q))
                values = (p[nr, above] - q[above]) ** 2 // q[above]
                first = np.lexsort((above, -values))[:top]
                best[nr] = sorted([*best[nr], *zip((-values[first]).tolist(), (above[first] + start).tolist(), strict=True)])[:top]
        out = []
        for nr in range(sources):
            others = np.delete(np.arange(sources), nr)
            out.append(rows(lang, nr, "pair", others, None, sums[nr, others]))
            out.append(rows(lang, nr, "term", None, [terms[i] for _, i in best[nr]], np.array([-v for v, _ in best[nr]], np.int64)))
        return pa.Table.from_batches(out, schema=schema)

    return run


def _dense(nrs: np.ndarray, ids: np.ndarray, n: np.ndarray, sources: int, width: int) -> np.ndarray:
    """Counts by source and term. ``bincount`` adds in doubles, so counts go in two halves, each exact."""
    at, size = nrs * width + ids, sources * width
    low, high = (np.bincount(at, x, size).astype(np.int64) for x in (n & 0xFFFFFFFF, n >> 32))
    return (low + (high << 32)).reshape(sources, width)
