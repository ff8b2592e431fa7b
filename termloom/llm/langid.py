"""Language identification by the nearest of several TF-IDF centroids per language.

Features: character 1- to 3-grams of the lower-cased text, hashed into ``N_BINS``
bins. Document frequencies are counted over all training documents. Centroids come
from spherical k-means over a bounded sample: about ``SAMPLE_PER_LANG`` documents of
each language, chosen by a hash of their id. A document takes the language of the
centroid with the largest cosine; ``score`` is that cosine. It is *rejected* when its
cosine lies below the least that its language's sample shows, less a margin
(distance-based rejection).

Defined cases: null text, or text without a letter, is ``und`` with score 0 and is
rejected; ties between languages go to the first in alphabetical order; rows whose
language is null are not learned from; without any training row everything is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import common

N_BINS = 4096
#: Bound of the sample from which centroids are fitted, by language.
SAMPLE_PER_LANG = 400
CENTROIDS = 4
#: Languages whose counts a task holds at once.
HELD_LANGS = 64
#: A document may be this share less similar than the least similar of the sample's 99 % nearest.
MARGIN = 0.5
#: Code points handled at once, so that one very long text needs little memory.
CHUNK = 1 << 20

_WORDLIKE = re.compile(r"[^\W\d_]")
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SHIFT = np.uint32(32 - 12)


def has_letter(text: str) -> bool:
    """Whether a character is a letter by its category; fractions and raised digits are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed character 1-, 2- and 3-grams; runs of other characters than letters are one space."""
    out = np.zeros(N_BINS, np.int64)
    text = text.lower()
    for start in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[max(0, start - 2) : start + CHUNK].encode("utf-32-le", "replace"), np.uint32)
        letter = ((codes >= 97) & (codes <= 122)) | (codes >= 192)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of a run that separates words
        c = np.where(letter, codes, np.uint32(32))[keep]
        h = c * _K[0]
        for n in (1, 2, 3):
            if n > 1:
                if len(c) < n:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _K[n - 1] + c[n - 1 :] * _K[0]
            out += np.bincount(h >> _SHIFT, minlength=N_BINS)
    return out


def normalised(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log-scaled term frequency times idf, of length 1."""
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length 1; the first is the mean's nearest row, each next the row farthest from those so far."""
    mean = x.mean(axis=0)
    chosen = [x[np.argmax(x @ mean)]]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[np.argmin((x @ np.array(chosen).T).max(axis=1))])
    centres = np.array(chosen)
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.array([x[nearest == j].sum(axis=0) if (nearest == j).any() else c for j, c in enumerate(centres)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  #: of each centroid
    least: dict[str, float]  #: cosine below which a document of that language is rejected

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        for start in range(0, len(texts), 256):
            part = texts[start : start + 256]
            spoken = [x is not None and has_letter(x) for x in part]
            best = np.zeros(len(part), int)
            cosine = np.zeros(len(part))
            if self.langs and any(spoken):
                at = np.flatnonzero(spoken)
                similar = normalised(np.array([gram_counts(part[i]) for i in at]), self.idf) @ self.centroids.T
                best[at], cosine[at] = similar.argmax(axis=1), similar.max(axis=1).clip(0, 1)
            for ok, b, c in zip(spoken, best, cosine, strict=True):
                lang = self.langs[b] if ok and self.langs else "und"
                out.append((lang, float(c), lang == "und" or c < self.least[lang]))
        return out


def fit(docs: DataFrame, train: Column, lang_col: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG, margin: float = MARGIN) -> LanguageModel:
    """Learn from the rows of ``docs`` where ``train`` holds and the language is known."""
    rows = common.documents(docs.filter(train & F.col(lang_col).isNotNull()), "doc_id", "text", F.col(lang_col).cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each language of a task; languages beyond ``HELD_LANGS`` make it send what it has."""
        df: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}

        def rows_of() -> pa.RecordBatch:
            kinds = {"lang": pa.string(), "n": pa.int64(), "df": pa.list_(pa.int64())}
            values = (list(df), [n[x] for x in df], [x.tolist() for x in df.values()])
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            for text, lang in zip(common.texts(batch), batch.column("lang").to_pylist(), strict=True):
                if has_letter(text):
                    df[lang] = df.get(lang, 0) + (gram_counts(text) > 0)
                    n[lang] = n.get(lang, 0) + 1
                    if len(df) > HELD_LANGS:
                        yield rows_of()
                        df.clear()
        if df:
            yield rows_of()

    partial = rows.mapInArrow(frequencies, "lang string, n long, df array<long>")
    bins = F.posexplode(F.concat("df", F.array("n")))  # the last is the number of documents
    summed = partial.select("lang", bins.alias("bin", "n")).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for row in summed.collect():  # the bins of each language
        found.setdefault(row["lang"], np.zeros(N_BINS + 1, np.int64))[row["bin"]] = row["n"]
    langs = sorted(found)
    if not langs:
        return LanguageModel(np.ones(N_BINS, np.float32), np.zeros((0, N_BINS), np.float32), [], {})
    total = sum(found.values())
    n_docs, df = int(total[-1]), total[:-1]
    idf = (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)

    slots = 1 << 20
    share = {x: min(slots, sample_per_lang * slots // int(c[-1]) + 1) for x, c in found.items()}
    wanted = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")]
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots))
    sampled = rows.withColumn("slot", slot).filter(F.col("slot") < wanted)

    def vectors(batch: pa.RecordBatch) -> dict:
        return {"lang": batch.column("lang"), "slot": batch.column("slot"), "x": [gram_counts(x).astype("<u4").tobytes() if has_letter(x) else None for x in common.texts(batch)]}

    limit = 2 * sample_per_lang * len(langs)
    found_vectors = common.map_batches(sampled, vectors, "lang string, slot long, x binary").filter("x is not null")
    sample = found_vectors.orderBy("slot", "x").limit(limit).collect()  # the same rows in every run
    centroids, owners, least = [], [], {}
    for lang in langs:
        own = sorted(r["x"] for r in sample if r["lang"] == lang)
        if own:
            x = normalised(np.array([np.frombuffer(v, "<u4") for v in own]), idf)
            centres = spherical_kmeans(x, CENTROIDS)
            centroids.append(centres)
            owners += [lang] * len(centres)
            least[lang] = float(np.quantile((x @ centres.T).max(axis=1), 0.01) * (1 - margin))
    return LanguageModel(idf, np.concatenate(centroids), owners, least)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document."""
    def predicted(batch: pa.RecordBatch) -> dict:
        rows = model.predict(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "rejected": [r[2] for r in rows]}

    return common.map_batches(common.documents(docs, id_col, text_col), predicted, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    def keep(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for start in range(0, batch.num_rows, common.BATCH_ROWS):
                part = batch.slice(start, common.BATCH_ROWS)
                yield part.filter(pa.array([not r[2] for r in model.predict(part.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
