"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the model's pieces drives one pass over each part of a text. At
every position the output links give the pieces that end there, and each relaxes the
best score of the position from the best score where it begins (Viterbi).

What a path is worth depends on the model's kind. For a unigram model it is the sum
of the pieces' log probabilities. A BPE model's scores are only ranks of merges, and
the path with the best sum is not the segmentation that the model defines; there a
step is worth 0 if the piece may follow the last piece of the best path (merging the
two pieces' characters gives the two pieces again) and minus infinity if not. Exactly
one path survives, and it equals what merging by rank gives.

Texts are cut where no piece can lie across, and equal parts are encoded once. For a BPE model
that is between two characters that no piece has side by side: neither merging nor a path
crosses there, so marks of words, of sentences and line ends stand apart and a word is the same part before
any of them. For a unigram model it is before marks of words, as sums of scores are compared
by whole words. Characters that no piece has go to byte pieces if the model has them, else to the
unknown piece.

Defined cases: null and empty texts have no pieces; rows that repeat give a row each; an empty
table gives no rows; very long texts and words are encoded whole. Decoding turns ids back into the
normalised text; with a model that normalises nothing that is the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.llm import common

MARK = "▁"
#: The rank of what is no piece.
NONE = float("-inf")
#: Remembered parts of words of a generation, some 250 bytes each.
CACHE_WORDS = 150_000
#: Remembered pairs of pieces of a worker, some 100 bytes each.
CACHE_PAIRS = 500_000
#: Characters whose parts are looked up together; a longer text is a block of its own, cut by as many characters at a time.
BLOCK_CHARS = 1 << 19


class Pieces:
    def __init__(self, model_path: str, kind: str | None = None):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.bytes = [-1] * 256
        self.piece: list[str] = [sp.id_to_piece(i) for i in range(self.n)]
        self.score = [sp.get_score(i) for i in range(self.n)]
        self.id: dict[str, int] = {}
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                self.bytes[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[p] = i
        whole = all(s <= 0 and s == int(s) for s in self.score)
        self.kind = kind or ("bpe" if whole else "unigram")
        self.chars = {c for p in self.id for c in p}
        self.unknown_score = min((self.score[i] for i in self.id.values()), default=0.0) - 10.0
        self.inner_mark = any(MARK in p.lstrip(MARK) for p in self.id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        if self.id:
            self.automaton.make_automaton()
        self.rank = {p: self.score[i] for p, i in self.id.items()}
        self._find_cuts()
        self.cache = common.Memory(CACHE_WORDS)
        self.pairs: dict[int, bool] = {}
        self.ends: dict[int, tuple[tuple, tuple]] = {}
        blob = [self._bytes_of(i) for i in range(self.n)]
        self.decoded = blob

    def _bytes_of(self, i: int) -> bytes:
        if self.sp.is_byte(i):
            return bytes([int(self.piece[i][1:-1], 16)])
        if self.sp.is_control(i):
            return b""
        if self.sp.is_unknown(i):
            return " ⁇ ".encode()
        return self.piece[i].replace(MARK, " ").encode()

    # -- encoding

    def _find_cuts(self) -> None:
        """Classes of characters (0: apart from all others), and whether a part may go on from a class to a class."""
        if self.kind == "bpe":
            beside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
            number = {c: i for i, c in enumerate(sorted(set("".join(beside))), 1)}
            joined = [(number[a], number[b]) for a, b in beside]
        else:
            number = {c: 2 if c == MARK else 1 for c in self.chars}
            joined = [(1, 1), (2, 1), (2, 2)] + [(1, 2)] * self.inner_mark
        self.char_class = np.zeros(0x110000, np.int32)
        for c, i in number.items():
            self.char_class[ord(c)] = i
        self.classes = max(2, *number.values(), 0) + 1
        self.cut = np.ones(self.classes**2, bool)
        self.cut[[a * self.classes + b for a, b in joined]] = False

    def parts(self, norm: str) -> list[str]:
        """The normalised text, in parts that no piece crosses."""
        cuts = [0]
        for at in range(0, len(norm), BLOCK_CHARS):
            codes = np.frombuffer(norm[at : at + BLOCK_CHARS + 1].encode("utf-32-le"), "<u4")
            found = self.char_class[codes]
            cuts += (np.flatnonzero(self.cut[found[:-1] * self.classes + found[1:]]) + (at + 1)).tolist()
        return [norm[a:b] for a, b in zip(cuts, [*cuts[1:], len(norm)])] if norm else []

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        block: list[str] = []
        size = 0
        for text in texts:
            if block and size + len(text) > BLOCK_CHARS:
                yield from self._encode_block(block)
                block, size = [], 0
            block.append(text)
            size += len(text)
        yield from self._encode_block(block)

    def _encode_block(self, texts: list[str]) -> Iterator[np.ndarray]:
        cache = self.cache
        parts = [self.parts(self.sp.normalize(text)) if text else [] for text in texts]
        new = cache.unknown(set().union(*parts))
        known = cache.young
        for part in new:
            known[part] = np.array(self.encode_part(part), "<i4").tobytes()
        for of_text in parts:
            yield np.frombuffer(common.joined(known, of_text), "<i4")

    def encode_part(self, part: str) -> list[int]:
        """By the automaton; a character that no piece has is a part of its own and goes to bytes."""
        return self.viterbi(part) if part[0] in self.chars else self._unknown(part)

    def viterbi(self, word: str) -> list[int]:
        n = len(word)
        last = [-1] * (n + 1)  # piece that ends the best path at each position
        if self.kind == "bpe":
            if (i := self.id.get(word)) is not None and self._stands_alone(i):
                return [i]
            known, n_pieces = self.pairs.get, self.n
            for end, (i, size) in self.automaton.iter(word):
                if last[end + 1] < 0:  # no better path can come: a step is worth 0 or nothing
                    begin = end + 1 - size
                    if begin:
                        if (left := last[begin]) < 0:
                            continue
                        good = known(left * n_pieces + i)
                        if good is None:
                            good = self._follows(left, i)
                    else:
                        good = self._stands_alone(i)
                    if good:
                        last[end + 1] = i
        else:
            self._relax(word, last)
        if n and last[n] < 0:
            return self._without_path(word)
        out: list[int] = []
        while n > 0:
            if (i := last[n]) == self.unknown:
                out += [b for b in self._unknown(word[n - 1])[::-1] if out[-1:] != [self.unknown]]
                n -= 1
            else:
                out.append(i)
                n -= len(self.piece[i])
        return out[::-1]

    def _relax(self, word: str, last: list[int]) -> None:
        """Best sums of scores over all positions; a character that is no piece is a step of its own, worth less than any."""
        best = [0.0] + [float("-inf")] * len(word)
        alone = [False] * (len(word) + 1)  # positions where a piece of one character ends
        score, settled = self.score, 0

        def settle(stop: int) -> None:
            nonlocal settled
            while settled < stop:
                settled += 1
                if not alone[settled] and best[settled - 1] + self.unknown_score > best[settled]:
                    best[settled], last[settled] = best[settled - 1] + self.unknown_score, self.unknown

        for end, (i, size) in self.automaton.iter(word):
            settle(end)
            value = best[end + 1 - size] + score[i]
            if value > best[end + 1]:
                best[end + 1], last[end + 1] = value, i
            if size == 1:
                alone[end + 1] = True
        settle(len(word))

    def _unknown(self, c: str) -> list[int]:
        own = [self.bytes[b] for b in c.encode()]
        return own if min(own) >= 0 else [self.unknown]

    def _without_path(self, word: str) -> list[int]:
        """Where no path ends: characters that are no pieces of their own are written as bytes."""
        symbols = self.merge(word) if self.kind == "bpe" else list(word)
        out: list[int] = []
        for s in symbols:
            if (i := self.id.get(s)) is not None:
                out.append(i)
            else:
                own = [self.bytes[b] for b in s.encode()]
                out += own if min(own) >= 0 else [self.unknown]
        return out

    def _follows(self, left: int, right: int) -> bool:
        key = left * self.n + right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters gives the two pieces again.

        Each piece is merged as it is alone until a merge across the border has the best rank. So only the
        symbols at the border count, and the worst rank that must have its turn before such a symbol grows: of the two
        sides the one with the better worst rank grows first.
        """
        a, b = self._ends(left)[1], self._ends(right)[0]
        if not a or not b:
            return False
        i = j = 0
        while True:
            (x, worst_x), (y, worst_y) = a[i], b[j]
            across = self.rank.get(x + y, NONE)
            if across > worst_x and across >= worst_y:  # of equal ranks the leftmost is merged first
                return False
            if worst_x >= worst_y:
                if worst_x == NONE:
                    return True
                i += 1
            else:
                j += 1

    def _ends(self, i: int) -> tuple[tuple, tuple]:
        """The first and the last symbols of a piece while it is merged, with the worst rank merged until each grows; empty if it does not become one."""
        if (known := self.ends.get(i)) is None:
            piece, n_symbols = self.piece[i], len(self.piece[i])
            known = [], []
            now = [[piece[0], -NONE], [piece[-1], -NONE]]
            for best, symbols in self._merges(piece):
                n_symbols = len(symbols)
                for end, held, symbol in zip(known, now, (symbols[0], symbols[-1])):
                    held[1] = min(held[1], best)
                    if symbol != held[0]:
                        end.append(tuple(held))
                        held[:] = symbol, -NONE
            known = tuple((*end, (piece, NONE)) if n_symbols == 1 else () for end in known)
            self.ends[i] = known
        return known

    def _stands_alone(self, i: int) -> bool:
        return bool(self._ends(i)[0])

    def merge(self, word: str) -> list[str]:
        """Merging by rank, the definition: the best-scored neighbours first, of equals the leftmost."""
        symbols = list(word)
        for _, symbols in self._merges(word):
            pass
        return symbols

    def _merges(self, word: str) -> Iterator[tuple[float, list[str]]]:
        """Rank and symbols of each merge; the list of symbols is one and the same."""
        symbols, rank = list(word), self.rank.get
        ranks = [rank(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while ranks and (best := max(ranks)) > NONE:
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(symbols[at - 1] + symbols[at], NONE)
            if at < len(ranks):
                ranks[at] = rank(symbols[at] + symbols[at + 1], NONE)
            yield best, symbols

    # -- decoding

    def decode(self, ids) -> str:
        """The text of the ids; the mark that encoding puts before a text is taken off."""
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces(model_path: str, kind: str | None = None) -> Pieces:
    return Pieces(model_path, kind)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids and round_trip (whether decoding the ids gives the text again)."""

    def encoded(batch: pa.RecordBatch) -> dict:
        model = pieces(model_path)
        texts = common.texts(batch)
        ids = list(model.encode_all(texts))
        same = [model.decode(x.tolist()) == text for x, text in zip(ids, texts)]
        sizes = [len(x) for x in ids]
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
        return {"doc_id": batch.column("doc_id"), "n_pieces": sizes, "ids": lists, "round_trip": same}

    return common.map_batches(common.documents(docs, id_col, text_col), encoded, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of encoded documents; null ids give an empty text."""

    def decoded(batch: pa.RecordBatch) -> dict:
        model = pieces(model_path)
        return {"doc_id": batch.column("doc_id"), "text": [model.decode(x or []) for x in batch.column("ids").to_pylist()]}

    rows = encoded.selectExpr(f"cast({id_col} as long) as doc_id", f"cast({ids_col} as array<int>) as ids")
    return common.map_batches(rows, decoded, "doc_id long, text string")
