"""A file format for token ids: fixed-width bit packing in blocks, with random access.

Layout (all integers little-endian):

    magic ``TLIDS1\\0\\0``
    blocks: each holds up to ``BLOCK_IDS`` ids, packed with ``bits`` bits an id
    footer: doc ids (int64), doc starts (uint64, one more than docs), block offsets
            (uint64, one more than blocks)
    trailer (40 bytes): footer offset, docs, ids, blocks (uint64), bits (uint32), ids a block (uint32)

Inside a block 64 ids fill exactly ``bits`` 64-bit words, so both directions are 64
vectorised shifts over all groups of 64 ids. A reader seeks to the blocks that hold
the ids it wants; it needs the footer and those blocks only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

MAGIC = b"TLIDS1\0\0"
BLOCK_IDS = 1 << 16
_TRAILER = struct.Struct("<QQQQII")

#: Widths that numpy has a type for.
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def bits_for(n_ids: int) -> int:
    """Fewest bits that hold the ids 0 to n_ids - 1."""
    return max(1, int(n_ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    rows = np.zeros(-(-len(ids) // 64) * 64, np.uint64)
    rows[: len(ids)] = ids
    if bits in _WHOLE:  # the same bytes, without shifts
        return rows.astype(_WHOLE[bits]).tobytes()
    rows = rows.reshape(-1, 64)
    out = np.zeros((len(rows), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in _WHOLE:
        return np.frombuffer(data, _WHOLE[bits], n).astype(np.uint32)
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.reshape(-1)[:n]


class Writer:
    """Streams documents into a file; holds one block and the footer in memory."""

    def __init__(self, sink: BinaryIO, bits: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.doc_ids: list[int] = []
        self.starts, self.offsets = [0], [len(MAGIC)]
        self.held: list[np.ndarray] = []
        self.n_held = 0
        sink.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for start in range(0, end, self.block_ids):
            data = pack(ids[start : min(end, start + self.block_ids)], self.bits)
            self.sink.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        self.sink.write(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.sink.write(_TRAILER.pack(self.offsets[-1], len(self.doc_ids), self.starts[-1], len(self.offsets) - 1, self.bits, self.block_ids))


class Reader:
    """Random access to a file that ``Writer`` made; ``source`` can seek."""

    def __init__(self, source: BinaryIO):
        self.source = source
        size = source.seek(0, 2)
        source.seek(size - _TRAILER.size)
        footer, n_docs, self.n_ids, n_blocks, self.bits, self.block_ids = _TRAILER.unpack(source.read(_TRAILER.size))
        source.seek(footer)
        data = source.read(size - _TRAILER.size - footer)
        self.doc_ids = np.frombuffer(data, "<i8", n_docs)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, 8 * n_docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, 8 * (2 * n_docs + 1)).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        self.source.seek(int(self.offsets[k]))
        data = self.source.read(int(self.offsets[k + 1] - self.offsets[k]))
        return unpack(data, self.bits, min(self.block_ids, self.n_ids - k * self.block_ids))

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive) of the file."""
        first = start // self.block_ids
        parts = [self.block(k) for k in range(first, -(-end // self.block_ids))]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return ids[start - first * self.block_ids : end - first * self.block_ids]

    def doc(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))

    def docs(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(doc id, start, parts of its ids) in file order; holds one block."""
        k, ids = -1, np.zeros(0, np.uint32)
        for doc_id, start, end in zip(self.doc_ids.tolist(), self.starts.tolist(), self.starts[1:].tolist(), strict=False):
            parts, at = [], start
            while at < end:
                if at // self.block_ids != k:
                    k = at // self.block_ids
                    ids = self.block(k)
                stop = min(end, (k + 1) * self.block_ids)
                parts.append(ids[at - k * self.block_ids : stop - k * self.block_ids])
                at = stop
            yield doc_id, start, parts
