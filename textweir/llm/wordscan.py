"""Words and word windows of many texts at once, as 64-bit hashes over Arrow's byte buffers.

Word classes are sets of bytes. That is exact for classes that hold all or none of the
characters beyond ASCII, since bytes of 0x80 and more occur in nothing else in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LANE = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 9)], dtype=np.uint64)
#: Text that a worker has in its hands at once; its arrays take some 30 times as much.
SLICE_BYTES = 1 << 20


def byte_class(keep: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(keep)] = True
    return out


#: Digits, letters (in lower case) and all beyond ASCII.
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Everything but ASCII white space.
NON_SPACE = byte_class(bytes(b for b in range(256) if b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every bit depends on every bit."""
    h = (h ^ (h >> _U(30))) * _M2
    h = (h ^ (h >> _U(27))) * _M3
    return h ^ (h >> _U(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``most`` bytes of text (a longer text alone).

    Arrow's allocator keeps what was freed; a worker hands it back between pieces.
    """
    offsets = offsets_of(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        pa.default_memory_pool().release_unused()
        start = stop


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice of texts and the offsets in them; a null text has none."""
    texts = texts.fill_null("")
    offsets = offsets_of(texts)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """``start``/``end`` of each word in ``raw``, its hash, and ``first[i]:first[i+1]``, the words of text i."""

    def __init__(self, texts: pa.Array, kind: np.ndarray, fold: bool = True):
        raw, self.offsets = text_bytes(texts)
        self.raw = _LOWER[raw] if fold else raw
        self.start, self.end = _spans(kind[self.raw], self.offsets)
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = span_hash(self.raw, self.start, self.end - self.start)

    def window_hash(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each position of ``at`` on, by their order."""
        return combine(self.hash, at, size)

    def places(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Word positions where a window of ``size`` words fits in its text, and their bounds by text."""
        counts = np.maximum(np.diff(self.first) - (size - 1), 0)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(bounds[-1]) + np.repeat(self.first[:-1] - bounds[:-1], counts)
        return at, bounds


def combine(word: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    factor = _M1
    with np.errstate(over="ignore"):
        total = np.full(len(at), _U(size) * _M3, dtype=np.uint64)
        for i in range(size):
            total += word[at + i] * factor
            factor = factor * _M2 | _U(1)
        return mix(total)


def _spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(mask) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty_like(mask), np.empty_like(mask)
    before[0] = after[-1] = False
    before[1:], after[:-1] = mask[:-1], mask[1:]
    edges = offsets[(offsets > 0) & (offsets < len(mask))]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def span_hash(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    lanes = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * _M1)
        live, done = np.arange(len(start)), 0
        while len(live):
            left = size[live] - done
            out[live] = mix((out[live] ^ (lanes[start[live] + done] & _LANE[np.minimum(left, 8)])) * _M1)
            done += 8
            live = live[left > 8]
    return out
