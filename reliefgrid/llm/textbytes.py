"""Vectorised word work on the UTF-8 bytes of Arrow text columns.

Words are found and hashed for a few megabytes of text at a time, so a task's memory follows
the longest text, not the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_seeds = np.random.default_rng(20240229)
_BYTE = _seeds.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(int(_seeds.integers(0, 2**63)) * 2 + 1)
_ODD = _seeds.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_byte = np.arange(256)
#: Bytes of words that white space separates.
SPACED = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: Bytes of words made of ASCII digits, letters and everything beyond ASCII.
ALNUM = (_byte >= 0x80) | ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges holding about ``limit`` bytes of text, one row at least."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and ends; a null is empty."""
    kind = np.int32 if pa.types.is_string(texts.type) else np.int64
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if texts.null_count:
        # A null row may cover bytes; cut those out.
        return text_bytes(pa.array([x or "" for x in texts.to_pylist()], pa.large_string()))
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


class Words:
    """Words of many texts: byte spans, 64-bit hashes, and the range of words of each text."""

    def __init__(self, texts: pa.Array, kind: np.ndarray, hashed: bool = True) -> None:
        data, offsets = text_bytes(texts)
        inside = kind[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[offsets] = False
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[offsets] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.hashes = self._hash(data, inside) if hashed else None

    def _hash(self, data: np.ndarray, inside: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(sizes.max()), _STEP))))
        parts = _BYTE[LOWER[data[inside]]] * powers[place]
        return mix(np.add.reduceat(parts, begin) + sizes.astype(np.uint64))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` consecutive words that begin at each word with enough words after it."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size))
    for i in range(size):
        total = total * _STEP + words[i:i + n]
    return mix(total)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer than ``size`` words has its whole sequence as one shingle; one without
    words has none.
    """
    words = Words(texts, SPACED)
    runs = run_hashes(words.hashes, size)
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if end - begin >= size:
            yield np.unique(runs[begin:end - size + 1])
        elif end > begin:
            yield run_hashes(words.hashes[begin:end], end - begin)
        else:
            yield runs[:0]


def fingerprint(members: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit fingerprints of a set of hashes."""
    size = np.full(1, len(members), np.uint64)
    first = mix(members ^ _ODD[40]).sum(keepdims=True, dtype=np.uint64) + size * _ODD[41]
    second = mix(members + _ODD[42]).sum(keepdims=True, dtype=np.uint64) ^ (size * _ODD[43])
    pair = np.concatenate([first, second])
    return tuple(mix(pair).view(np.int64).tolist())
