"""Shingle sets of whole texts as sorted 64-bit hashes, vectorised over the UTF-8 bytes of many texts at once.

A word's hash is a sum over its bytes of a random value of the byte times a random odd factor of its place,
then mixed; a shingle's hash mixes those of its words in order. A-Z count as a-z. Two different shingles get the
same hash with probability about 2**-64; sets are compared by these hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed at once, and places of a word whose factors are tabled.
BLOCK_BYTES, PLACES = 500_000, 4096


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def factor(place: np.ndarray) -> np.ndarray:
    return mix(place.astype(U) * U(0x9E3779B97F4A7C15) + U(0x1234567)) | U(1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = mix(np.arange(256, dtype=U) + U(77))
_VALUE[65:91] = _VALUE[97:123]
_VALUE[_SPACE] = 0
_FACTOR = factor(np.arange(PLACES))
_ORDER = mix(np.arange(1, 65, dtype=U)) | U(1)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in ``data``, and the number of words up to each text's end."""
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    heads = ends[:-1]
    heads = heads[heads < len(data)]
    start[heads] = ~space[heads]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, U), np.zeros(len(ends), np.int64)
    place = np.arange(len(data)) - np.repeat(np.r_[0, at], np.diff(np.r_[0, at, len(data)]))
    far = place >= PLACES
    by = _FACTOR[np.where(far, 0, place)]
    if far.any():
        by[far] = factor(place[far])
    return mix(np.add.reduceat(_VALUE[data] * by, at)), np.searchsorted(at, ends)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text of a string column the sorted distinct hashes of its k-word shingles (of all its words if fewer than k)."""
    size = column.type == pa.large_string()
    offsets = np.frombuffer(column.buffers()[1], np.int64 if size else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        part, ends = data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first]
        h, upto = word_hashes(part, ends) if len(part) else (np.zeros(0, U), np.zeros(len(ends), np.int64))
        n = max(0, len(h) - k + 1)
        every = np.full(n, U(k))
        for i in range(k):
            every += h[i : i + n] * _ORDER[i]
        every = mix(every)
        begin = 0
        for end in upto.tolist():
            if end - begin >= k:
                yield np.unique(every[begin : end - k + 1])
            elif end > begin:
                yield mix(np.array([end - begin], U) + (h[begin:end] * _ORDER[: end - begin]).sum())
            else:
                yield np.zeros(0, U)
            begin = end
        first = last
