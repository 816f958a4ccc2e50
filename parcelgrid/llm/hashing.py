"""Words and shingles of many texts at once, hashed with numpy over their UTF-8 bytes.

Nothing here loops over rows in Python: a batch of texts is one byte array with the bounds of its documents.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MULTIPLIER, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                   0x589965CC75374CC3], dtype=U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        steps = np.full(size, base, dtype=U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; `span_hash` reads the hash of any span off it."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * powers(MULTIPLIER, len(data)), out=out[1:], dtype=U)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    back = powers(INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(U) * U(0xC2B2AE3D27D4EB4F))


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document bounds of a binary column without copying texts one by one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last + 1, their bytes, their bounds from 0), about `limit` bytes at a time."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and where each document's words begin (with the total at the end)."""
    data = LOWER[data]
    if not len(data):
        return np.zeros(0, U), np.zeros(len(bounds), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return span_hash(prefix_hash(data), start, end), np.searchsorted(start, bounds).astype(np.int64)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of `size` words; a document with fewer words has its whole sequence as one."""
    n = len(hashes)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    at, last = np.arange(n), first[1:][doc]
    total = np.zeros(n, dtype=U)
    padded = np.concatenate([hashes, np.zeros(size, U)])
    for j in range(size):
        total += np.where(at + j < last, padded[j:j + n] * PLACES[j], U(0))
    keep = (at + size <= last) | ((at == first[doc]) & (counts[doc] < size))
    return mix(total[keep]), doc[keep]


def distinct_shingles(data: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted by (document, hash)."""
    h, doc = shingles(*words(data, bounds), size)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
