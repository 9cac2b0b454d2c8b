"""Words, shingles and byte n-grams of Arrow text columns, as numpy arrays over blocks of whole documents.

A block is the bytes of some documents one after the other (``data``) and the n + 1 positions that delimit
them (``ends``). Documents are never cut: a block holds at least one document, and as many more as fit.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: does it belong to a word; its value with A-Z lowered."""
    inside = np.ones(256, bool)
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        inside[low : high + 1] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    return inside, lower


_INSIDE, _LOWER = _tables()
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for n positions."""
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    out = _POWERS[0][:n], _POWERS[1][:n]
    if len(_POWERS[0]) > 16 * BLOCK_BYTES:  # of one very long document: not worth keeping
        _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and delimiting positions of a string column; nulls are empty."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, docs: int = BLOCK_DOCS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, delimiting positions) of runs of whole documents."""
    data, ends = utf8(column)
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        to = min(to, n, at + docs)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the accented capitals of Latin-1 (two bytes, the first 0xC3) in lower case."""
    out = _LOWER[data]
    if len(out) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 0x20
    return out


def words(data: np.ndarray, ends: np.ndarray, letters: np.ndarray = _INSIDE, lower=lowered) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and where each document's words begin and end among them.

    A word is a longest run of bytes in ``letters``: characters other than ASCII white space, punctuation and control
    characters unless told otherwise, as is what ``lower`` makes of the bytes.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    low = lower(data)
    inside = letters[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin = ends[:-1][ends[:-1] < n]  # a word ends with its document
    first[begin] = inside[begin]
    stop = ends[1:][ends[1:] > 0] - 1
    last[stop] = inside[stop]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    return mix((total[last + 1] - total[first]) * inverse[first]), np.searchsorted(first, ends)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the document of each; a shorter document is one run."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes))
    left = at[1:][doc] - place
    out = np.zeros(len(hashes), np.uint64)
    for j in range(size):
        later = np.zeros(len(hashes), np.uint64)
        later[: max(0, len(hashes) - j)] = hashes[j:]
        out = np.where(left > j, out * _SHINGLE + later, out)
    whole = (left >= size) | ((n[doc] < size) & (place == at[:-1][doc]))
    return mix(out[whole]), doc[whole]


def counted(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) with their counts, ordered by document. Keeps the upper 44 bits of a hash.

    ``n_docs`` is at most ``BLOCK_DOCS``, below 2**20.
    """
    keys = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    where = np.flatnonzero(new)
    keys = keys[where]
    return keys & np.uint64((1 << 44) - 1), (keys >> np.uint64(44)).astype(np.int64), np.diff(np.append(where, len(new)))


def gram_counts(data: np.ndarray, ends: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Counts of hashed byte n-grams (n <= 4) per document: documents x buckets, a power of two, float32."""
    docs, size = len(ends) - 1, len(data) - n + 1
    if size <= 0:
        return np.zeros((docs, buckets), np.float32)
    gram = np.zeros(size, np.uint32)
    for j in range(n):
        gram |= data[j : j + size].astype(np.uint32) << np.uint32(8 * j)
    gram = (gram * np.uint32(2654435761)) ^ (gram >> np.uint32(15))
    gram = (gram * np.uint32(2246822519)) >> np.uint32(32 - int(buckets).bit_length() + 1)
    doc = np.repeat(np.arange(docs), np.diff(ends))[:size]
    whole = ends[1:][doc] - np.arange(size) >= n
    cells = doc[whole] * buckets + gram[whole].astype(np.int64)
    return np.bincount(cells, minlength=docs * buckets).reshape(docs, buckets).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay zero."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def lean(work):
    """A function of Arrow batches that, at the end of its task, gives the memory it freed back to the machine, since
    the worker stays for tasks to come."""
    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not this C library's
                pass

    return run
