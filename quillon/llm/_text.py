"""Numpy kernels over the bytes of many texts at once.

Texts come as Arrow string arrays; their UTF-8 buffers are used in place, so
no Python object is made per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64)

#: 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit hashes."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(21, int(n).bit_length()))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000):
    """Parts of a batch with about ``most`` bytes of text each (one row at least)."""
    offsets = buffers(batch.column(batch.schema.get_field_index(column)))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = space[data]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which span_hash() has the hash of any span."""
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[0][: len(data)], dtype=U64, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mix(h + (ends - starts).astype(U64) * _BASE)


def shingles(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its word shingles.

    Words are lower-cased by A-Z only. A row of fewer than ``size`` words has
    its whole sequence as one shingle; a row without words has none.
    """
    data, offsets = buffers(texts)
    data = LOWER[data]
    starts, ends, _ = words(data, offsets)
    h = span_hash(prefix_sums(data), starts, ends)
    first = np.searchsorted(starts, offsets)
    n = len(h)
    if n >= size:
        grams = np.zeros(n - size + 1, U64)
        for j in range(size):
            grams += h[j : n - size + 1 + j] * _STEPS[j % len(_STEPS)] + U64(j)
        grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            part = U64(b - a)
            for j in range(a, b):
                part = U64((int(part) * int(_BASE) + int(h[j])) % (1 << 64))
            out.append(mix(np.array([part], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out
