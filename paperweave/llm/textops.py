"""Vectorised word and shingle arithmetic over Arrow string columns.

Texts are never turned into Python strings here: words are found and hashed on the concatenated UTF-8 bytes of a run of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Rows are handled in runs of about this many bytes of text, whatever the batch brings.
RUN_BYTES = 1 << 19
#: A single longer text is hashed in blocks of about this many bytes, cut at separators.
BLOCK_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Truth by byte value: within one of the ranges, ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Separators of words ``[^\\x20\\x09-\\x0D]+``.
BLANK = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Separators of words of lower-cased text made of digits, letters and anything beyond ASCII.
NOT_ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, U)
_inverses = np.ones(1, U)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[U(1), np.full(n - 1, _BASE, U)], dtype=U)
            _inverses = np.cumprod(np.r_[U(1), np.full(n - 1, _INVERSE, U)], dtype=U)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the len+1 offsets of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(batch: pa.RecordBatch, text: str = "text", limit: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``limit`` bytes of text, one row at least, each with its bytes and offsets."""
    data, at = strings(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_bounds(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and row of every word."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~separators[data]
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = ~inside[:-1]
    fresh[at] = True
    starts = np.flatnonzero(inside & fresh[:n])
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:]
    ends_at = at[1:] - 1
    last[ends_at[ends_at >= 0]] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def _hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _grow(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_TABLE[data] * _powers[: len(data)], dtype=U, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if len(data) <= BLOCK_BYTES:
        return _hash_block(data, starts, ends) if len(starts) else np.zeros(0, U)
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        a, b = starts[i], ends[j - 1]
        out.append(_hash_block(data[a:b], starts[i:j] - a, ends[i:j] - a))
        i = j
    return np.concatenate(out) if out else np.zeros(0, U)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        h = np.full(n, k, U)
        for i in range(k):
            h = h * U(0xD6E8FEB86659FD93) + words[i : i + n]
            h ^= h >> U(29)
        return mix(h)


def rolling(words: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hash of every k consecutive word hashes, in one pass whatever k is."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _power_pair(base, len(words) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, U)
        np.cumsum(words * up[: len(words)], dtype=U, out=sums[1:])
        return mix((sums[k:] - sums[:n]) * down[:n])


_pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_pair(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    found = _pairs.get(base)
    if found is None or len(found[0]) < n:
        with np.errstate(over="ignore"):
            found = _pairs[base] = tuple(np.cumprod(np.r_[U(1), np.full(n - 1, b, U)], dtype=U) for b in (base, pow(base, -1, 1 << 64)))
    return found


def row_slices(rows: np.ndarray, n: int) -> np.ndarray:
    """Of words sorted by row: the n+1 offsets of the rows' words."""
    return np.searchsorted(rows, np.arange(n + 1))


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, U).view(np.int64)
