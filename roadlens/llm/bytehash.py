"""Vectorised hashing of words and windows in Arrow string columns (numpy, inside tasks).

A column's texts lie end to end in one byte buffer. With the wrapping prefix sums
P[i] = sum(b[j] * M**j, j < i) modulo 2**64 and an odd M, any slice's hash is
(P[end] - P[start]) * M**-start: no loop over words or characters is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table asked for so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0], done = 1, 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array; nulls are empty slices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def in_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each (one text may be longer).

    Hashing takes some tens of bytes of memory for each byte of text, whatever Arrow's batch size.
    """
    _, at = buffer_of(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def prefix_sums(data: np.ndarray, base: int = MULTIPLIER) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def slices(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = INVERSE) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash of each word and the number of words before each text (n + 1).

    lut maps a byte to the byte hashed in its place, 0 where it separates words. Words never
    span texts. For each length in heads a further array has hashes of the words' first bytes.
    """
    seen = lut[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = seen != 0
    starts = inside[1:-1] & ~inside[:-2]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    starts[cuts] |= inside[cuts + 1]
    start = np.flatnonzero(starts)
    stops = ~inside[2:] & inside[1:-1]
    stops[cuts - 1] |= inside[cuts]
    end = np.flatnonzero(stops) + 1
    sums = prefix_sums(seen)
    cut = [mix(slices(sums, start, np.minimum(end, start + n))) for n in heads]
    return mix(slices(sums, start, end)), np.searchsorted(start, offsets), *cut


def lut_of(is_word, lower_ascii: bool) -> np.ndarray:
    lut = np.array([b if is_word(b) else 0 for b in range(256)], np.uint8)
    if lower_ascii:
        lut[65:91] = np.where(lut[65:91] != 0, lut[65:91] + 32, 0)
    return lut
