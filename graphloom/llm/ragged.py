"""Whole Arrow string columns as flat numpy arrays: words, hashes and per-document reductions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_STEP), -1, 1 << 64))
_MULTIPLIERS = [U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5)]

#: Word bytes: everything but ASCII white space (x20, x09-x0D).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: digits, ASCII letters and every byte of a code point above x7F.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: One random 64-bit value a byte; A-Z take those of a-z.
BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
BYTE_CODES[0x41:0x5B] = BYTE_CODES[0x61:0x7B]

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash step and of its inverse, modulo 2**64; grown on demand."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _STEP), ("down", _INVERSE)):
            factors = np.full(size, base, U64)
            factors[0] = U64(1)
            _powers[name] = np.cumprod(factors, dtype=U64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (one longer row stands alone)."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words, and how many words each row has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased (a polynomial over prefix sums, then mixed)."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def distinct_by_row(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in ascending order, and how many each row has."""
    values = values.copy()
    edges = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[edges[:-1][counts > 0]] = True
    rows = np.repeat(np.arange(len(counts)), counts)
    return values[fresh], np.bincount(rows[fresh], minlength=len(counts))


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words in each row; a row with fewer words has its whole sequence as one."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    first = np.repeat(edges[:-1], made) + (np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made))
    length = np.repeat(np.minimum(counts, width), made)
    out = np.zeros(len(first), U64)
    for k in range(width):
        held = k < length
        part = hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] if len(hashes) else out
        out = np.where(held, mix(out * _MULTIPLIERS[k % 3] + part + U64(k + 1)), out)
    return out, made
