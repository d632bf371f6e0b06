"""Vectorised word handling over Arrow string columns.

Texts are handled as UTF-8 bytes, many documents at a time: word bounds come from a
byte class, word hashes from prefix sums of a polynomial hash modulo 2**64 over
random byte codes, finished by a bit mixer.  Chunks bound the memory of a task; a
single text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15 | 1)
BASE_INV = _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators of the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate(([_U(1)], np.cumprod(np.full(size - 1, b, _U)))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


BYTE_POWERS = Powers(int(BASE))


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of values[i] * base**i; ``span`` hashes any stretch from them."""
    up, _ = powers.upto(len(values))
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up, out=out[1:])
    return out


def span(pre: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the stretch [start, end), whatever its place."""
    _, down = powers.upto(len(pre))
    return (pre[end] - pre[start]) * down[start]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; nulls have length zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [i, j) at a time: (i, j, their bytes, bounds of the texts in these bytes)."""
    data, offsets = string_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of the texts of a chunk: byte bounds, first word of each text, hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACE, hashes: bool = True) -> None:
        word = ~separators[data]
        edge = bounds[(bounds > 0) & (bounds < len(data))]
        before = np.empty_like(word)
        before[:1], before[1:] = False, word[:-1]
        before[edge] = False
        after = np.empty_like(word)
        after[-1:], after[:-1] = False, word[1:]
        after[edge - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.first[-1] = len(self.start)
        if hashes:
            self.hash = mix(span(prefix(BYTE_CODES[data], BYTE_POWERS), self.start, self.end, BYTE_POWERS))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Of each word, the text it belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
